"""numpy kernels against plain loops and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tomospark.functions import kernels as k


def volume(shape, seed=0):
    return np.random.default_rng(seed).normal(size=shape)


@given(st.integers(1, 9), st.integers(1, 4), st.integers(1, 3), st.integers(0, 2), st.sampled_from(k.MODES))
@settings(max_examples=60, deadline=None)
def test_moving(n, depth, stride, start, mode):
    image = volume((n, 2, 3), n)
    got = k.moving(image, depth, mode, stride, start)
    size = max(0, (n - depth - start) // stride + 1)
    assert len(got) == size
    for i in range(size):
        part = np.sort(image[start + i * stride : start + i * stride + depth], axis=0)
        want = {"max": part[-1], "min": part[0], "mean": part.mean(axis=0), "median": part[min(-(-depth // 2), depth - 1) if depth > 1 else 0]}[mode]
        assert np.allclose(got[i], want)


@given(st.tuples(*[st.integers(2, 7)] * 3), st.tuples(*[st.integers(1, 2)] * 3))
@settings(max_examples=40, deadline=None)
def test_patches_round_trip(shape, stride):
    image = volume(shape, sum(shape))
    boxes = k.patches(image, (2, 2, 2), stride)
    assert np.allclose(k.assemble(boxes, stride, shape), image)


def test_patch_padding():
    assert k.pad_for_patches((5, 4, 4), (2, 2, 2), (2, 2, 2)) == [(0, 1), (0, 0), (0, 0)]
    assert k.pad_for_patches((4, 4, 4), (2, 2, 2), (1, 2, 2)) is None


def test_label_touching_corners():
    image = np.zeros((3, 3, 3), int)
    image[0, 0, 0] = image[1, 1, 1] = 1
    assert k.label(image).max() == 1
    assert k.label(image, 6).max() == 2
    assert k.label(np.array([[1, 0, 2], [1, 0, 2]])).max() == 2


def test_label_against_flood_fill():
    image = (volume((5, 6, 7), 3) > 0.6).astype(int)
    seen, number = np.zeros(image.shape, int), 0
    for at in np.argwhere(image):
        if seen[tuple(at)]:
            continue
        number += 1
        todo = [tuple(at)]
        while todo:
            p = todo.pop()
            if seen[p]:
                continue
            seen[p] = number
            for d in np.ndindex(3, 3, 3):
                q = tuple(np.array(p) + np.array(d) - 1)
                if all(0 <= a < b for a, b in zip(q, image.shape, strict=True)) and image[q] and not seen[q]:
                    todo.append(q)
    assert (k.label(image) == seen).all()


def test_resize_keeps_constants_and_ramps():
    assert np.allclose(k.resize(np.full((3, 4, 5), 7.0), (6, 2, 9)), 7)
    ramp = np.arange(8.0)[:, None, None] * np.ones((8, 2, 2))
    assert np.allclose(k.zoom(ramp, (15, 2, 2), 1)[:, 0, 0], np.linspace(0, 7, 15))
    assert np.allclose(k.zoom(np.full((3, 4, 5), 7.0), (6, 2, 9)), 7)
    assert np.allclose(k.resize(ramp, (8, 2, 2)), ramp)


def test_cubic_spline_interpolates():
    image = volume((6, 5, 4), 1)
    assert np.allclose(k.zoom(image, (6, 5, 4)), image)
    assert np.allclose(k.zoom(image, (11, 5, 4))[::2], image)


def test_rotation():
    image = volume((2, 5, 5), 2)
    assert (k.rotate(image, 360) == image).all()
    inner = k.rotate(k.rotate(np.pad(image, [(0, 0), (4, 4), (4, 4)]), 30), -30)[:, 4:-4, 4:-4]
    assert np.corrcoef(inner.ravel(), image.ravel())[0, 1] > 0.5
    smooth = np.add.outer(np.zeros(2), np.add.outer(np.arange(9.0), 2 * np.arange(9.0)))
    assert np.allclose(k.rotate(smooth, 0.0), smooth)
    turned = k.rotate(smooth, 180.0)
    assert np.allclose(turned, smooth[:, ::-1, ::-1])


def test_lung_mask_of_hollow_box():
    image = np.zeros((5, 11, 11))
    image[:, :, :] = -1000.0  # air around
    image[:, 1:10, 1:10] = 50.0  # body
    image[:, 3:8, 3:8] = -800.0  # lung
    mask = k.lung_mask(image, 0)
    assert mask[:, 3:8, 3:8].all() and mask.sum() == 5 * 25
    assert k.lung_mask(image, 1).sum() == 5 * 9


def test_boxes_and_ellipsoids_are_clipped():
    assert k.paint_boxes((3, 3, 3), [(-1, 1, 2)], [(2, 1, 5)]).sum() == 1
    assert k.paint_ellipsoids((5, 5, 5), [(2, 2, 2)], [(0, 2, 2)]).sum() == 0
    grid = np.indices((5, 5, 5)) - 2
    assert (k.paint_ellipsoids((5, 5, 5), [(2, 2, 2)], [(2, 2, 2)]) == ((grid**2).sum(axis=0) < 4)).all()


def test_quantize():
    values = volume((10, 10, 10), 4)
    codes, centers = k.quantize(values)
    back = centers[codes.astype(int) + 128]
    assert np.abs(back - values.ravel()).max() < 2 * np.ptp(values) / 256
    assert len(k.quantize(np.zeros(0))[0]) == 0


def test_unfold_and_refit():
    stack = np.zeros((3, 2, 2, 1))
    stack[1] = 1
    assert k.unfold(stack, (4, 2, 2), 2, 1)[:, 0, 0].tolist() == [0, 1, 1, 0]
    mask = np.zeros((8, 6, 6))
    mask[1:7, 1:3, 1:3] = 1
    fitted = k.refit_heights(mask)
    assert fitted.sum() == 2 * 4 and fitted[2:4, 1:3, 1:3].all()


def test_largest_label():
    assert k.largest_label(np.array([0, 0, 0, 2, 2, 1, 1]), 0) == 1
    assert k.largest_label(np.zeros(3, int), 0) == -999999


def test_unknown_mode():
    with pytest.raises(ValueError, match="mode"):
        k.moving(np.zeros((3, 1, 1)), 2, "sum")
