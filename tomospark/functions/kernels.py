"""numpy kernels for what built-in functions can't express well: moving windows, resampling, rotation, labelling.

They take and return arrays (z, y, x) and know nothing of Spark; per_row makes Arrow-based column functions of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Axis order of each projection, its inverse, and the modes of intensity projection.
PROJECTIONS = {"axial": (0, 1, 2), "coronal": (1, 0, 2), "sagital": (2, 0, 1)}
REVERSE = {"axial": (0, 1, 2), "coronal": (1, 0, 2), "sagital": (1, 2, 0)}
MODES = ("max", "min", "mean", "median")


def per_row(kernel, returns: str = "array<double>"):
    """Column function of kernel(volume, *other values), given the flat volume's column, its shape's and the others.

    The others are plain values or arrays, not structs. An array result is flattened. One row is held at a time.
    """

    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for flat, z, y, x, *others in rows.itertuples(index=False, name=None):
            got = None if flat is None else kernel(np.asarray(flat, float).reshape(z, y, x), *others)
            out.append(got.ravel() if isinstance(got, np.ndarray) else got)
        return pd.Series(out, dtype=object)

    # as if not deterministic: a filter inferred for an explode, or pushed down, must not run the kernel a second time
    udf = F.pandas_udf(run, returns).asNondeterministic()

    def column(volume: Column, shape: Column, *others: Column) -> Column:
        named = [o.alias(f"c{k}") for k, o in enumerate(others)]
        return udf(F.struct(volume.alias("v"), *[shape[a].alias(a) for a in "zyx"], *named))

    return column


def moving(image, depth: int, mode: str, stride: int = 1, start: int = 0):
    """Projection of each window of depth slices along the first axis.

    The median is the element of index ceil(depth / 2) of the sorted window; the mean truncates for integer images.
    """
    n = (image.shape[0] - depth - start) // stride + 1
    if n <= 0:
        return image[:0]
    windows = np.lib.stride_tricks.sliding_window_view(image[start:], depth, axis=0)[: (n - 1) * stride + 1 : stride]
    if mode == "max":
        return windows.max(axis=-1)
    if mode == "min":
        return windows.min(axis=-1)
    if mode == "mean":
        return windows.mean(axis=-1).astype(image.dtype)
    if mode == "median":
        return np.sort(windows, axis=-1)[..., math.ceil(depth / 2) if depth > 1 else 0]
    raise ValueError(f"unknown mode {mode}")


def padded_xip(image, depth: int, stride: int = 1, mode: str = "max", projection: str = "axial", padding: str = "reflect"):
    """Projection with padding; the extra padding follows the first axis whatever the projection."""
    extra = (image.shape[0] - 2 * (depth // 2)) % stride
    pad = depth // 2 + extra // 2
    turned = np.pad(image.transpose(PROJECTIONS[projection]), [(pad, pad), (0, 0), (0, 0)], mode=padding)
    return moving(turned, depth, mode, stride).transpose(REVERSE[projection])


def xip(image, depth: int, modes, stride: int = 1, start: int = 0, projection: str = "axial", squeeze: bool = False, channels: int = 1):
    """(slices, y, x, channels) of one or several modes without padding; remainder slices of channel groups are dropped."""
    turned, out = image.transpose(PROJECTIONS[projection]), []
    for mode in [modes] if isinstance(modes, str) else modes:
        one = moving(turned, depth, mode, stride, start)
        if channels == 1:
            one = one[..., None]
        else:
            one = one[: len(one) - len(one) % channels]
            one = one.reshape(-1, channels, *one.shape[1:]).transpose(0, 2, 3, 1)
            one = one.max(axis=-1, keepdims=True) if squeeze else one
        out.append(one)
    return np.concatenate(out, axis=-1)


def unfold(stack, shape, depth: int, stride: int, start: int = 0, channels: int = 1, squeezed: bool = True):
    """Spread each projection over its window by sum: (slices, y, x, channels) -> (z, y, x)."""
    out = np.zeros(shape)
    for k in range(len(stack) * channels):
        at = start + k * stride
        out[at : at + depth] += stack[k // channels, ..., 0 if squeezed else k % channels]
    return out


def refit_heights(image):
    """Give each component of ones a height of the mean of its y and x extents, around its centroid, as a box."""
    labels = label(image >= 1, 26)
    out = np.zeros(image.shape)
    for k in range(1, labels.max() + 1):
        at = np.argwhere(labels == k)
        low, high = at.min(axis=0), at.max(axis=0) + 1
        half = (high[1:] - low[1:]).sum() / 4
        z = at[:, 0].mean()
        out[int(z - half) : int(z + half), low[1] : high[1], low[2] : high[2]] = 1
    return out


def triangle(x):
    return np.maximum(0.0, 1.0 - np.abs(x))


def lanczos(x):
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def weights(n: int, m: int, kind: str = "linear"):
    """Matrix (m, n) that resamples n samples to m: pixel centres at half, the filter widened when shrinking, rows sum to 1."""
    if n == m:
        return np.eye(n)
    scale = n / m
    wide = max(scale, 1.0)
    center = (np.arange(m) + 0.5) * scale
    x = (np.arange(n)[None, :] + 0.5 - center[:, None]) / wide
    if kind == "nearest":
        w = np.zeros((m, n))
        w[np.arange(m), np.minimum((center).astype(int), n - 1)] = 1
        return w
    w = lanczos(x) if kind == "lanczos" else triangle(x)
    return w / w.sum(axis=1, keepdims=True)


def resize(image, shape, kind: str = "linear", order=(0, 1, 2)):
    """Separable resampling, one axis after the other."""
    for axis in order:
        m = shape[axis]
        image = np.moveaxis(np.tensordot(weights(image.shape[axis], int(m), kind), image, axes=(1, axis)), 0, axis)
    return image


def to_shape(image, shape, padding: str = "edge"):
    """Crop or pad about the centre."""
    for axis, m in enumerate(shape):
        over = image.shape[axis] - int(m)
        if over >= 0:
            image = np.take(image, range(over // 2, over // 2 + int(m)), axis=axis)
        else:
            pad = [(0, 0)] * 3
            pad[axis] = (-over // 2, -over - (-over // 2))
            image = np.pad(image, pad, mode=padding)
    return image


def spline_coefficients(image, axis: int):
    """Cubic B-spline prefilter along an axis with mirrored ends."""
    pole = math.sqrt(3) - 2
    c = np.moveaxis(image.astype(float), axis, 0) * 6.0
    n = len(c)
    if n == 1:
        return np.moveaxis(c / 6.0, 0, axis)
    horizon = min(n, 30)
    c[0] = sum(c[k] * pole**k for k in range(horizon)) if horizon < n else _whole_mirror(c, pole)
    for k in range(1, n):
        c[k] += pole * c[k - 1]
    c[-1] = (pole / (pole * pole - 1)) * (c[-1] + pole * c[-2])
    for k in range(n - 2, -1, -1):
        c[k] = pole * (c[k + 1] - c[k])
    return np.moveaxis(c, 0, axis)


def _whole_mirror(c, pole):
    n = len(c)
    period = 2 * n - 2
    index = [k if k < n else period - k for k in range(period)]
    return sum(c[i] * pole**k for k, i in enumerate(index)) / (1 - pole**period)


def _cubic(t):
    t = np.abs(t)
    return np.where(t < 1, 2 / 3 - t * t * (1 - t / 2), np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


def spline_axis(image, where, axis: int, order: int = 3):
    """Values at coordinates where along an axis by a spline of order 0, 1 or 3, mirrored at the ends."""
    n = image.shape[axis]
    if order == 0:
        return np.take(image, np.clip(np.floor(where + 0.5).astype(int), 0, n - 1), axis=axis)
    c = spline_coefficients(image, axis) if order == 3 else image
    reach, kernel = (2, _cubic) if order == 3 else (1, triangle)
    base, out = np.floor(where).astype(int), 0.0
    for k in range(1 - reach, reach + 1):
        at = base + k
        period = max(1, 2 * (n - 1))
        at_in = np.mod(at, period)
        at_in = np.where(at_in < n, at_in, period - at_in)
        w = kernel(where - at)
        out = out + np.take(c, at_in, axis=axis) * w.reshape([-1 if a == axis else 1 for a in range(image.ndim)])
    return out


def zoom(image, shape, order: int = 3):
    """Spline zoom that maps first to first and last to last sample."""
    for axis, m in enumerate(shape):
        n, m = image.shape[axis], int(m)
        image = spline_axis(image, np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0), axis, order)
    return image


def rotate(image, angle: float, axes=(1, 2), order: int = 3):
    """Rotation by degrees in the plane of two axes about its centre; same shape, zeros outside."""
    if angle % 90 == 0 and image.shape[axes[0]] == image.shape[axes[1]]:
        return np.rot90(image, int(angle // 90) % 4, axes)
    a, b = axes
    moved = np.moveaxis(image, (a, b), (1, 2))
    h, w = moved.shape[1:]
    t = math.radians(angle)
    i, j = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    si, sj = math.cos(t) * i + math.sin(t) * j + (h - 1) / 2, -math.sin(t) * i + math.cos(t) * j + (w - 1) / 2
    inside = (si >= -1e-9) & (si <= h - 1 + 1e-9) & (sj >= -1e-9) & (sj <= w - 1 + 1e-9)
    c = spline_coefficients(spline_coefficients(moved, 1), 2) if order == 3 else moved
    reach, kernel = (2, _cubic) if order == 3 else (1, triangle)
    out, bi, bj = np.zeros(moved.shape), np.floor(si).astype(int), np.floor(sj).astype(int)
    mirror = lambda at, n: np.where((x := np.mod(at, max(1, 2 * (n - 1)))) < n, x, 2 * (n - 1) - x)
    for p in range(1 - reach, reach + 1):
        for q in range(1 - reach, reach + 1):
            out += c[:, mirror(bi + p, h), mirror(bj + q, w)] * (kernel(si - bi - p) * kernel(sj - bj - q))
    return np.moveaxis(np.where(inside, out, 0.0), (1, 2), (a, b))


def label(image, connectivity: int = 26):
    """Components of equal nonzero values: numbers from 1 in order of first voxel. Neighbours touch at a corner (26) or a face (6).

    For planes, 8 neighbours are those of 26 within the plane. Runs along the last axis are joined, so memory follows
    the number of runs, not of voxels.
    """
    image = np.asarray(image)
    if image.ndim == 2:
        return label(image[None], connectivity)[0]
    nz, ny, nx = image.shape
    if not image.size:
        return np.zeros(image.shape, int)
    flat = image.reshape(nz * ny, nx).astype(np.int64, copy=False)
    edge = np.ones((nz * ny, nx), bool)
    edge[:, 1:] = flat[:, 1:] != flat[:, :-1]
    begin = np.flatnonzero(edge)
    value, line, low = flat.ravel()[begin], begin // nx, begin % nx
    high = np.append(begin[1:], flat.size) - line * nx  # one past the run's last
    on = value != 0
    begin, value, line, low, high = begin[on], value[on], line[on], low[on], high[on]
    root = np.arange(len(begin))
    reach = 0 if connectivity == 6 else 1  # runs that touch at a corner are one apart
    z, y = line // ny, line % ny
    lines = [(0, 1), (1, 0)] + ([(1, -1), (1, 1)] if connectivity != 6 else [])
    place = line * (nx + 2) + 1  # runs in order of line and column, lines apart
    firsts, lasts = place + low, place + high - 1
    pairs = []
    for dz, dy in lines:
        inside = np.flatnonzero((z + dz < nz) & (y + dy >= 0) & (y + dy < ny))
        move = (dz * ny + dy) * (nx + 2)
        # the runs of the neighbouring line that overlap [low - reach, high - 1 + reach]
        a = np.searchsorted(lasts, firsts[inside] + move - reach)
        b = np.searchsorted(firsts, lasts[inside] + move + reach, "right")
        times = np.maximum(b - a, 0)
        i = np.repeat(inside, times)
        j = np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        same = value[i] == value[j]
        pairs.append(np.stack([i[same], j[same]]))
    edges = np.concatenate(pairs, axis=1)
    while edges.size:  # min-label hooking and pointer jumping
        a, b = root[edges[0]], root[edges[1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    number = np.unique(root, return_inverse=True)[1] + 1 if len(root) else root
    out = np.zeros(flat.size, np.int64)
    out[np.repeat(begin, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)] = np.repeat(number, high - low)
    return out.reshape(image.shape)


def largest_label(labels, background=None) -> int:
    """The most frequent label apart from the background, the smallest on ties; -999999 without any."""
    values, counts = np.unique(labels, return_counts=True)
    if background is not None:
        counts, values = counts[values != background], values[values != background]
    return int(values[counts.argmax()]) if len(values) else -999999


def disk(radius: int):
    i, j = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return i * i + j * j <= radius * radius


def erode(plane, radius: int):
    """Binary erosion by a disk; beyond the edge counts as one."""
    out = np.ones(plane.shape, bool)
    padded = np.pad(plane.astype(bool), radius, constant_values=True)
    h, w = plane.shape
    for i, j in np.argwhere(disk(radius)):
        out &= padded[i : i + h, j : j + w]
    return out


def lung_mask(image, radius: int = 2, threshold: float = -320.0):
    """Air inside the body: 1 in the largest pocket of air that doesn't reach the corner columns, eroded slice by slice."""
    tissue = (image > threshold).astype(int) + 1
    labels = label(tissue)
    corners = np.unique(labels[:, [0, 0, -1, -1], [0, -1, 0, -1]])
    tissue[np.isin(labels, corners)] = 2
    for plane in tissue:
        parts = label(plane - 1)
        plane[parts != largest_label(parts, 0)] = 1
    lungs = 2 - tissue
    labels = label(lungs)
    lungs[labels != largest_label(labels, 0)] = 0
    return np.stack([erode(plane, radius) for plane in lungs]).astype(float) if len(lungs) else lungs.astype(float)


def pad_for_patches(shape, patch, stride):
    """Padding (before, after) per axis so that strides fit; None where none is needed."""
    out = []
    for n, p, t in zip(shape, patch, stride, strict=True):
        over = (n - p + t) % t
        more = 0 if over == 0 else t - over
        out.append((more // 2, more - more // 2))
    return out if any(map(any, out)) else None


def box_view(image, patch, stride, padding: str = "edge"):
    """Boxes (grid z, y, x, then box z, y, x) as a view of the padded image."""
    pad = pad_for_patches(image.shape, patch, stride)
    if pad:
        image = np.pad(image, pad, mode=padding)
    return np.lib.stride_tricks.sliding_window_view(image, tuple(patch))[tuple(slice(None, None, t) for t in stride)]


def patches(image, patch, stride, padding: str = "edge"):
    """(number, z, y, x) of all boxes in z-major order."""
    return box_view(image, patch, stride, padding).reshape(-1, *patch)


class Assembly:
    """A volume made of boxes by number: overlaps are averaged and the padding is cut off."""

    def __init__(self, shape, patch, stride):
        self.shape, self.patch, self.stride = tuple(shape), tuple(patch), tuple(stride)
        self.pad = pad_for_patches(shape, patch, stride) or [(0, 0)] * 3
        full = [n + a + b for n, (a, b) in zip(self.shape, self.pad, strict=True)]
        self.grid = [(n - p) // t + 1 for n, p, t in zip(full, self.patch, self.stride, strict=True)]
        self.total = np.zeros(full)
        # a box covers a range on each axis, so the times are a product of three
        self.seen = np.zeros(self.grid, bool)

    def add(self, number: int, pixels) -> None:
        cell = np.unravel_index(number, self.grid)
        self.total[tuple(slice(c * t, c * t + p) for c, t, p in zip(cell, self.stride, self.patch, strict=True))] += pixels.reshape(self.patch)
        self.seen[cell] = True

    def image(self):
        if self.seen.all():
            times = []
            for n, g, p, t in zip(self.total.shape, self.grid, self.patch, self.stride, strict=True):
                one = np.zeros(n)
                for k in range(g):
                    one[k * t : k * t + p] += 1
                times.append(np.maximum(one, 1))
            self.total /= times[0][:, None, None]
            self.total /= times[1][:, None]
            self.total /= times[2]
        else:
            held = np.zeros(self.total.shape, np.int32)
            for cell in np.argwhere(self.seen):
                held[tuple(slice(c * t, c * t + p) for c, t, p in zip(cell, self.stride, self.patch, strict=True))] += 1
            self.total /= np.maximum(held, 1)
        return self.total[tuple(slice(a, a + n) for n, (a, _) in zip(self.shape, self.pad, strict=True))]


def assemble(boxes, stride, shape):
    """The inverse of patches."""
    whole = Assembly(shape, boxes.shape[1:], stride)
    for k, box in enumerate(boxes):
        whole.add(k, box)
    return whole.image()


def paint_boxes(shape, starts, sizes):
    """Ones in boxes (start, size), clipped."""
    out = np.zeros(shape)
    for a, g in zip(starts, sizes, strict=True):
        box = tuple(slice(max(0, int(s)), max(0, min(n, int(s) + int(k)))) for s, k, n in zip(a, g, shape, strict=True))
        out[box] = 1
    return out


def paint_ellipsoids(shape, centers, radii):
    """Ones strictly inside ellipsoids; an axis of radius zero makes an empty one."""
    out = np.zeros(shape)
    for c, r in zip(centers, radii, strict=True):
        if min(r) <= 0:
            continue
        low = [max(0, int(x - y)) for x, y in zip(c, r, strict=True)]
        high = [max(l, min(n, int(x + y + 1))) for x, y, n, l in zip(c, r, shape, low, strict=True)]
        grid = np.ogrid[tuple(slice(a, b) for a, b in zip(low, high, strict=True))]
        inside = sum(((g - x) / y) ** 2 for g, x, y in zip(grid, c, r, strict=True)) < 1
        out[tuple(slice(a, b) for a, b in zip(low, high, strict=True))][inside] = 1
    return out


def quantize(values, clusters: int = 256, rounds: int = 5, sample: int = 10_000, seed: int = 42):
    """Codes (-128..127) and centres by k-means from evenly spread centres, on up to sample values a round."""
    flat = np.asarray(values, float).ravel()
    if not len(flat):
        return np.zeros(0, np.int8), np.zeros(clusters)
    rng, centers = np.random.default_rng(seed), np.linspace(flat.min(), flat.max(), clusters)
    for _ in range(rounds):
        part = flat if len(flat) <= sample else flat[rng.integers(0, len(flat), sample)]
        near = np.searchsorted((centers[1:] + centers[:-1]) / 2, part)
        total, times = np.bincount(near, part, clusters), np.bincount(near, minlength=clusters)
        centers = np.sort(np.where(times > 0, total / np.maximum(times, 1), centers))
    return (np.searchsorted((centers[1:] + centers[:-1]) / 2, flat) - 128).astype(np.int8), centers
