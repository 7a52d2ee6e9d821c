"""Losses and agreement measures as aggregate expressions over voxel rows, and per row for boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import AXES


def dice_loss(truth: Column, pred: Column, smooth: float = 1e-6) -> Column:
    return -(2 * F.sum(truth * pred) + smooth) / (F.sum(truth) + F.sum(pred) + smooth)


def tversky_loss(truth: Column, pred: Column, alpha: float = 0.3, beta: float = 0.7, smooth: float = 1e-10) -> Column:
    hit = F.sum(truth * pred) + smooth
    return -hit / (hit + alpha * F.sum(pred * (1 - truth)) + beta * F.sum((1 - pred) * truth))


def jaccard_loss(truth: Column, pred: Column, smooth: float = 1e-10) -> Column:
    hit = F.sum(truth * pred)
    return -F.ln((hit + smooth) / (F.sum(truth) + F.sum(pred) - hit + smooth) + smooth)


def log_loss(truth: Column, pred: Column, weight: float = 1.0) -> Column:
    """Mean of the logarithmic loss, true cases weighed."""
    return F.avg(-(weight * truth * F.ln(pred) + (1 - truth) * F.ln(1 - pred)))


def _values(name: str, part: str) -> list[Column]:
    return [F.col(f"{name}.{part}_{a}") for a in AXES]


def box_loss(true: str, pred: str, lambda_coords: float = 0.75) -> Column:
    """One row's loss of a box (struct c_z.. s_x, label): class, and for true ones centre and size."""
    square = lambda v: v * v
    centers = sum(0.5 * square(a - b) for a, b in zip(_values(true, "c"), _values(pred, "c"), strict=True))
    sizes = sum(0.5 * square(F.sqrt(a) - F.sqrt(b)) for a, b in zip(_values(true, "s"), _values(pred, "s"), strict=True))
    label = F.col(f"{true}.label")
    return 0.5 * square(label - F.col(f"{pred}.label")) + lambda_coords * label * (centers + sizes)


def box_iou(true: str, pred: str, epsilon: float = 1e-6) -> Column:
    """One row's overlap of boxes: per axis twice the lesser size where centres are nearer than sizes differ, else the clipped common part."""
    product = lambda v: v[0] * v[1] * v[2]
    parts = []
    for ct, cp, st, sp in zip(_values(true, "c"), _values(pred, "c"), _values(true, "s"), _values(pred, "s"), strict=True):
        apart = F.abs(ct - cp)
        parts.append(F.when(apart < F.abs(st - sp), 2 * F.least(st, sp)).otherwise(F.least(F.greatest(st + sp - apart, F.lit(0.0)), F.lit(1.0))))
    return product(parts) / (product(_values(true, "s")) + product(_values(pred, "s")) + epsilon)
