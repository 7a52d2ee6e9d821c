"""Scalar building blocks as Column expressions; nothing here runs Python on executors."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def zyx(z, y, x) -> Column:
    """struct<z, y, x> of three columns."""
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(a) for a, c in zip(AXES, (z, y, x), strict=True)])


def each(make) -> Column:
    """struct<z, y, x> whose fields are make(axis)."""
    return F.struct(*[make(a).alias(a) for a in AXES])


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def epanechnikov(u: Column) -> Column:
    return F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0)


def linear(source: tuple[float, float], target: tuple[float, float]):
    """The affine map that takes source's ends to target's, as a function on Columns."""
    slope = (target[1] - target[0]) / (source[1] - source[0])
    return lambda v: (v - source[0]) * slope + target[0]


def squared_distance(a, b, axes=("coordX", "coordY", "coordZ")) -> Column:
    return sum((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * (F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) for k in axes)


def quantile(proba: float) -> float:
    """The q with P(|N(0, 1)| <= q) = proba."""
    return NormalDist().inv_cdf((1 + proba) / 2)


def sigma_of_diameter(diameter: Column, proba: float = 0.8) -> Column:
    return diameter / (2 * quantile(proba))


def diameter_of_sigma(sigma: Column, proba: float = 0.8) -> Column:
    return sigma * (2 * quantile(proba))


def sphere_overlap(d1: Column, d2: Column, dist: Column) -> Column:
    """Twice the common volume of two balls over the sum of their volumes.

    0 when apart, 1 when one holds the other, but 0 when the first holds a second of under a fifth of its radius.
    """
    r1, r2 = d1 / 2, d2 / 2
    lens = (
        F.lit(math.pi) * (r1 + r2 - dist) * (r1 + r2 - dist)
        * (dist * dist + r1 * (2 * dist - 3 * r1) + r2 * (2 * dist - 3 * r2) + 6 * r1 * r2) / (12 * dist + 1e-6)
    )
    volume = lambda r: F.lit(4 / 3 * math.pi) * r * r * r
    return (
        F.when(dist >= r1 + r2, 0.0)
        .when(r1 >= dist + r2, F.when(r1 > 5 * r2, 0.0).otherwise(1.0))
        .when(r2 >= dist + r1, 1.0)
        .otherwise(2 * lens / (volume(r1) + volume(r2) + 1e-6))
    )


def voxel_of(center: Column, origin: Column, spacing: Column) -> Column:
    """Unsigned voxel coordinate of a point in mm."""
    return F.abs(center - origin) / spacing


def rint(v: Column) -> Column:
    """Half-even rounding."""
    return F.rint(v)


def fit_start(center, origin, spacing, crop: int, size) -> Column:
    """Start on one axis of a crop around a point, moved inside the scan; -1 if the crop is larger than the scan."""
    a = F.rint(voxel_of(center, origin, spacing)) - F.lit(float(round(crop / 2)))
    a = a - F.greatest(a + crop - size, F.lit(0.0))
    a = a + F.greatest(-a, F.lit(0.0))
    return F.when(size < crop, F.lit(-1)).otherwise(a.cast("int"))


def rescaled(spacing: Column, old: Column, new: Column) -> Column:
    return spacing * old / new
