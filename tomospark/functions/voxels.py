"""Volumes as flat arrays in rows: index arithmetic, the voxel view, and gathers along axes.

A volume column holds values in z, y, x order; shape is struct<z, y, x: int>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import AXES


def dim(axis: str, shape: str = "shape") -> Column:
    return F.col(f"{shape}.{axis}")


def to_voxels(df: DataFrame, value: str = "images", keys=("scan_id",), shape: str = "shape") -> DataFrame:
    """One row (keys, z, y, x, v) per voxel."""
    ny, nx = dim("y", shape), dim("x", shape)
    rows = df.select(*keys, shape, F.posexplode(value).alias("_p", "v"))
    at = lambda c: F.floor(c).cast("int")
    return rows.select(*keys, at(F.col("_p") / (ny * nx)).alias("z"), F.pmod(at(F.col("_p") / nx), ny).alias("y"), F.pmod(F.col("_p"), nx).alias("x"), "v")


def from_voxels(voxels: DataFrame, keys=("scan_id",), name: str = "images") -> DataFrame:
    """The inverse of to_voxels, for scans that fit a row."""
    packed = F.sort_array(F.collect_list(F.struct("z", "y", "x", "v")))
    shape = F.struct(*[(F.max(a) + 1).alias(a) for a in AXES])
    return voxels.groupBy(*keys).agg(shape.alias("shape"), F.transform(packed, lambda s: s["v"]).alias(name))


def span(n) -> Column:
    """0 .. n - 1, empty for n = 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def take(values: Column, shape: Column, zs: Column, ys: Column, xs: Column, fill=None) -> Column:
    """Gather: the array whose voxel (i, j, k) is that of (zs[i], ys[j], xs[k]); -1 gives fill.

    Crops, pads and flips are all of this form. It runs within the row: no shuffle, no Python.
    """
    ny, nx = shape["y"], shape["x"]

    def line(z, y):
        one = lambda x: F.get(values, (z * ny + y) * nx + x)
        if fill is None:
            return F.transform(xs, one)
        return F.transform(xs, lambda x: F.when((x < 0) | (y < 0) | (z < 0), F.lit(fill)).otherwise(one(x)))

    return F.flatten(F.transform(zs, lambda z: F.flatten(F.transform(ys, lambda y: line(z, y)))))


def source_index(n: Column, m, padding: str = "edge") -> Column:
    """For a centred crop or pad from n to m samples, the source of each output sample; -1 outside for constant."""
    m = m if isinstance(m, Column) else F.lit(int(m))
    over = n - m
    cut, pad = F.floor(over / 2).cast("int"), F.floor(-over / 2).cast("int")
    last = n - 1

    def source(i):
        raw = F.when(over >= 0, i + cut).otherwise(i - pad)
        if padding == "edge":
            return F.least(F.greatest(raw, F.lit(0)), last)
        if padding == "constant":
            return F.when((raw < 0) | (raw > last), F.lit(-1)).otherwise(raw)
        if padding == "reflect":
            folded = F.pmod(raw, F.greatest(2 * last, F.lit(1)))
            return F.when(last == 0, F.lit(0)).when(folded <= last, folded).otherwise(2 * last - folded)
        raise ValueError(f"unknown padding {padding}")

    return F.transform(span(m), source)
