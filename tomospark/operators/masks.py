"""Masks from findings, findings from masks, and training targets.

Findings: scan_id, nodule_id, center and size (struct of mm). They meet their scan by scan_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.geometry import AXES, each, voxel_of, zyx
from ..functions.voxels import dim


def fetch_nodules(annotation: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings in mm (seriesuid, coordZ/Y/X, diameter_mm) of the scans at hand."""
    missing = {"seriesuid", "coordX", "coordY", "coordZ", "diameter_mm"} - set(annotation.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    own = annotation.join(scans.select(F.col("scan_id").alias("seriesuid")), "seriesuid", "left_semi")
    identity = F.col("NoduleID") if "NoduleID" in annotation.columns else F.sha2(F.concat_ws("|", "seriesuid", "coordZ", "coordY", "coordX"), 256)
    return own.select(F.col("seriesuid").alias("scan_id"), identity.alias("nodule_id"), zyx(*[F.col(f"coord{a}") for a in "ZYX"]).alias("center"), zyx(*[F.col("diameter_mm")] * 3).alias("size"))


def located(nodules: DataFrame, scans: DataFrame) -> DataFrame:
    """nodules with the shape, spacing and origin of their scans as they are now."""
    return nodules.join(scans.select("scan_id", "shape", "spacing", "origin"), "scan_id")


def nodules_table(nodules: DataFrame) -> DataFrame:
    """Flat columns nodule_id, source_id, locZ/Y/X and diamZ/Y/X."""
    flat = [F.col(f"{part}.{a}").alias(f"{name}{a.upper()}") for part, name in (("center", "loc"), ("size", "diam")) for a in AXES]
    return nodules.select("nodule_id", F.col("scan_id").alias("source_id"), *flat)


def rzyx(nodules: DataFrame, scans: DataFrame, scale: bool = True) -> DataFrame:
    """nodule_id, diameter (largest) and centre, in pixels if scale, else in mm."""
    rows = located(nodules, scans)
    at = lambda a: (F.col(f"center.{a}") - F.col(f"origin.{a}")) / F.col(f"spacing.{a}") if scale else F.col(f"center.{a}")
    size = lambda a: F.col(f"size.{a}") / F.col(f"spacing.{a}") if scale else F.col(f"size.{a}")
    return rows.select("nodule_id", F.greatest(*[size(a) for a in AXES]).alias("diam"), *[at(a).alias(a) for a in AXES])


def pixel_coords(nodules: DataFrame, scans: DataFrame) -> DataFrame:
    """nodule_id, rounded centre in pixels and the mean rounded diameter."""
    rows = located(nodules, scans)
    at = {a: F.rint((F.col(f"center.{a}") - F.col(f"origin.{a}")) / F.col(f"spacing.{a}")).cast("int") for a in AXES}
    size = sum(F.rint(F.ceil(F.col(f"size.{a}") / F.col(f"spacing.{a}"))) for a in AXES) / 3
    return rows.select("nodule_id", *[c.alias(a) for a, c in at.items()], F.rint(size).cast("int").alias("diameter"))


def inside(nodules: DataFrame, scans: DataFrame) -> DataFrame:
    """nodules whose box meets the scan; the centre is signed."""
    rows = located(nodules, scans)
    for a in AXES:
        g = F.col(f"size.{a}") / F.col(f"spacing.{a}")
        start = F.rint((F.col(f"center.{a}") - F.col(f"origin.{a}")) / F.col(f"spacing.{a}") - F.rint(g / 2))
        rows = rows.where(~((start >= dim(a)) | (start + F.rint(g) <= 0)))
    return rows.select(*nodules.columns)


def _held(rows: DataFrame, starts: dict, sizes: dict, shape: dict, more=()) -> DataFrame:
    """scan_id and _boxes: six numbers each of the different boxes (clipped start and size) of a scan, one after the other.

    rows have a finding each, starts and sizes are whole doubles. Boxes beyond the scan are left out, equal ones are
    met before a scan's are collected: a mask needs no box twice. more, if given, are six other columns to keep instead.
    """
    rows = rows.withColumns({f"_l{a}": F.greatest(starts[a], F.lit(0.0)) for a in AXES} | {f"_h{a}": F.least(starts[a] + sizes[a], shape[a].cast("double")) for a in AXES})
    for a in AXES:
        rows = rows.where(F.col(f"_l{a}") < F.col(f"_h{a}"))
    kept = more or [*(F.col(f"_l{a}") for a in AXES), *(F.col(f"_h{a}") - F.col(f"_l{a}") for a in AXES)]
    different = rows.select("scan_id", *[c.cast("int").alias(f"_{k}") for k, c in enumerate(kept)]).distinct()
    return different.groupBy("scan_id").agg(F.flatten(F.collect_list(F.array(*[f"_{k}" for k in range(6)]))).alias("_boxes"))


def _with_boxes(scans: DataFrame, held: DataFrame) -> DataFrame:
    return scans.join(held, "scan_id", "left").withColumn("_boxes", F.coalesce("_boxes", F.array().cast("array<int>")))


def create_mask(scans: DataFrame, nodules: DataFrame, mode: str = "rectangle", dst: str = "masks") -> DataFrame:
    """A mask of boxes or ellipsoids of the scan's findings; zeros for scans without any."""
    if mode not in ("rectangle", "ellipse"):
        raise ValueError(f"unknown mode {mode}")
    rows = located(nodules, scans)
    shape = {a: dim(a) for a in AXES}
    size = {a: F.col(f"size.{a}") / F.col(f"spacing.{a}") for a in AXES}
    at = {a: F.rint(voxel_of(F.col(f"center.{a}"), F.col(f"origin.{a}"), F.col(f"spacing.{a}"))) for a in AXES}
    radius = {a: F.rint(F.rint(size[a] / 2)) for a in AXES}
    start = {a: at[a] - radius[a] for a in AXES}
    if mode == "ellipse":
        rows = rows.where((radius["z"] > 0) & (radius["y"] > 0) & (radius["x"] > 0))
        held, paint = _held(rows, start, {a: 2 * radius[a] + 1 for a in AXES}, shape, [*at.values(), *radius.values()]), kernels.paint_ellipsoids
    else:
        held, paint = _held(rows, start, {a: F.rint(size[a]) for a in AXES}, shape), kernels.paint_boxes

    def painted(image, flat):
        parts = flat.reshape(-1, 6)
        return paint(image.shape, parts[:, :3].tolist(), parts[:, 3:].tolist())

    return _with_boxes(scans, held).withColumn(dst, kernels.per_row(painted)(F.col("images"), F.col("shape"), F.col("_boxes"))).drop("_boxes")


def fetch_mask(scans: DataFrame, nodules: DataFrame, shape) -> DataFrame:
    """scan_id, shape and masks: box masks at another resolution."""
    new = dict(zip(AXES, shape, strict=True))
    rows = located(nodules, scans)
    scale = lambda a: F.lit(float(new[a])) / dim(a)
    size = {a: scale(a) * F.col(f"size.{a}") / F.col(f"spacing.{a}") for a in AXES}
    start = {a: F.rint(voxel_of(F.col(f"center.{a}"), F.col(f"origin.{a}"), F.col(f"spacing.{a}")) * scale(a) - size[a] / 2) for a in AXES}
    held = _held(rows, start, {a: F.rint(size[a]) for a in AXES}, {a: F.lit(int(n)) for a, n in new.items()})
    one = zyx(F.lit(1), F.lit(1), F.lit(1))

    def painted(_, flat):
        parts = flat.reshape(-1, 6)
        return kernels.paint_boxes(tuple(shape), parts[:, :3].tolist(), parts[:, 3:].tolist())

    masks = kernels.per_row(painted)(F.array(F.lit(0.0)), one, F.col("_boxes"))
    return _with_boxes(scans.select("scan_id"), held).select("scan_id", zyx(*[F.lit(int(n)) for n in shape]).alias("shape"), masks.alias("masks"))


def box_of_prediction(predictions: DataFrame, shape, threshold: float = 0.5, dst: str = "masks") -> DataFrame:
    """A mask of the given shape from center, size (normalised to 0..1) and probability; zeros up to the threshold."""
    def edge(a, sign):
        side = F.col(f"center.{a}") + sign * F.col(f"size.{a}") / 2
        return F.rint(F.least(F.greatest(side, F.lit(0.0)), F.lit(1.0)) * dict(zip(AXES, shape, strict=True))[a]).cast("int")

    low, high = {a: edge(a, -1) for a in AXES}, {a: edge(a, 1) for a in AXES}
    ny, nx = shape[1], shape[2]
    held = F.struct(*[low[a].alias(f"l{a}") for a in AXES], *[high[a].alias(f"h{a}") for a in AXES], (F.col("probability") > threshold).alias("on"))

    def one(p, b):
        at = {"z": F.floor(p / (ny * nx)), "y": F.pmod(F.floor(p / nx), F.lit(ny)), "x": F.pmod(p, F.lit(nx))}
        inside_ = [(at[a] >= b[f"l{a}"]) & (at[a] < b[f"h{a}"]) for a in AXES]
        return F.when(b["on"] & inside_[0] & inside_[1] & inside_[2], 1.0).otherwise(0.0)

    n = shape[0] * ny * nx
    grid = F.flatten(F.transform(F.array(held), lambda b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: one(p, b))))
    return predictions.withColumn(dst, grid)


def nodules_from_mask(scans: DataFrame, src: str = "masks") -> DataFrame:
    """scan_id, nodule_id (component number), center and size: centroid, and the diameter of the ball of the component's volume, in mm.

    Components are voxels of equal value that touch, if only at a corner.
    """

    def regions(mask):
        import numpy as np

        labels = kernels.label(mask).ravel()
        at = np.flatnonzero(labels)
        of, n = labels[at], int(labels.max(initial=0)) + 1
        times = np.bincount(of, minlength=n)[1:]
        means = [np.bincount(of, c, n)[1:] / np.maximum(times, 1) for c in np.unravel_index(at, mask.shape)]
        return [[float(k + 1), *map(float, row)] for k, row in enumerate(zip(*means, times, strict=True))]

    held = scans.select("scan_id", "spacing", "origin", kernels.per_row(regions, "array<array<double>>")(F.col(src), F.col("shape")).alias("_r"))
    found = held.select("scan_id", "spacing", "origin", F.explode("_r").alias("r"))
    diameter = F.pow(6 * F.col("r")[4] / 3.141592653589793, F.lit(1 / 3))
    return found.select(
        "scan_id", F.col("r")[0].cast("int").alias("nodule_id"),
        zyx(*[F.col("r")[k + 1] * F.col(f"spacing.{a}") + F.col(f"origin.{a}") for k, a in enumerate(AXES)]).alias("center"),
        each(lambda a: diameter * F.col(f"spacing.{a}")).alias("size"),
    )


def classification_target(masks: Column, threshold: float = 10) -> Column:
    return (F.aggregate(masks, F.lit(0.0), lambda a, v: a + v) > threshold).cast("int")


def regression_targets(scans: DataFrame, nodules: DataFrame, threshold: float = 10) -> DataFrame:
    """scan_id, centre and size of the largest finding over spacing and shape (zeros without any), and the label."""
    largest = nodules.groupBy("scan_id").agg(F.min_by(F.struct("center", "size"), F.struct((-F.greatest(*[F.col(f"size.{a}") for a in AXES])).alias("s"), "nodule_id")).alias("n"))
    rows = scans.join(largest, "scan_id", "left")
    part = lambda name, a: F.coalesce(F.col(f"n.{name}.{a}") / F.col(f"spacing.{a}") / dim(a), F.lit(0.0))
    return rows.select("scan_id", *[part("center", a).alias(f"c_{a}") for a in AXES], *[part("size", a).alias(f"s_{a}") for a in AXES], classification_target(F.col("masks"), threshold).alias("label"))


def histogram(nodules: DataFrame, scans: DataFrame, edges) -> DataFrame:
    """bz, by, bx, n: counts of findings' voxel centres in bins of numpy's rule (the last one closed)."""
    rows = located(nodules, scans)
    bins = {}
    for a, e in zip(AXES, edges, strict=True):
        v = voxel_of(F.col(f"center.{a}"), F.col(f"origin.{a}"), F.col(f"spacing.{a}"))
        at = F.lit(None).cast("int")
        for k in range(len(e) - 2, -1, -1):
            upper = v <= float(e[k + 1]) if k == len(e) - 2 else v < float(e[k + 1])
            at = F.when((v >= float(e[k])) & upper, k).otherwise(at)
        bins[f"b{a}"] = at
    binned = rows.select(*[c.alias(n) for n, c in bins.items()]).dropna()
    return binned.groupBy(*bins).agg(F.count("*").alias("n"))


def add_histograms(*parts: DataFrame) -> DataFrame:
    """The sum of histograms."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("bz", "by", "bx").agg(F.sum("n").alias("n"))
