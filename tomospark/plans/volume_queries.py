"""Queries over volumes: voxel rules, crops, windows, patches, masks, resampling, sampling, losses, flows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import fit_start, linear, zyx
from ..functions.kernels import spline_axis, spline_coefficients, weights
from ..functions.voxels import to_voxels
from ..operators import losses, masks, sampling, volumes
from ..sources import scans as files
from . import flow, flows
from .surrogates import BOXES, FINDINGS, SCANS, VOXELS, boxes, findings, nodules, q6, r6, scans, scratch, table, u_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def voxels(df: DataFrame, value: str = "images", shape: str = "shape") -> DataFrame:
    return to_voxels(df, value, shape=shape).withColumn("v", r6(F.col("v")))


def vox(select: str, where: str = "TRUE", z: str = "z", y: str = "y", x: str = "x", more: str = "") -> str:
    return f"WITH {VOXELS}{more} SELECT scan_id, ({z})::INT AS z, ({y})::INT AS y, ({x})::INT AS x, {q6(select)} AS v FROM vox WHERE {where}"


NORMALIZED = "least(greatest((v - -1000.0::DOUBLE) / 1400.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) * 255"


@query(vox(NORMALIZED))
def normalize_hu(spark, d):
    return voxels(volumes.normalize_hu(scans(spark, d)))


@query(vox("v", z="3 - z"))
def flip_z(spark, d):
    return voxels(volumes.flip(scans(spark, d)))


@query(vox("v", "z BETWEEN 0 AND 2 AND y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2", y="y - 1", x="x - 1"))
def central_crop(spark, d):
    """Sizes (3, 2, 2) of 4: starts rint(2) - ceil(3 / 2) = 0 and 2 - 1 = 1."""
    return voxels(volumes.central_crop(scans(spark, d), (3, 2, 2)))


@query(f"WITH {SCANS} SELECT scan_id, {q6('oz + sz * 2')} AS oz, {q6('oy + sy * 1')} AS oy, {q6('ox + sx * 1')} AS ox FROM scans")
def central_crop_origin(spark, d):
    done = volumes.central_crop(scans(spark, d), (3, 2, 2))
    return done.select("scan_id", *[r6(F.col(f"origin.{a}")).alias(f"o{a}") for a in "zyx"])


@query(f"WITH {VOXELS} SELECT scan_id, z AS number, y, x, {q6('v')} AS v FROM vox WHERE z = 2")
def axial_slice(spark, d):
    cut = volumes.axial_slice(scans(spark, d), 0.6)
    rows = cut.select("scan_id", "number", F.posexplode("pixels").alias("p", "v"))
    return rows.select("scan_id", "number", F.floor(F.col("p") / 4).cast("int").alias("y"), (F.col("p") % 4).alias("x"), r6(F.col("v")).alias("v"))


@query(f"""WITH {VOXELS}, lim AS (SELECT scan_id, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1)
SELECT scan_id, z, y, x, round_even(255 / (hi - lo) * v - 128 - 255 / (hi - lo) * lo, 0)::INT AS code FROM vox JOIN lim USING (scan_id)""")
def encode_i8_linear(spark, d):
    done = volumes.encode_linear(scans(spark, d))
    return to_voxels(done, "codes").select("scan_id", "z", "y", "x", F.col("v").cast("int").alias("code"))


@query(f"""WITH {VOXELS}, lim AS (SELECT scan_id, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1)
SELECT scan_id, z, y, x, {q6('(round_even(255 / (hi - lo) * v - 128 - 255 / (hi - lo) * lo, 0) + 128) * ((hi - lo) / 255) + lo')} AS v FROM vox JOIN lim USING (scan_id)""")
def decode_i8_linear(spark, d):
    return voxels(volumes.decode_linear(volumes.encode_linear(scans(spark, d))))


@query(vox("(v - -300.0::DOUBLE) * (1.0::DOUBLE / 700.0::DOUBLE) + 2"))
def linear_map(spark, d):
    rule = linear((-300.0, 400.0), (2.0, 3.0))
    return voxels(scans(spark, d).withColumn("images", F.transform("images", lambda v: rule(v))))


@query(vox("CASE WHEN m * v > 0.2::DOUBLE * 255 THEN 1.0 ELSE 0.0 END"))
def truncate_mask(spark, d):
    return voxels(volumes.truncate_mask(scans(spark, d)), "masks")


@query(vox("CASE WHEN m * 0.5::DOUBLE + raw > 0.35::DOUBLE THEN m * 0.5::DOUBLE + raw ELSE 0.0 END"))
def binarize_mask(spark, d):
    soft = scans(spark, d, True).withColumn("masks", F.zip_with("masks", "raw", lambda m, v: m * 0.5 + v))
    return voxels(volumes.binarize_mask(soft), "masks")


@query(f"WITH {VOXELS} SELECT scan_id, z, y, x, round_even((least(greatest(v, -500.0::DOUBLE), 500.0::DOUBLE) - -500.0::DOUBLE) / 1000.0::DOUBLE * 255, 0)::INT AS v FROM vox")
def trim_uint8(spark, d):
    return to_voxels(volumes.trim_uint8(scans(spark, d), (-500, 500)))


@query(f"""WITH {VOXELS}, lim AS (SELECT scan_id, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1)
SELECT scan_id, z, y, x, round_even((v - lo) / (hi - lo) * 255, 0)::INT AS v FROM vox JOIN lim USING (scan_id)""")
def trim_uint8_own_range(spark, d):
    return to_voxels(volumes.trim_uint8(scans(spark, d)))


@query(f"WITH {VOXELS} SELECT scan_id, p, {q6('v')} AS v FROM vox WHERE scan_id = 7")
def get_component(spark, d):
    return volumes.get(scans(spark, d), 7).select("scan_id", F.posexplode("images").alias("p", "v")).withColumn("v", r6(F.col("v")))


@query(f"WITH {VOXELS} SELECT scan_id, z, y, x, {q6('m')} AS v FROM vox")
def unpack_targets(spark, d):
    rows = volumes.unpack(scans(spark, d), "masks", True)
    for axis, column in (("z", "masks"), ("y", "plane"), ("x", "line")):
        rows = rows.select(*[c for c in rows.columns if c != column], F.posexplode(column).alias(axis, {"z": "plane", "y": "line", "x": "cell"}[axis]))
    return rows.select("scan_id", "z", "y", "x", r6(F.col("cell")[0]).alias("v"))


INSIDE = "z BETWEEN 1 AND 2 AND y BETWEEN 0 AND 1 AND x BETWEEN 2 AND 3"


@query(f"""WITH {VOXELS}, mean AS (SELECT scan_id, avg(v) AS a FROM vox GROUP BY 1)
SELECT scan_id, z, y, x, {q6(f'CASE WHEN {INSIDE} THEN a ELSE v END')} AS v FROM vox JOIN mean USING (scan_id)""")
def cutout_mean(spark, d):
    return voxels(volumes.cutout(scans(spark, d), (1, 0, 2), (2, 2, 5), "mean"))


@query(vox(f"CASE WHEN {INSIDE} THEN 7 ELSE v END"))
def cutout_value(spark, d):
    return voxels(volumes.cutout(scans(spark, d), (1, 0, 2), (2, 2, 5), 7))


@query(vox("v + raw * 100"))
def apply_noise_add(spark, d):
    return voxels(volumes.apply_noise(scans(spark, d, True), F.transform("raw", lambda v: v * 100)))


@query(vox("v * raw"))
def apply_noise_multiply(spark, d):
    return voxels(volumes.apply_noise(scans(spark, d, True), F.col("raw"), "*"))


@query(vox("v - raw"))
def apply_noise_subtract(spark, d):
    return voxels(volumes.apply_noise(scans(spark, d, True), F.col("raw"), "-"))


def _partners(df):
    ids = df.select("scan_id")
    return ids.select("scan_id", (F.when(F.col("scan_id") % 2 == 0, F.col("scan_id") + 1).otherwise(F.col("scan_id") - 1)).alias("partner_id"))


def _mix_sql(rule: str, value: str = "v") -> str:
    own = "SELECT *, scan_id * 64 + p AS k, (scan_id + 1 - 2 * (scan_id % 2)) * 64 + p AS other FROM vox"
    return f"WITH {VOXELS}, held AS MATERIALIZED ({own}) SELECT a.scan_id, a.z, a.y, a.x, {q6(rule)} AS v FROM held a JOIN held b ON b.k = a.other"


@query(_mix_sql("0.8::DOUBLE * a.v + (1 - 0.8::DOUBLE) * b.v"))
def mix_images_sum(spark, d):
    rows = scans(spark, d)
    return voxels(volumes.mix_images(rows, _partners(rows), 0.8, "sum"))


@query(_mix_sql("greatest(0.8::DOUBLE * a.v, (1 - 0.8::DOUBLE) * b.v) / 0.8::DOUBLE"))
def mix_images_max(spark, d):
    rows = scans(spark, d)
    return voxels(volumes.mix_images(rows, _partners(rows), 0.8, "max"))


@query(_mix_sql("greatest(a.m, b.m)"))
def mix_masks_max(spark, d):
    rows = scans(spark, d)
    return voxels(volumes.mix_images(rows, _partners(rows)), "masks")


@query(f"SELECT vec_id AS scan_id, p::INT AS p, 1.0::DOUBLE AS v FROM embeddings, range(24) t(p)")
def init_with_ones(spark, d):
    done = volumes.ones(scans(spark, d), (2, 3, 4))
    return done.select("scan_id", F.posexplode("images").alias("p", "v"))


# windows


def _xip_sql(aggregate: str, axis: str = "z", others: str = "y, x") -> str:
    names = [a.strip() for a in others.split(",")]
    return f"""WITH {VOXELS} SELECT a.scan_id, (a.{axis} // 1)::INT AS z, a.{names[0]} AS y, a.{names[1]} AS x, {q6(aggregate)} AS v FROM vox a JOIN vox b
  ON a.scan_id = b.scan_id AND a.{names[0]} = b.{names[0]} AND a.{names[1]} = b.{names[1]} AND b.{axis} BETWEEN a.{axis} AND a.{axis} + 1 WHERE a.{axis} <= 2 GROUP BY 1, 2, 3, 4"""


def _xip(mode, sql, projection="axial"):
    @query(sql)
    def run(spark, d):
        return voxels(volumes.xip(scans(spark, d), 2, mode, projection=projection))

    name = f"xip_{mode}" if projection == "axial" else f"xip_{mode}_{projection}"
    for held in (QUERIES, ORACLES):
        held[name] = held.pop("run")


for _mode, _sql in (("max", "max(b.v)"), ("min", "min(b.v)"), ("mean", "avg(b.v)"), ("median", "max(b.v)")):
    _xip(_mode, _xip_sql(_sql))
_xip("max", _xip_sql("max(b.v)", "y", "z, x"), "coronal")
_xip("min", _xip_sql("min(b.v)", "x", "z, y"), "sagital")


@query(f"""WITH {VOXELS}, w AS (SELECT a.scan_id, a.z, a.y, a.x, max(b.v) AS v FROM vox a JOIN vox b ON a.scan_id = b.scan_id AND a.y = b.y AND a.x = b.x AND b.z BETWEEN a.z AND a.z + 1 WHERE a.z <= 1 GROUP BY 1, 2, 3, 4)
SELECT scan_id, y, x, z AS channel, {q6('v')} AS v FROM w""")
def xip_channels(spark, d):
    """Three windows and groups of two channels: the last window is dropped."""
    done = volumes.xip(scans(spark, d), 2, "max", channels=2)
    rows = done.select("scan_id", F.posexplode("images").alias("p", "v"))
    return rows.select("scan_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.floor(F.col("p") / 2) % 4).cast("int").alias("x"), (F.col("p") % 2).alias("channel"), r6(F.col("v")).alias("v"))


@query(f"""WITH {VOXELS}, pad AS (SELECT scan_id, k - 1 AS z, y, x, v FROM vox, range(6) t(k) WHERE z = CASE WHEN k = 0 THEN 1 WHEN k = 5 THEN 2 ELSE k - 1 END)
SELECT a.scan_id, (a.z + 1)::INT AS z, a.y, a.x, {q6('avg(b.v)')} AS v FROM pad a JOIN pad b ON a.scan_id = b.scan_id AND a.y = b.y AND a.x = b.x AND b.z BETWEEN a.z AND a.z + 2 WHERE a.z <= 2 GROUP BY 1, 2, 3, 4""")
def make_xip(spark, d):
    """Depth 3 pads one slice, mirrored, on either side."""
    return voxels(volumes.make_xip(scans(spark, d), 3, 1, "mean"))


@query(vox("(CASE WHEN z <= 2 THEN (SELECT max(b.m) FROM vox b WHERE b.scan_id = vox.scan_id AND b.y = vox.y AND b.x = vox.x AND b.z BETWEEN vox.z AND vox.z + 1) ELSE 0 END"
           " + CASE WHEN z >= 1 THEN (SELECT max(b.m) FROM vox b WHERE b.scan_id = vox.scan_id AND b.y = vox.y AND b.x = vox.x AND b.z BETWEEN vox.z - 1 AND vox.z) ELSE 0 END)"))
def unxip(spark, d):
    """Windows of two slices of the masks, spread back by sum."""
    rows = scans(spark, d)
    stack = volumes.xip(rows.withColumn("images", F.col("masks")), 2, "max").select("scan_id", F.col("images").alias("stack"))
    return voxels(volumes.unxip(rows.join(stack, "scan_id"), "stack", 2, 1, adjust_nodule_size=False, dst="unfolded"), "unfolded")


# shapes and patches


def _source(out: str, padding: str, n: int = 4, m: int = 7) -> str:
    raw = f"({out} - {(m - n) // 2})"
    if padding == "edge":
        return f"least(greatest({raw}, 0), {n - 1})"
    if padding == "reflect":
        return f"(CASE WHEN abs({raw}) <= {n - 1} THEN abs({raw}) ELSE {2 * (n - 1)} - abs({raw}) END)"
    return raw


def _pad_sql(padding: str) -> str:
    """Pads z to 7, crops y to 3 (from 0), keeps x."""
    inside = "LEFT JOIN" if padding == "constant" else "JOIN"
    return f"""WITH {VOXELS} SELECT s.scan_id, o.k::INT AS z, c.j::INT AS y, e.i::INT AS x, {q6('coalesce(v.v, 0)')} AS v FROM (SELECT vec_id AS scan_id FROM embeddings) s CROSS JOIN range(7) o(k) CROSS JOIN range(3) c(j) CROSS JOIN range(4) e(i)
{inside} vox v ON v.scan_id = s.scan_id AND v.z = {_source('o.k', padding)} AND v.y = c.j AND v.x = e.i"""


def _pad(padding):
    @query(_pad_sql(padding))
    def run(spark, d):
        return voxels(volumes.to_shape(scans(spark, d), (7, 3, 4), padding))

    for held in (QUERIES, ORACLES):
        held[f"pad_to_shape_{padding}"] = held.pop("run")


for _p in ("edge", "reflect", "constant"):
    _pad(_p)

PATCHES = f"""{VOXELS}, boxes AS (SELECT v.scan_id, (pz * 9 + py * 3 + px)::INT AS patch_no, ((z - pz) * 4 + (y - py) * 2 + (x - px))::INT AS p, v.v FROM vox v, range(3) a(pz), range(3) b(py), range(3) c(px)
  WHERE z BETWEEN pz AND pz + 1 AND y BETWEEN py AND py + 1 AND x BETWEEN px AND px + 1)"""


@query(f"WITH {PATCHES} SELECT scan_id, patch_no, p, {q6('v')} AS v FROM boxes")
def patches(spark, d):
    cut = volumes.get_patches(scans(spark, d), (2, 2, 2), (1, 1, 1))
    return cut.select("scan_id", "patch_no", F.posexplode("pixels").alias("p", "v")).withColumn("v", r6(F.col("v")))


@query(f"""WITH {PATCHES}, scaled AS (SELECT scan_id, patch_no // 9 + p // 4 AS z, patch_no // 3 % 3 + p // 2 % 2 AS y, patch_no % 3 + p % 2 AS x, v * (1 + patch_no % 3) AS v FROM boxes)
SELECT scan_id, z::INT AS z, y::INT AS y, x::INT AS x, {q6('avg(v)')} AS v FROM scaled GROUP BY 1, 2, 3, 4""")
def assemble_patches(spark, d):
    cut = volumes.get_patches(scans(spark, d), (2, 2, 2), (1, 1, 1))
    scaled = cut.withColumn("pixels", F.transform("pixels", lambda v: v * (1 + F.col("patch_no") % 3)))
    return voxels(volumes.load_from_patches(scaled, (2, 2, 2), (1, 1, 1)))


@query(f"""WITH {PATCHES}, mean AS (SELECT scan_id, patch_no, avg(v) AS a FROM boxes GROUP BY 1, 2),
cover AS (SELECT v.scan_id, z, y, x, a FROM vox v JOIN mean m ON v.scan_id = m.scan_id AND z - m.patch_no // 9 BETWEEN 0 AND 1 AND y - m.patch_no // 3 % 3 BETWEEN 0 AND 1 AND x - m.patch_no % 3 BETWEEN 0 AND 1)
SELECT scan_id, z, y, x, {q6('avg(a)')} AS v FROM cover GROUP BY 1, 2, 3, 4""")
def predict_on_scan_mean(spark, d):
    return voxels(flow.predict_on_scan(scans(spark, d), lambda batch: batch.mean(axis=1), (1, 1, 1), (2, 2, 2), 4, "classification"), "masks")


# resampling


def _resize_sql(sizes, kind="linear") -> str:
    steps, current = f"WITH {VOXELS}, r0 AS (SELECT scan_id, z, y, x, v FROM vox)", "r0"
    for k, (axis, m) in enumerate(zip("zyx", sizes, strict=True)):
        made = spline_axis(np.eye(4), np.arange(m) * 3 / (m - 1), 0) if kind == "spline" else weights(4, m, kind)
        rows = ", ".join(f"({i}, {o}, {float(w)!r}::DOUBLE)" for o, line in enumerate(made) for i, w in enumerate(line) if w)
        keep = ", ".join(f"{a}" if a != axis else f"w.o AS {a}" for a in "zyx")
        group = ", ".join(a if a != axis else "w.o" for a in "zyx")
        steps += f", w{k}(i, o, w) AS (VALUES {rows}), r{k + 1} AS (SELECT scan_id, {keep}, sum(w.w * v) AS v FROM {current} JOIN w{k} w ON {current}.{axis} = w.i GROUP BY scan_id, {group})"
        current = f"r{k + 1}"
    return steps


@query(f"{_resize_sql((3, 5, 6))} SELECT scan_id, z::INT AS z, y::INT AS y, x::INT AS x, {q6('v')} AS v FROM r3")
def resize_linear(spark, d):
    return voxels(volumes.resize(scans(spark, d), (3, 5, 6)))


@query(f"{_resize_sql((3, 5, 6), 'lanczos')} SELECT scan_id, z::INT AS z, y::INT AS y, x::INT AS x, {q6('v')} AS v FROM r3")
def resize_lanczos(spark, d):
    return voxels(volumes.resize(scans(spark, d), (3, 5, 6), "lanczos"))


@query(f"WITH {SCANS} SELECT scan_id, {q6('sz * 4 / 3.0::DOUBLE')} AS sz, {q6('sy * 4 / 5.0::DOUBLE')} AS sy, {q6('sx * 4 / 6.0::DOUBLE')} AS sx FROM scans")
def resize_spacing(spark, d):
    done = volumes.resize(scans(spark, d).withColumn("images", F.lit(None).cast("array<double>")), (3, 5, 6))
    return done.select("scan_id", *[r6(F.col(f"spacing.{a}")).alias(f"s{a}") for a in "zyx"])


def _unify_sql() -> str:
    """Spacings are 1, 2, 3 and 0.5 .. 1.25; every size that occurs gets its weights, then a crop or edge pad to 4."""
    rows = ", ".join(f"({m}, {i}, {o}, {float(w)!r}::DOUBLE)" for m in (2, 3, 4, 5, 8, 12) for o, line in enumerate(weights(4, m)) for i, w in enumerate(line) if w)
    steps = f"WITH {VOXELS}, {SCANS}, w(m, i, o, w) AS (VALUES {rows}), n AS (SELECT scan_id, round_even(4 * sz, 0)::INT AS mz, round_even(4 * sy, 0)::INT AS my, round_even(4 * sx, 0)::INT AS mx FROM scans), r0 AS (SELECT scan_id, z, y, x, v FROM vox)"
    for k, axis in enumerate("zyx"):
        keep = ", ".join("t.k AS " + a if a == axis else "r." + a for a in "zyx")
        group = ", ".join("t.k" if a == axis else "r." + a for a in "zyx")
        m = f"n.m{axis}"
        source = f"CASE WHEN {m} >= 4 THEN t.k + ({m} - 4) // 2 ELSE least(greatest(t.k - (4 - {m}) // 2, 0), {m} - 1) END"
        steps += f", r{k + 1} AS (SELECT r.scan_id, {keep}, sum(w.w * r.v) AS v FROM r{k} r JOIN n USING (scan_id) CROSS JOIN range(4) t(k) JOIN w ON w.m = {m} AND w.i = r.{axis} AND w.o = {source} GROUP BY r.scan_id, {group})"
    return steps


@query(f"{_unify_sql()} SELECT scan_id, z::INT AS z, y::INT AS y, x::INT AS x, {q6('v')} AS v FROM r3")
def unify_spacing(spark, d):
    return voxels(volumes.unify_spacing(scans(spark, d), (1.0, 1.0, 1.0), (4, 4, 4)))


@query(f"""WITH {SCANS}, m AS (SELECT *, round_even(4 * sz, 0) AS mz, round_even(4 * sy, 0) AS my FROM scans)
SELECT scan_id, {q6('sz * 4 / mz')} AS sz, {q6('sy * 4 / my')} AS sy, {q6('oz + sz * 4 / mz * floor((mz - 4) / 2)')} AS oz, {q6('oy + sy * 4 / my * floor((my - 4) / 2)')} AS oy FROM m""")
def unify_spacing_geometry(spark, d):
    done = volumes.unify_spacing(scans(spark, d).withColumn("images", F.lit(None).cast("array<double>")), (1.0, 1.0, 1.0), (4, 4, 4))
    return done.select("scan_id", *[r6(F.col(f"{part}.{a}")).alias(f"{part[0]}{a}") for part in ("spacing", "origin") for a in "zy"])


@query(vox("v", y="3 - x", x="y"))
def rotate_90(spark, d):
    return voxels(volumes.rotate(scans(spark, d), 90, random=False))


def _rotate_sql(angle: float) -> str:
    """A cubic B-spline over 4 x 4 planes: prefiltered coefficients as two sums of weights, then 16 taps with mirrored ends."""
    rows = ", ".join(f"({i}, {o}, {float(w)!r}::DOUBLE)" for o, line in enumerate(spline_coefficients(np.eye(4), 0)) for i, w in enumerate(line))
    cubic = lambda t: f"CASE WHEN abs({t}) < 1 THEN 2.0::DOUBLE / 3 - ({t}) * ({t}) * (1 - abs({t}) / 2) WHEN abs({t}) < 2 THEN (2 - abs({t})) ** 3 / 6 ELSE 0 END"
    mirror = lambda t: f"CASE WHEN (({t}) % 6 + 6) % 6 < 4 THEN (({t}) % 6 + 6) % 6 ELSE 6 - (({t}) % 6 + 6) % 6 END"
    return f"""WITH {VOXELS}, w(i, o, w) AS (VALUES {rows}), c1 AS (SELECT scan_id, z, o AS y, x, sum(w * v) AS v FROM vox JOIN w ON y = i GROUP BY 1, 2, 3, 4),
c AS (SELECT scan_id, z, y, o AS x, sum(w * v) AS c FROM c1 JOIN w ON x = i GROUP BY 1, 2, 3, 4),
t AS (SELECT vec_id AS scan_id, radians({u_sql("'angle'", 'vec_id')} * {angle}::DOUBLE) AS t FROM embeddings),
spot AS (SELECT scan_id, y, x, cos(t) * (y - 1.5::DOUBLE) + sin(t) * (x - 1.5::DOUBLE) + 1.5::DOUBLE AS si, -sin(t) * (y - 1.5::DOUBLE) + cos(t) * (x - 1.5::DOUBLE) + 1.5::DOUBLE AS sj FROM t, range(4) a(y), range(4) b(x)),
tap AS (SELECT scan_id, y, x, si, sj, floor(si)::INT + p AS ti, floor(sj)::INT + q AS tj FROM spot, range(-1, 3) a(p), range(-1, 3) b(q)),
taps AS (SELECT scan_id, y, x, si BETWEEN -1e-9 AND 3 + 1e-9 AND sj BETWEEN -1e-9 AND 3 + 1e-9 AS inside, {mirror('ti')} AS cy, {mirror('tj')} AS cx, ({cubic('si - ti')}) * ({cubic('sj - tj')}) AS k FROM tap)
SELECT t.scan_id, c.z::INT AS z, t.y::INT AS y, t.x::INT AS x, {q6('CASE WHEN any_value(inside) THEN sum(k * c) ELSE 0 END')} AS v
FROM taps t JOIN c ON c.scan_id = t.scan_id AND c.y = t.cy AND c.x = t.cx GROUP BY 1, 2, 3, 4"""


@query(_rotate_sql(30))
def rotate_random(spark, d):
    return voxels(volumes.rotate(scans(spark, d), 30))


@query(f"{_resize_sql((3, 5, 6), 'spline')} SELECT scan_id, z::INT AS z, y::INT AS y, x::INT AS x, {q6('v')} AS v FROM r3")
def resize_spline(spark, d):
    return voxels(volumes.resize(scans(spark, d), (3, 5, 6), "spline"))


@query()
def segment_lungs(spark, d):
    return voxels(volumes.segment(scans(spark, d), 1))


@query()
def encode_i8_quantized(spark, d):
    return voxels(volumes.decode_quantized(volumes.encode_quantized(scans(spark, d))))


# findings and masks

BOX = ", ".join(f"round_even(abs(c{a} - o{a}) / s{a}, 0) AS ctr{a}, round_even(round_even(g / s{a} / 2, 0), 0) AS r{a}, round_even(g / s{a}, 0) AS n{a}" for a in "zyx")


@query(f"""WITH {VOXELS}, {FINDINGS}, b AS (SELECT scan_id, {BOX} FROM found)
SELECT scan_id, z, y, x, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.scan_id = vox.scan_id AND {' AND '.join(f'{a} >= ctr{a} - r{a} AND {a} < ctr{a} - r{a} + n{a}' for a in 'zyx')}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM vox""")
def rect_mask(spark, d):
    return to_voxels(masks.create_mask(scans(spark, d), findings(spark, d)), "masks")


@query(f"""WITH {VOXELS}, {FINDINGS}, b AS (SELECT scan_id, {BOX} FROM found)
SELECT scan_id, z, y, x, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.scan_id = vox.scan_id AND rz > 0 AND ry > 0 AND rx > 0
  AND ((z - ctrz) / rz) ** 2 + ((y - ctry) / ry) ** 2 + ((x - ctrx) / rx) ** 2 < 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM vox""")
def ellipse_mask(spark, d):
    return to_voxels(masks.create_mask(scans(spark, d), findings(spark, d), "ellipse"), "masks")


@query(f"""WITH {FINDINGS}, b AS (SELECT scan_id, {', '.join(f'round_even(abs(c{a} - o{a}) / s{a} * 2 - 2 * g / s{a} / 2, 0) AS b_{a}, round_even(2 * g / s{a}, 0) AS n{a}' for a in 'zyx')} FROM found)
SELECT s.scan_id, p::INT AS p, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.scan_id = s.scan_id AND p // 64 >= b_z AND p // 64 < b_z + nz AND p // 8 % 8 >= b_y AND p // 8 % 8 < b_y + ny AND p % 8 >= b_x AND p % 8 < b_x + nx) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v
FROM scans s, range(512) t(p)""")
def fetch_mask(spark, d):
    return masks.fetch_mask(scans(spark, d), findings(spark, d), (8, 8, 8)).select("scan_id", F.posexplode("masks").alias("p", "v"))


@query(f"WITH {VOXELS} SELECT scan_id, (sum(m) > 10)::INT AS label, sum(m) AS pixels FROM vox GROUP BY 1")
def mask_targets(spark, d):
    total = F.aggregate("masks", F.lit(0.0), lambda a, v: a + v)
    return scans(spark, d).select("scan_id", masks.classification_target(F.col("masks")).alias("label"), total.alias("pixels"))


@query(f"""WITH {VOXELS}, {FINDINGS}, top AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY g DESC, nodule_id) AS n FROM found), lab AS (SELECT scan_id, (sum(m) > 10)::INT AS label FROM vox GROUP BY 1)
SELECT s.scan_id, {', '.join(f"{q6(f'coalesce(t.c{a} / s.s{a} / 4, 0)')} AS c_{a}, {q6(f'coalesce(t.g / s.s{a} / 4, 0)')} AS s_{a}" for a in 'zyx')}, lab.label
FROM scans s JOIN lab USING (scan_id) LEFT JOIN top t ON t.scan_id = s.scan_id AND n = 1""")
def regression_targets(spark, d):
    done = masks.regression_targets(scans(spark, d), findings(spark, d))
    return done.select("scan_id", "label", *[r6(F.col(c)).alias(c) for c in done.columns if c not in ("scan_id", "label")])


@query(f"""WITH RECURSIVE {VOXELS}, {SCANS}, on_ AS (SELECT scan_id, p, z, y, x FROM vox WHERE m = 1),
reach AS (SELECT scan_id, p AS root, p, z, y, x FROM on_ UNION SELECT r.scan_id, r.root, o.p, o.z, o.y, o.x FROM reach r JOIN on_ o ON r.scan_id = o.scan_id AND abs(r.z - o.z) <= 1 AND abs(r.y - o.y) <= 1 AND abs(r.x - o.x) <= 1),
comp AS (SELECT scan_id, p, z, y, x, min(root) AS c FROM reach GROUP BY 1, 2, 3, 4, 5),
reg AS (SELECT scan_id, c, avg(z) AS az, avg(y) AS ay, avg(x) AS ax, count(*) AS n FROM comp GROUP BY 1, 2)
SELECT scan_id, {q6('az * sz + oz')} AS cz, {q6('ay * sy + oy')} AS cy, {q6('ax * sx + ox')} AS cx, {q6('(6 * n / pi()) ** (1.0 / 3) * sz')} AS gz FROM reg JOIN scans USING (scan_id)""")
def nodules_from_mask(spark, d):
    done = masks.nodules_from_mask(scans(spark, d))
    return done.select("scan_id", *[r6(F.col(f"center.{a}")).alias(f"c{a}") for a in "zyx"], r6(F.col("size.z")).alias("gz"))


@query(f"""WITH {FINDINGS}, a AS (SELECT nodule_id, {', '.join(f"round_even(abs(c{a} - o{a}) / s{a}, 0) - 1 AS a{a}" for a in 'zyx')} FROM found), u AS (SELECT nodule_id, {', '.join(f"a{a} - greatest(a{a} + 3 - 4, 0) AS a{a}" for a in 'zyx')} FROM a)
SELECT nodule_id, {', '.join(f"(a{a} + greatest(-a{a}, 0))::INT AS {a}" for a in 'zyx')} FROM u""".replace(" - 1 AS", " - 2 AS"))
def fit_into_bounds(spark, d):
    """Crops of three: rint(3 / 2) = 2."""
    rows = masks.located(findings(spark, d), scans(spark, d))
    start = [fit_start(F.col(f"center.{a}"), F.col(f"origin.{a}"), F.col(f"spacing.{a}"), 3, F.col(f"shape.{a}")).alias(a) for a in "zyx"]
    return rows.select("nodule_id", *start)


@query(f"""WITH {FINDINGS}, moved AS (SELECT *, {', '.join(f"round_even((c{a} + (l - 2) * 3 - o{a}) / s{a} - round_even(g / s{a} / 2, 0), 0) AS a{a}, round_even(g / s{a}, 0) AS n{a}" for a in 'zyx')} FROM (SELECT *, scan_id % 5 AS l FROM found))
SELECT nodule_id FROM moved WHERE NOT ({' OR '.join(f'a{a} >= 4 OR a{a} + n{a} <= 0' for a in 'zyx')})""")
def filter_nodules(spark, d):
    rows = findings(spark, d)
    moved = rows.withColumn("center", zyx(*[F.col(f"center.{a}") + (F.col("scan_id") % 5 - 2) * 3.0 for a in "zyx"]))
    return masks.inside(moved, scans(spark, d)).select("nodule_id")


EDGES = (0.0, 1.0, 2.0, 3.0)


@query(f"""WITH {FINDINGS}, c AS (SELECT {', '.join(f"CASE WHEN v{a} < 1 THEN 0 WHEN v{a} < 2 THEN 1 WHEN v{a} <= 3 THEN 2 END AS \"b{a}\"" for a in 'zyx')} FROM (SELECT {', '.join(f'abs(c{a} - o{a}) / s{a} AS v{a}' for a in 'zyx')} FROM found))
SELECT bz, "by", bx, count(*) AS n FROM c WHERE bz IS NOT NULL AND "by" IS NOT NULL AND bx IS NOT NULL GROUP BY 1, 2, 3""")
def nodule_histo(spark, d):
    return masks.histogram(findings(spark, d), scans(spark, d), (EDGES, EDGES, EDGES))


@query(f"WITH {FINDINGS} SELECT nodule_id, scan_id AS source_id, {', '.join(f'{q6(f'c{a}')} AS loc{a.upper()}, {q6('g')} AS diam{a.upper()}' for a in 'zyx')} FROM found")
def nodules_to_df(spark, d):
    done = masks.nodules_table(findings(spark, d))
    return done.select("nodule_id", "source_id", *[r6(F.col(c)).alias(c) for c in done.columns if c not in ("nodule_id", "source_id")])


@query(f"WITH {FINDINGS} SELECT nodule_id, {q6('greatest(g / sz, g / sy, g / sx)')} AS diam, {', '.join(f'{q6(f'(c{a} - o{a}) / s{a}')} AS {a}' for a in 'zyx')} FROM found")
def nodules_rzyx(spark, d):
    done = masks.rzyx(findings(spark, d), scans(spark, d))
    return done.select("nodule_id", *[r6(F.col(c)).alias(c) for c in ("diam", "z", "y", "x")])


@query(f"WITH {FINDINGS} SELECT nodule_id, {', '.join(f'round_even((c{a} - o{a}) / s{a}, 0)::INT AS {a}' for a in 'zyx')}, round_even((ceil(g / sz) + ceil(g / sy) + ceil(g / sx)) / 3, 0)::INT AS diameter FROM found")
def nodules_pixel_coords(spark, d):
    return masks.pixel_coords(findings(spark, d), scans(spark, d))


@query(f"WITH {FINDINGS} SELECT scan_id, count(*) AS num_nodules FROM found GROUP BY 1")
def num_nodules(spark, d):
    return findings(spark, d).groupBy("scan_id").agg(F.count("*").alias("num_nodules"))


REG = ", ".join(f"round_even(least(greatest(p{k} - p{k + 3} / 2, 0.0::DOUBLE), 1.0::DOUBLE) * 4, 0) AS l{a}, round_even(least(greatest(p{k} + p{k + 3} / 2, 0.0::DOUBLE), 1.0::DOUBLE) * 4, 0) AS h{a}" for k, a in enumerate("zyx"))


@query(f"""WITH {BOXES}, b AS (SELECT scan_id, p6, {REG} FROM boxes)
SELECT scan_id, p::INT AS p, CASE WHEN p6 > 0.5 AND p // 16 >= lz AND p // 16 < hz AND p // 4 % 4 >= ly AND p // 4 % 4 < hy AND p % 4 >= lx AND p % 4 < hx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM b, range(64) t(p)""")
def regression_mask(spark, d):
    rows = boxes(spark, d).select("scan_id", zyx(*[F.col(f"pred.c_{a}") for a in "zyx"]).alias("center"), zyx(*[F.col(f"pred.s_{a}") for a in "zyx"]).alias("size"), F.col("pred.label").alias("probability"))
    return masks.box_of_prediction(rows, (4, 4, 4)).select("scan_id", F.posexplode("masks").alias("p", "v"))


# sampling, batches, flows


@query(f"""WITH {VOXELS}, {FINDINGS}, a AS (SELECT nodule_id, scan_id, {', '.join(f"round_even(abs(c{a} - o{a}) / s{a}, 0) - 1 AS a{a}" for a in 'zyx')} FROM found),
u AS (SELECT nodule_id, scan_id, {', '.join(f"a{a} - greatest(a{a} + 2 - 4, 0) AS a{a}" for a in 'zyx')} FROM a), st AS (SELECT nodule_id, scan_id, {', '.join(f"(a{a} + greatest(-a{a}, 0))::INT AS b_{a}" for a in 'zyx')} FROM u)
SELECT nodule_id, (z - b_z)::INT AS z, (y - b_y)::INT AS y, (x - b_x)::INT AS x, {q6('v')} AS v FROM st JOIN vox USING (scan_id) WHERE z - b_z BETWEEN 0 AND 1 AND y - b_y BETWEEN 0 AND 1 AND x - b_x BETWEEN 0 AND 1""")
def all_cancer_crops(spark, d):
    rows = scans(spark, d)
    starts = sampling.sample_starts(rows, findings(spark, d), (2, 2, 2), None, 1.0)
    made = volumes.crops(rows, starts, (2, 2, 2), keep=("nodule_id",))
    return to_voxels(made, keys=("nodule_id",)).withColumn("v", r6(F.col("v")))


def _normal(a: str) -> str:
    """SQL of a normal draw of a finding on an axis."""
    u = lambda salt: u_sql(f"'{salt}'", f"'{a}'", "scan_id", "nodule_id")
    return f"sqrt(-2 * ln(1 - {u('u')})) * cos(6.283185307179586::DOUBLE * {u('v')})"


NUMBERED = "n AS (SELECT vec_id AS scan_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings)"


@query(f"""WITH {FINDINGS}, {NUMBERED}, chosen AS (SELECT *, row_number() OVER (ORDER BY {u_sql("'pick'", 'scan_id', 'nodule_id')}, nodule_id) AS n FROM found),
a AS (SELECT scan_id, nodule_id, {', '.join(f"round_even(abs(c{a} - o{a}) / s{a}, 0) - 1 + {_normal(a)} AS a{a}" for a in 'zyx')} FROM chosen WHERE n <= 16),
starts AS (SELECT concat_ws('_', scan_id, substr(sha256('42|' || nodule_id), 1, 8)) AS crop_id, scan_id, {', '.join(f"trunc(greatest(least(a{a}, 2), 0))::INT AS {a}" for a in 'zyx')} FROM a
  UNION ALL SELECT concat_ws('_', scan_id, substr(sha256('42|random|' || id), 1, 8)), scan_id, {', '.join(f"floor({u_sql(f"'{a}'", 'id')} * 3)::INT" for a in 'zyx')}
  FROM (SELECT i AS id, floor({u_sql("'scan'", 'i')} * (SELECT count(*) FROM embeddings))::BIGINT AS k FROM range(4) t(i)) JOIN n USING (k))
SELECT crop_id, st.scan_id, {', '.join(f'{q6(f"o{a} + s{a} * {a}")} AS o{a}' for a in 'zyx')} FROM starts st JOIN scans s USING (scan_id)""")
def sample_nodules(spark, d):
    made = sampling.sample_nodules(scans(spark, d), findings(spark, d), (2, 2, 2), 20, 0.8, (1, 1, 1))
    return made.select("crop_id", "scan_id", *[r6(F.col(f"origin.{a}")).alias(f"o{a}") for a in "zyx"])


def _first_ten(salt: int, where: str = "TRUE") -> str:
    return f"(SELECT scan_id, cancer FROM s WHERE {where} ORDER BY {u_sql(str(salt), 'scan_id', '0')}, scan_id LIMIT 10)"


@query(f"WITH {VOXELS}, s AS (SELECT scan_id, max(m) > 0 AS cancer FROM vox WHERE z <= 2 GROUP BY 1) SELECT scan_id, 0 AS slice_no, cancer FROM ({_first_ten(1, 'cancer')} UNION ALL {_first_ten(2)})")
def sample_xip(spark, d):
    """Windows of two slices, in groups of two: one slice per scan, of the first three."""
    return sampling.sample_xip(scans(spark, d), 2, 1, channels=2).select("scan_id", "slice_no", "cancer")


@query(f"""WITH {NUMBERED}, drawn AS (SELECT floor({u_sql("'scan'", 'i')} * (SELECT count(*) FROM embeddings))::BIGINT AS k, {u_sql("'bin'", 'i')} AS u, {', '.join(f"{u_sql(f"'in{a}'", 'i')} AS {a}" for a in 'zyx')} FROM range(500) t(i)),
b AS (SELECT *, CASE WHEN u < 0.1::DOUBLE THEN 0 WHEN u < 0.3::DOUBLE THEN 3 WHEN u < 0.6::DOUBLE THEN 6 ELSE 7 END AS bin FROM drawn)
SELECT scan_id, floor((bin // 4 * 2 + z * 2) * 2 / 4)::INT AS z, floor((bin // 2 % 2 * 2 + y * 2) * 2 / 4)::INT AS y, floor((bin % 2 * 2 + x * 2) * 2 / 4)::INT AS x FROM b JOIN n USING (k)""")
def sample_histogram(spark, d):
    histo = ([[[1, 0], [0, 2]], [[0, 0], [3, 4]]], ((0, 2, 4), (0, 2, 4), (0, 2, 4)))
    return sampling.random_starts(scans(spark, d), 500, (2, 2, 2), histo=histo).select("scan_id", "start.z", "start.y", "start.x")


@query(f"""WITH d AS (SELECT i AS id, 6.283185307179586::DOUBLE * {u_sql("'longitude'", 'i')} AS lon, 3.141592653589793::DOUBLE * ({u_sql("'latitude'", 'i')} - 0.5::DOUBLE) AS lat, 0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * {u_sql("'r'", 'i')} AS r FROM range(1000) t(i))
SELECT id, {q6('10 + 2 * r * cos(lat) * cos(lon)')} AS z, {q6('20 + 3 * r * cos(lat) * sin(lon)')} AS y, {q6('30 + 4 * r * sin(lat)')} AS x FROM d""")
def ellipsoid_region(spark, d):
    return sampling.ellipsoid_region(spark.range(1000), (10, 20, 30), (2, 3, 4)).select("id", *[r6(F.col(a)).alias(a) for a in "zyx"])


SPLIT = "('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT % 10"


@query(f"SELECT vec_id AS scan_id, CASE WHEN {SPLIT} < 7 THEN 'train' ELSE 'test' END AS part FROM embeddings")
def train_test_split(spark, d):
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("vec_id").cast("string"))), 1, 8), 16, 10).cast("long") % 10
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("scan_id"), F.when(bucket < 7, "train").otherwise("test").alias("part"))


@query("""WITH n AS (SELECT vec_id AS scan_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings), b AS (SELECT scan_id, k // 7 AS batch_no, k % 7 AS place, count(*) OVER (PARTITION BY k // 7) AS c FROM n)
SELECT scan_id, batch_no::INT AS batch_no, place::INT AS place FROM b WHERE c = 7""")
def batches_drop_last(spark, d):
    return sampling.batch_numbers(scans(spark, d).select("scan_id"), 7, "scan_id", True)


@query("""WITH a AS (SELECT vec_id AS scan_id, 0 AS part, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE label < 5), b AS (SELECT vec_id AS scan_id, 1 AS part, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE label >= 5),
u AS (SELECT *, k // 5 AS batch_no FROM a UNION ALL SELECT *, k // 3 FROM b), c AS (SELECT *, count(*) OVER (PARTITION BY part, batch_no) AS n FROM u),
f AS (SELECT * FROM c WHERE n = CASE WHEN part = 0 THEN 5 ELSE 3 END) SELECT scan_id, part, batch_no::INT AS batch_no FROM f WHERE batch_no IN (SELECT batch_no FROM f GROUP BY 1 HAVING count(DISTINCT part) = 2)""")
def combine_crops_merge(spark, d):
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("scan_id"), "label")
    return sampling.merge_by_batch(ids.where("label < 5").drop("label"), ids.where("label >= 5").drop("label"), (5, 3), "scan_id").select("scan_id", "part", "batch_no")


@query("SELECT a, b, c FROM (VALUES (1), (2)) x(a), (VALUES (10), (20), (30)) y(b), (VALUES (5), (7)) z(c)")
def cart_triples(spark, d):
    return sampling.triples([1, 2], [10, 20, 30], [5, 7], spark)


@query("SELECT vec_id AS scan_id, substr(sha256('42|' || vec_id::VARCHAR), 1, 8) AS name FROM embeddings")
def make_filename(spark, d):
    return scans(spark, d).select("scan_id", sampling.hex_name(8, 42, F.col("scan_id")).alias("name"))


@query("SELECT vec_id AS scan_id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= 20 THEN 0 ELSE 1 END AS part FROM embeddings")
def split_batch(spark, d):
    first, rest = sampling.split_batch(scans(spark, d).select("scan_id"), 20, "scan_id")
    return first.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)))


@query("SELECT vec_id AS scan_id, (row_number() OVER (ORDER BY CASE WHEN label < 5 THEN 0 ELSE 1 END, vec_id) - 1)::INT AS index FROM embeddings")
def concat_batches(spark, d):
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("scan_id"), "label")
    return sampling.concat(ids.where("label < 5"), None, ids.where("label >= 5"), order="scan_id").select("scan_id", "index")


@query(f"WITH {VOXELS} SELECT scan_id, z, y, x, {q6(NORMALIZED.replace('(v -', '(w -').replace('v - ', 'w - '))} AS v FROM (SELECT scan_id, (3 - z)::INT AS z, y, x, CASE WHEN z BETWEEN 2 AND 3 AND y <= 1 AND x <= 1 THEN 0 ELSE v END AS w FROM vox)")
def flow_chain(spark, d):
    """A lazy chain of three actions."""
    chain = flow.Flow().flip().cutout((0, 0, 0), (2, 2, 2), flow.L(lambda: 0)).normalize_hu()
    return voxels((chain << scans(spark, d)).run())


# scans at rest


@query(vox("v"))
def dump_and_load(spark, d):
    path = scratch(spark, "scans")
    files.dump(scans(spark, d), path)
    return voxels(files.load(spark, path))


@query(vox("m"))
def dump_and_load_masks(spark, d):
    """Components under other names."""
    path = scratch(spark, "scans")
    files.dump(scans(spark, d), path, components=["masks", "spacing"])
    return voxels(files.load(spark, path, components=["masks"], dst=["images"]))


@query(f"WITH {SCANS} SELECT vec_id AS \"ScanID\", {', '.join(f'{q6(f"s{a}")} AS \"Spacing{a.upper()}\", {q6(f"o{a}")} AS \"Origin{a.upper()}\"' for a in 'zyx')} FROM (SELECT *, scan_id AS vec_id FROM scans)")
def stored_scan_info(spark, d):
    path = scratch(spark, "scans")
    files.dump(scans(spark, d), path)
    info = files.read_info(spark, path, fmt="parquet")
    return info.select("ScanID", *[r6(F.col(f"{part}{a}")).alias(f"{part}{a}") for a in "ZYX" for part in ("Spacing", "Origin")])


@query("SELECT vec_id AS scan_id, label FROM embeddings WHERE label = (SELECT max(label) FROM embeddings)")
def subset_of_scans(spark, d):
    rows = scans(spark, d, True)
    ids = rows.join(F.broadcast(rows.agg(F.max("label").alias("_top"))), F.col("label") == F.col("_top"), "left_semi")
    return files.subset(rows, ids).select("scan_id", "label")


@query(f"WITH o AS (SELECT vec_id AS scan_id, {u_sql("'partner'", 'vec_id')} AS u FROM embeddings) SELECT scan_id, coalesce(lead(scan_id) OVER w, first_value(scan_id) OVER w) AS partner_id FROM o WINDOW w AS (ORDER BY u, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def mixing_partners(spark, d):
    return volumes.permutation(scans(spark, d).select("scan_id"))


@query("SELECT vec_id AS scan_id, row_number() OVER (ORDER BY CASE WHEN label < 5 THEN 0 ELSE 1 END, vec_id) <= 30 AS first FROM embeddings")
def merge_batches(spark, d):
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("scan_id"), "label")
    first, rest = sampling.merge(ids.where("label < 5"), None, ids.where("label >= 5"), batch_size=30, order="scan_id")
    return first.select("scan_id", F.lit(True).alias("first")).unionByName(rest.select("scan_id", F.lit(False).alias("first")))


@query(f"WITH {VOXELS} SELECT scan_id, {q6('sum(v)')} AS features, (sum(m) > 10)::INT::DOUBLE AS label FROM vox GROUP BY 1")
def training_classes(spark, d):
    made = flow.training_data(scans(spark, d), "classification")
    return made.select("scan_id", r6(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("features"), F.col("label")[0].alias("label"))


@query(f"WITH {VOXELS} SELECT scan_id, p, {q6('v')} AS image, m AS mask FROM vox WHERE z = 2")
def masked_slice(spark, d):
    cut = volumes.axial_slice(scans(spark, d), 0.5, mask="masks")
    rows = cut.select("scan_id", F.posexplode(F.arrays_zip("pixels", "mask")).alias("p", "r"))
    return rows.select("scan_id", (F.col("p") + 32).alias("p"), r6(F.col("r.pixels")).alias("image"), F.col("r.mask").alias("mask"))


# canned flows on small scans

SMALL = flows.Settings(spacing=(1.0, 1.0, 1.0), shape=(4, 4, 4), method="linear", padding="edge", crop=(2, 2, 2), variance=(1, 1, 1), rounds=1, random_per_run=6)


def _annotation(spark, d):
    rows = findings(spark, d)
    return rows.select(F.col("scan_id").alias("seriesuid"), F.col("nodule_id").alias("NoduleID"), *[F.col(f"center.{a}").alias(f"coord{a.upper()}") for a in "zyx"], F.col("size.z").alias("diameter_mm"))


UNIFIED = "even AS (SELECT scan_id, " + ", ".join(f"s{a} * 4 / round_even(4 * s{a}, 0) AS t{a}, o{a} + s{a} * 4 / round_even(4 * s{a}, 0) * floor((round_even(4 * s{a}, 0) - 4) / 2) AS p{a}" for a in "zyx") + " FROM scans)"


@query(f"""WITH {FINDINGS}, {UNIFIED}, c AS (SELECT {', '.join(f"CASE WHEN v{a} < 1 THEN 0 WHEN v{a} < 2 THEN 1 WHEN v{a} <= 3 THEN 2 END AS \"b{a}\"" for a in 'zyx')}
  FROM (SELECT {', '.join(f'abs(c{a} - p{a}) / t{a} AS v{a}' for a in 'zyx')} FROM found JOIN even USING (scan_id)))
SELECT bz, "by", bx, 2 * count(*) AS n FROM c WHERE bz IS NOT NULL AND "by" IS NOT NULL AND bx IS NOT NULL GROUP BY 1, 2, 3""")
def histogram_flow(spark, d):
    """Two passes over the same findings."""
    rows, table_ = scans(spark, d), _annotation(spark, d)
    once = flows.update_histo(rows, table_, None, (EDGES, EDGES, EDGES), SMALL)
    return flows.update_histo(rows, table_, once, (EDGES, EDGES, EDGES), SMALL)


@query(f"""WITH {FINDINGS}, runs AS (SELECT vec_id AS scan_id, (row_number() OVER (ORDER BY vec_id) - 1) // 8 AS run FROM embeddings),
n AS (SELECT run, count(nodule_id) AS n FROM runs LEFT JOIN found USING (scan_id) GROUP BY 1)
SELECT run::INT AS run, least(10, n) AS cancer, 20 - least(10, n) AS others FROM n""")
def crops_flow(spark, d):
    """A batch for each run of eight scans, half of it around findings."""
    made = flows.get_crops(scans(spark, d).drop("masks"), _annotation(spark, d), 20, 0.5, settings=SMALL)
    starts = made.select("run", F.size(F.split("crop_id", "_")).alias("n"), "crop_id", "scan_id")
    own = _annotation(spark, d).select(F.concat_ws("_", F.col("seriesuid").cast("string"), sampling.hex_name(8, 42, F.col("NoduleID"))).alias("crop_id"), F.lit(1).alias("own"))
    held = starts.join(own.distinct(), "crop_id", "left")
    return held.groupBy("run").agg(F.count("own").alias("cancer"), F.sum(F.when(F.col("own").isNull(), 1).otherwise(0)).alias("others"))


@query("SELECT (SELECT count(*) FROM lineitem) AS cancer, 6 * ceil((SELECT count(*) FROM embeddings) / 8)::BIGINT AS others")
def split_dump_flow(spark, d):
    """Crops around all findings and random ones, written as two tables and read back."""
    paths = [scratch(spark, name) for name in ("cancer", "others")]
    flows.split_dump(scans(spark, d).drop("masks"), _annotation(spark, d), *paths, settings=SMALL)
    cancer, others = (files.load(spark, path, components=["images", "masks"]).agg(F.count("*").alias("n")) for path in paths)
    return cancer.select(F.col("n").alias("cancer")).crossJoin(others.select(F.col("n").alias("others")))


@query(f"""WITH {VOXELS}, s AS (SELECT scan_id, sum({NORMALIZED}) AS v FROM vox GROUP BY 1),
u AS (SELECT vec_id AS scan_id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS part, row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) - 1 AS k FROM embeddings),
b AS (SELECT *, k // CASE WHEN part = 0 THEN 5 ELSE 3 END AS batch_no FROM u), c AS (SELECT *, count(*) OVER (PARTITION BY part, batch_no) AS n FROM b),
f AS (SELECT * FROM c WHERE n = CASE WHEN part = 0 THEN 5 ELSE 3 END)
SELECT scan_id, part, batch_no::INT AS batch_no, {q6('v')} AS v FROM f JOIN s USING (scan_id) WHERE batch_no IN (SELECT batch_no FROM f GROUP BY 1 HAVING count(DISTINCT part) = 2)""")
def combine_crops_flow(spark, d):
    rows = scans(spark, d, True)
    sides = [rows.where(where).drop("label", "raw") for where in ("label < 5", "label >= 5")]
    made = flows.combine_crops(*sides, batch_sizes=(5, 3), shuffle=None)
    return made.select("scan_id", "part", "batch_no", r6(F.aggregate("images", F.lit(0.0), lambda a, v: a + v)).alias("v"))


# losses


def _loss(name, sql, make):
    @query(f"WITH {VOXELS}, t AS (SELECT scan_id, m AS t, least(greatest(0.5::DOUBLE + raw, 0.0::DOUBLE), 1.0::DOUBLE) AS p FROM vox) SELECT scan_id, {q6(sql)} AS loss FROM t GROUP BY 1")
    def run(spark, d):
        rows = scans(spark, d, True).select("scan_id", F.explode(F.arrays_zip("masks", "raw")).alias("r"))
        rows = rows.select("scan_id", F.col("r.masks").alias("t"), F.least(F.greatest(F.lit(0.5) + F.col("r.raw"), F.lit(0.0)), F.lit(1.0)).alias("p"))
        return rows.groupBy("scan_id").agg(r6(make(F.col("t"), F.col("p"))).alias("loss"))

    for held in (QUERIES, ORACLES):
        held[name] = held.pop("run")


_loss("dice_loss", "-(2 * sum(t * p) + 1e-6::DOUBLE) / (sum(t) + sum(p) + 1e-6::DOUBLE)", losses.dice_loss)
_loss("tversky_loss", "-(sum(t * p) + 1e-10::DOUBLE) / (sum(t * p) + 1e-10::DOUBLE + 0.3::DOUBLE * sum(p * (1 - t)) + 0.7::DOUBLE * sum((1 - p) * t))", losses.tversky_loss)
_loss("jaccard_loss", "-ln((sum(t * p) + 1e-10::DOUBLE) / (sum(t) + sum(p) - sum(t * p) + 1e-10::DOUBLE) + 1e-10::DOUBLE)", losses.jaccard_loss)
_loss("weighted_log_loss", "avg(-(2 * t * ln(p * 0.9::DOUBLE + 0.05::DOUBLE) + (1 - t) * ln(1 - (p * 0.9::DOUBLE + 0.05::DOUBLE))))", lambda t, p: losses.log_loss(t, p * 0.9 + 0.05, 2.0))


@query(f"""WITH {BOXES} SELECT {q6("avg(0.5 * (t6 - p6) ** 2 + 0.75 * t6 * (0.5 * ((t0 - p0) ** 2 + (t1 - p1) ** 2 + (t2 - p2) ** 2) + 0.5 * ((sqrt(t3) - sqrt(p3)) ** 2 + (sqrt(t4) - sqrt(p4)) ** 2 + (sqrt(t5) - sqrt(p5)) ** 2)))")} AS loss FROM boxes""")
def reg_l2_loss(spark, d):
    return boxes(spark, d).agg(r6(F.avg(losses.box_loss("true", "pred"))).alias("loss"))


IOU = " * ".join(f"(CASE WHEN abs(t{k} - p{k}) < abs(t{k + 3} - p{k + 3}) THEN 2 * least(t{k + 3}, p{k + 3}) ELSE least(greatest(t{k + 3} + p{k + 3} - abs(t{k} - p{k}), 0.0::DOUBLE), 1.0::DOUBLE) END)" for k in range(3))


@query(f"WITH {BOXES} SELECT scan_id, {q6(f'{IOU} / (t3 * t4 * t5 + p3 * p4 * p5 + 1e-6::DOUBLE)')} AS iou FROM boxes")
def iou_3d(spark, d):
    return boxes(spark, d).select("scan_id", r6(losses.box_iou("true", "pred")).alias("iou"))


@query(f"WITH {VOXELS} SELECT scan_id, {q6('(2 * sum(m * n) + 1e-6::DOUBLE) / (sum(m + n) + 1e-6::DOUBLE)')} AS dice FROM (SELECT scan_id, m, CASE WHEN raw > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS n FROM vox) GROUP BY 1")
def dice_masks(spark, d):
    from ..operators.confidence import dice

    rows = scans(spark, d, True).select("scan_id", F.explode(F.zip_with("masks", "raw", lambda m, v: F.struct(m.alias("m"), F.when(v > 0.05, 1.0).otherwise(0.0).alias("n")))).alias("r"))
    return rows.groupBy("scan_id").agg(r6(dice(F.sum(F.col("r.m") * F.col("r.n")), F.sum(F.col("r.m") + F.col("r.n")))).alias("dice"))


@query("""WITH c AS (SELECT l_orderkey % 50 AS source, l_partkey % 7 AS label, count(*) AS n FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, label) AS k FROM c) SELECT source, label FROM r WHERE k = 1""")
def largest_label(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("source"), (F.col("l_partkey") % 7).alias("label")).where("label <> 0")
    counts = t.groupBy("source", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"))
