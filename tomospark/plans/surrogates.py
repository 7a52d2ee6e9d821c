"""Scans, findings and annotations derived from general tables, in DataFrames and in SQL alike.

The same formulas on both sides let every operator be checked on tables of any size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import zyx
from ..shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table that a query writes and reads back: in the shared folder, or on this machine if all runs here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tomospark-")
    path = f"{base.rstrip('/')}/tomospark/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Added before rounding: many values end in an exact half of the last digit, which two engines' sums put on either side.
OFFSET = 3.17e-8


def r6(c: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c + F.lit(OFFSET), 6) + F.lit(0.0)


def q6(sql: str) -> str:
    return f"(round({sql} + {OFFSET}::DOUBLE, 6) + 0.0::DOUBLE)"


def nodules(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("seriesuid"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("NoduleID"),
        (F.col("l_suppkey") % 15).alias("DoctorID"), F.col("l_quantity").cast("double").alias("coordX"), (F.col("l_partkey") % 25).cast("double").alias("coordY"),
        (F.col("l_suppkey") % 25).cast("double").alias("coordZ"), (3 + F.col("l_partkey") % 28).cast("double").alias("diameter_mm"),
        (F.lit(0.5) + (F.col("l_suppkey") % 15).cast("double") / 30).alias("DoctorConfidence"),
    )


NODULES = """nodules AS (
  SELECT l_orderkey AS seriesuid, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS "NoduleID", l_suppkey % 15 AS "DoctorID",
    l_quantity::DOUBLE AS "coordX", (l_partkey % 25)::DOUBLE AS "coordY", (l_suppkey % 25)::DOUBLE AS "coordZ", (3 + l_partkey % 28)::DOUBLE AS diameter_mm,
    0.5::DOUBLE + (l_suppkey % 15)::DOUBLE / 30 AS "DoctorConfidence" FROM lineitem)"""


def scan_info(spark: SparkSession, folder: str, key: str = "o_orderkey") -> DataFrame:
    t = table(spark, folder, "orders")
    modulus = {"Z": 300, "Y": 200, "X": 100}
    wide = (F.lit(0.5) + (F.col("o_custkey") % 4).cast("double") / 4)
    return t.select(
        F.col(key).alias("seriesuid"), F.col("o_orderkey").alias("ScanID"), F.col("o_custkey").alias("PatientID"), (F.lit(0.5) + (F.col("o_orderkey") % 7).cast("double") / 2).alias("SpacingZ"),
        wide.alias("SpacingY"), wide.alias("SpacingX"), *[(-(F.col("o_custkey") % m)).cast("double").alias(f"Origin{a}") for a, m in modulus.items()],
    )


def info_sql(key: str = "o_orderkey") -> str:
    return f"""info AS (
  SELECT {key} AS seriesuid, o_orderkey AS "ScanID", o_custkey AS "PatientID", 0.5::DOUBLE + (o_orderkey % 7)::DOUBLE / 2 AS "SpacingZ",
    0.5::DOUBLE + (o_custkey % 4)::DOUBLE / 4 AS "SpacingY", 0.5::DOUBLE + (o_custkey % 4)::DOUBLE / 4 AS "SpacingX",
    (-(o_custkey % 300))::DOUBLE AS "OriginZ", (-(o_custkey % 200))::DOUBLE AS "OriginY", (-(o_custkey % 100))::DOUBLE AS "OriginX" FROM orders)"""


INFO = info_sql()
SIDE = 4


def scans(spark: SparkSession, folder: str, extra: bool = False) -> DataFrame:
    """4 x 4 x 4 volumes with masks, from 64 numbers a row."""
    t = table(spark, folder, "embeddings")
    label = F.col("label").cast("double")
    wide = F.lit(0.5) + (F.col("label") % 4).cast("double") / 4
    rows = t.select(
        F.col("vec_id").alias("scan_id"), zyx(F.lit(SIDE), F.lit(SIDE), F.lit(SIDE)).alias("shape"), zyx((1 + F.col("label") % 3).cast("double"), wide, wide).alias("spacing"),
        zyx(-10 * label, label, 2 * label).alias("origin"), F.transform("embedding", lambda v: v.cast("double") * 5000 - 300).alias("images"),
        F.transform("embedding", lambda v: F.when(v.cast("double") > 0.1, 1.0).otherwise(0.0)).alias("masks"),
        *([F.transform("embedding", lambda v: v.cast("double")).alias("raw"), F.col("label")] if extra else []),
    )
    return rows


VOXELS = """vox AS (
  SELECT vec_id AS scan_id, p::INT AS p, (p // 16)::INT AS z, ((p // 4) % 4)::INT AS y, (p % 4)::INT AS x, embedding[p + 1]::DOUBLE AS raw,
    embedding[p + 1]::DOUBLE * 5000 - 300 AS v, CASE WHEN embedding[p + 1]::DOUBLE > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m
  FROM embeddings, range(64) t(p))"""
SCANS = """scans AS (
  SELECT vec_id AS scan_id, label, (1 + label % 3)::DOUBLE AS sz, 0.5::DOUBLE + (label % 4)::DOUBLE / 4 AS sy, 0.5::DOUBLE + (label % 4)::DOUBLE / 4 AS sx,
    -10.0::DOUBLE * label AS oz, label::DOUBLE AS oy, 2.0::DOUBLE * label AS ox FROM embeddings)"""


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the volumes, in mm: every row of lineitem, dealt to the scans by the order's number."""
    t = table(spark, folder, "lineitem")
    held = scans(spark, folder, True).select("scan_id", "spacing", "origin")
    number = held.agg(F.count("*").alias("_scans"))  # one row
    at = {"z": F.col("l_quantity").cast("long") % 4, "y": F.col("l_partkey") % 4, "x": F.col("l_suppkey") % 4}
    rows = t.crossJoin(F.broadcast(number)).withColumn("scan_id", F.col("l_orderkey") % F.col("_scans")).join(held, "scan_id")
    size = (1 + F.col("l_partkey") % 3).cast("double")
    return rows.select(
        "scan_id", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("nodule_id"),
        zyx(*[F.col(f"origin.{a}") + F.col(f"spacing.{a}") * at[a] for a in "zyx"]).alias("center"), zyx(size, size, size).alias("size"),
    )


FINDINGS = SCANS + """, found AS (
  SELECT s.*, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS nodule_id, oz + sz * (l_quantity::BIGINT % 4) AS cz, oy + sy * (l_partkey % 4) AS cy,
    ox + sx * (l_suppkey % 4) AS cx, (1 + l_partkey % 3)::DOUBLE AS g FROM (SELECT *, l_orderkey % (SELECT count(*) FROM embeddings) AS of_scan FROM lineitem) JOIN scans s ON s.scan_id = of_scan)"""


def u_sql(*keys: str, seed: int = 42) -> str:
    """SQL of operators.sampling.uniform; keys are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted and true boxes (structs pred and true) of consecutive numbers."""
    t = table(spark, folder, "embeddings")
    at = lambda k: F.least(F.greatest(F.lit(0.5) + F.col("embedding")[k].cast("double"), F.lit(0.0)), F.lit(1.0))
    names = ["c_z", "c_y", "c_x", "s_z", "s_y", "s_x"]
    true = F.struct(*[at(k + 7).alias(n) for k, n in enumerate(names)], F.when(F.col("label") < 5, 1.0).otherwise(0.0).alias("label"))
    pred = F.struct(*[at(k).alias(n) for k, n in enumerate(names)], at(6).alias("label"))
    return t.select(F.col("vec_id").alias("scan_id"), true.alias("true"), pred.alias("pred"))


def _at(k: int) -> str:
    return f"least(greatest(0.5::DOUBLE + embedding[{k + 1}]::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)"


BOXES = "boxes AS (SELECT vec_id AS scan_id, " + ", ".join(f"{_at(k)} AS p{k}, {_at(k + 7)} AS t{k}" for k in range(6)) + f", {_at(6)} AS p6, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t6 FROM embeddings)"


def history(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    t = table(spark, folder, "events").withColumn("DoctorID", F.col("user_id") % 15)
    order = Window.partitionBy("DoctorID").orderBy("ts", "event_id")
    return t.select("DoctorID", F.row_number().over(order).alias("iteration"), (F.col("value") / 500).alias("confidence"))


HISTORY = """history AS (
  SELECT user_id % 15 AS "DoctorID", row_number() OVER (PARTITION BY user_id % 15 ORDER BY ts, event_id) AS iteration, value / 500 AS confidence FROM events)"""

OVERLAP = """CASE WHEN d >= d1 / 2 + d2 / 2 THEN 0.0::DOUBLE WHEN d1 / 2 >= d + d2 / 2 THEN CASE WHEN d1 / 2 > 5 * (d2 / 2) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
  WHEN d2 / 2 >= d + d1 / 2 THEN 1.0::DOUBLE ELSE 2 * (pi() * (d1 / 2 + d2 / 2 - d) * (d1 / 2 + d2 / 2 - d) * (d * d + d1 / 2 * (2 * d - 3 * (d1 / 2)) + d2 / 2 * (2 * d - 3 * (d2 / 2)) + 6 * (d1 / 2) * (d2 / 2))
  / (12 * d + 1e-6)) / (4.0 / 3 * pi() * (d1 / 2) ** 3 + 4.0 / 3 * pi() * (d2 / 2) ** 3 + 1e-6) END"""
