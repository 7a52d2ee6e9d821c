"""Annotation sources: nodule tables as CSV, and synthetic annotations of good, middling and bad doctors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import hex_name, uniform

NODULES_CSV = "seriesuid string, coordX double, coordY double, coordZ double, diameter_mm double"


def read_nodules_csv(spark: SparkSession, path: str, schema: str = NODULES_CSV) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def generate_annotation(spark: SparkSession, n_images: int, n_doctors: int = 10, bad_doctors=(), middle_doctors=(), seed: int = 42) -> DataFrame:
    """Annotations of 3 or 4 doctors an image with 0 to 3 findings: good doctors report all findings, middling ones half, bad ones invent theirs.

    A doctor without a finding has a row of nulls.
    """
    images = spark.range(n_images).withColumn("seriesuid", hex_name(20, seed, F.col("id")))
    count = 3 + F.floor(uniform(seed, "doctors", F.col("id")) * 2).cast("int")
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_doctors - 1)), lambda d: F.struct(uniform(seed, "rank", F.col("id"), d).alias("u"), d.alias("d"))))
    rows = images.select("id", "seriesuid", F.floor(uniform(seed, "findings", F.col("id")) * 4).cast("int").alias("n"), F.explode(F.slice(ranked, 1, count)).alias("s")).select("id", "seriesuid", "n", F.col("s.d").alias("doctor"))
    bad = F.col("doctor").isin(list(bad_doctors)) if bad_doctors else F.lit(False)
    middle = F.col("doctor").isin(list(middle_doctors)) if middle_doctors else F.lit(False)
    rows = rows.withColumn("k", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))))
    own = F.when(bad, F.col("doctor")).otherwise(F.lit(-1))
    seen = F.col("k").isNotNull() & ~(middle & (uniform(seed, "miss", F.col("id"), F.col("doctor"), F.col("k")) < 0.5))
    value = lambda name, low, high: F.when(seen, low + (high - low) * uniform(seed, name, F.col("id"), own, F.col("k")))
    made = rows.select(
        "seriesuid", F.lpad(F.col("doctor").cast("string"), 3, "0").alias("DoctorID"), F.when(seen, hex_name(20, seed, F.col("seriesuid"), F.col("doctor"), F.col("k"))).alias("NoduleID"),
        value("x", 20, 200).alias("coordX"), value("y", 20, 200).alias("coordY"), value("z", 20, 200).alias("coordZ"), value("d", 1, 14).alias("diameter_mm"),
    )
    return made.distinct()
