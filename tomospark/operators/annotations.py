"""Annotation tables: parsing, typing, joins with scan information, pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grouped import dealt

#: The type codes' ordered rules (look-alike Latin and Cyrillic letters) and the header phrase of annotation files.
TYPE_RULES = (
    ("каверна", "c"),
    ("nan", "c"),
    ("g|ч|x", "п"),
    ("а|a|k|к|‘", "с"),
    ("v", "м"),
    ("^$", "c"),
    ("(?:n|п)(?:c|с)?", "semi_solid"),
    ("м", "ground_glass"),
    ("(?:c|с)(\\d|\\s.+)?", "solid"),
)
HEADER = "Оценки эксперта"
BASE_FIELDS = ("seriesuid", "StudyID", "DoctorID", "Comment", "NumNodules")
PLACE_FIELDS = ("locX", "locY", "locZ", "diam", "type")
MAX_NODULES = 40


def normalized_type(raw: Column) -> Column:
    """solid, semi_solid or ground_glass from a doctor's code."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), TYPE_RULES, F.lower(F.trim(raw)))


def read_annotation(spark: SparkSession, path, max_nodules: int = MAX_NODULES) -> DataFrame:
    """UTF-16 annotation files -> one row per estimate: the base fields, and places, an array of structs of strings.

    '-' and missing fields are null.
    """
    paths = [path] if isinstance(path, str) else list(path)
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-16"), "\r\n?", "\n"), HEADER, "")
    blocks = F.split(text, "\n\n\n")
    estimates = F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), lambda b: F.split(b, "\n")))
    rows = spark.read.format("binaryFile").load(paths).select(F.explode(estimates).alias("line")).select(F.split("line", "\t").alias("v"))
    field = lambda k: F.get("v", F.lit(k) if isinstance(k, int) else k)
    place = lambda i: F.struct(*[F.nullif(field(i * 5 + 5 + k), F.lit("-")).alias(n) for k, n in enumerate(PLACE_FIELDS)])
    places = F.transform(F.sequence(F.lit(0), F.lit(max_nodules - 1)), place)
    return rows.select(*[field(k).alias(n) for k, n in enumerate(BASE_FIELDS)], places.alias("places"))


def to_nodules(annotation: DataFrame) -> DataFrame:
    """One row per place with all coordinates and a diameter; the id is a digest of scan, doctor and position."""
    rows = annotation.select("seriesuid", F.regexp_replace("DoctorID", "'", "").alias("DoctorID"), F.posexplode("places").alias("no", "p"))
    number = lambda k: F.col(f"p.{k}").try_cast("double")
    long = rows.select(
        "seriesuid", "DoctorID", F.substring(F.sha2(F.concat_ws("|", "seriesuid", "DoctorID", F.col("no").cast("string"), F.to_json("p")), 256), 1, 20).alias("NoduleID"),
        normalized_type(F.coalesce("p.type", F.lit("nan"))).alias("NoduleType"),
        number("locX").alias("coordX"), number("locY").alias("coordY"), number("locZ").alias("coordZ"), number("diam").alias("diameter_mm"),
    )
    return long.dropna(subset=["coordX", "coordY", "coordZ", "diameter_mm"])


def annotators(annotation: DataFrame) -> DataFrame:
    """Distinct (seriesuid, DoctorID) of all estimates, those of doctors who found nothing included."""
    return annotation.where("seriesuid <> ''").select("seriesuid", F.regexp_replace("DoctorID", "'", "").alias("DoctorID")).distinct()


def annotators_pivot(pairs: DataFrame, doctors, prefix: str = "doctor_") -> DataFrame:
    """A row per scan with a 0/1 column per doctor.

    Rows are dealt by scan once, over as many tasks as the tables' size asks for; a scan's doctors are bits of one number for each 63.
    """
    doctors = list(doctors)
    kind = pairs.schema["DoctorID"].dataType
    rows = dealt(pairs.select("seriesuid", "DoctorID"), "seriesuid")
    bits = []
    for low in range(0, len(doctors), 63):
        # 0 for doctors of other numbers and for null
        place = F.coalesce(F.array_position(F.array(*[F.lit(x).cast(kind) for x in doctors[low : low + 63]]), F.col("DoctorID")), F.lit(0))
        bits.append(F.bit_or(F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"_{low // 63}"))
    wide = rows.groupBy("seriesuid").agg(*bits) if bits else rows.select("seriesuid").distinct()
    name = lambda d: f"{prefix}{int(d):03d}" if str(d).isdigit() else f"{prefix}{d}"
    return wide.select("seriesuid", *[F.getbit(f"_{k // 63}", F.lit(k % 63)).cast("int").alias(name(d)) for k, d in enumerate(doctors)])


def with_annotators(nodules: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodules and a row of nulls for each doctor who found none in a scan."""
    return nodules.join(pairs.select("seriesuid", "DoctorID").distinct(), ["seriesuid", "DoctorID"], "full_outer")


def best_spacing(info: DataFrame, key: str = "seriesuid", tie: str | None = None) -> DataFrame:
    """Per scan the row of least SpacingZ, the first by tie."""
    order = Window.partitionBy(key).orderBy("SpacingZ", *([tie] if tie else []))
    return info.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def to_millimetres(nodules: DataFrame, info: DataFrame, prefix: str = "coord") -> DataFrame:
    """Inner join with scan information; coordinates become coord * Spacing + Origin."""
    spots = info.select("seriesuid", *[f"{kind}{a}" for kind in ("Spacing", "Origin") for a in "XYZ"])
    joined = nodules.join(spots, "seriesuid", "inner")
    return joined.withColumns({f"{prefix}{a}": F.col(f"{prefix}{a}") * F.col(f"Spacing{a}") + F.col(f"Origin{a}") for a in "XYZ"})


def to_pixels(nodules: DataFrame, info: DataFrame, prefix: str = "coord") -> DataFrame:
    """The inverse: (coord - Origin) / Spacing."""
    spots = info.select("seriesuid", *[f"{kind}{a}" for kind in ("Spacing", "Origin") for a in "XYZ"])
    joined = nodules.join(spots, "seriesuid", "inner")
    return joined.withColumns({f"{prefix}{a}": (F.col(f"{prefix}{a}") - F.col(f"Origin{a}")) / F.col(f"Spacing{a}") for a in "XYZ"})


def transform_annotation(spark: SparkSession, paths, info: DataFrame, include_annotators: bool = True, drop: bool = True) -> DataFrame:
    """All annotation files -> nodules in mm, with the best-spaced series of each scan.

    drop False keeps nodules without scan information, in their own coordinates and with null Spacing and Origin.
    """
    annotation = read_annotation(spark, paths)
    nodules = to_nodules(annotation)
    if include_annotators:
        nodules = with_annotators(nodules, annotators(annotation))
    best = best_spacing(info)
    done = to_millimetres(nodules, best)
    return done if drop else done.unionByName(nodules.join(best.select("seriesuid"), "seriesuid", "left_anti"), allowMissingColumns=True)


def verification_counts(grouped: DataFrame) -> DataFrame:
    """(DoctorID, verifications, n): how many of a doctor's nodules lie in a group of so many."""
    counted = grouped.withColumn("verifications", F.count("*").over(Window.partitionBy("GroupNoduleID")))
    return counted.groupBy("DoctorID", "verifications").agg(F.count("*").alias("n"))
