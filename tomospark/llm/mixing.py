"""Mixing sources to target weights.

Tokens (words) are summed per source, each source gets a target, and its repetition rate is
target / size. A document is emitted floor(rate) times plus once more when a hash-seeded uniform
draw falls below the fraction of the rate.

The draw is a hash of the seed, doc_id, the text's MD5 and, for rows that agree in these and the source, their
number among each other. So it doesn't depend on partitions, and rows of null or equal doc_id draw apart.

Defined cases: null text has size 0; a null source is a source of its own and comes last in the
order of weights; sources of size 0 have target 0 and rate 0; rows that agree in doc_id, text and source
are numbered in any order (they differ in further columns at most), so as many of them are repeated in each
run; a null doc_id counts as the empty string; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, write_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 42


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    The order of sources is made by a range-partitioned sort; the table of partition sizes, at
    most one row per partition, gives each partition's first rank. The water level is found by
    resharing the excess over aggregates of one row, so nothing is gathered per source.
    """
    ordered = write_table(
        sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources"
    )
    parts = ordered.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition
    first = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    rank = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = ordered.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(first), "_part").withColumn("weight", weight)
    weighed = write_table(weighed.select("source", "source_size", "weight"), "weights")

    limit = F.col("source_size") * F.lit(float(cap))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    goal, level = share * total, 0.0
    while True:
        above = (F.lit(level) * F.col("weight")) > limit
        capped, free = weighed.agg(F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        rise = (goal - (capped or 0.0)) / free
        if rise <= level:
            break
        level = rise
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit))


def draw(doc_id, tag, number, seed: int):
    """Uniform in [0, 1) from the first 32 bits of md5(seed:doc_id:tag:number)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), tag, number.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


KEY = ("doc_id", "tag", "source")


def _same(a: str, b: str) -> list:
    return [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in KEY]


def twins(rows: DataFrame, again: DataFrame) -> DataFrame:
    """_of (a _row) and number (from 1) of the rows that agree with another in KEY; again: the keys (with underscores) of several rows.

    Rows are numbered within the partitions that wrote them (the upper bits of _row) and moved by the counts of the
    partitions before, so a group of any size is dealt to as many tasks as wrote it.
    """
    mine = rows.join(again, _same("", "_"), "left_semi").select("_row", F.shiftright("_row", 33).alias("_part"), *KEY)
    parts = mine.groupBy(*KEY, "_part").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*KEY).orderBy("_part")  # one row per writing partition
    before = write_table(parts.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("_part").alias("_p"), (F.sum("_n").over(by) - F.col("_n")).alias("_before")), "before")
    within = mine.withColumn("_nth", F.row_number().over(Window.partitionBy(*KEY, "_part").orderBy("_row")))
    met = within.join(before, [*_same("", "_"), F.col("_part") == F.col("_p")])
    return met.select(F.col("_row").alias("_of"), (F.col("_before") + F.col("_nth")).alias("number"))


def copies(docs: DataFrame, keep: list[str] | None = None, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """row (a struct of docs' columns, or those of keep), size, source_size, target and copies, per row of docs.

    Words are counted once, into a written table of sizes. With keep, which leaves the text out, that table is the result's
    source too; otherwise docs are, or, if some rows need numbers, a written table of numbered rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    base = [F.col("doc_id"), F.coalesce(F.md5("text"), F.lit("")).alias("tag"), F.col("source"), word_count(F.col("text")).alias("size")]
    number = F.monotonically_increasing_id().alias("_row")
    sized = write_table(docs.select(number, *([] if keep is None else [row]), *base), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap).select(F.col("source").alias("_source"), "source_size", "target")
    again = sized.groupBy(*KEY).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in KEY])
    again = write_table(again, "again")
    alone = again.isEmpty()
    rows = sized
    if keep is None:
        rows = docs.select(number, row, *base)
        rows = rows if alone else write_table(rows, "mix")
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    if alone:
        joined = joined.withColumn("number", F.lit(1))
    else:
        joined = joined.join(write_table(twins(rows.select("_row", *KEY), again), "twins"), F.col("_row") == F.col("_of"), "left")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(float(cap)))).otherwise(0.0)
    extra = (draw(F.col("doc_id"), F.col("tag"), F.coalesce("number", F.lit(1)), seed) < rate - F.floor(rate)).cast("long")
    return joined.select("row", "size", "source_size", "target", (F.floor(rate) + extra).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as it is taken."""
    rows = copies(docs, None, weights, share, cap, seed).where(F.col("copies") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes."""
    return copies(docs.select("doc_id", "text", "source"), ["doc_id"]).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
    )


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(md5(text), '') AS tag, row_number() OVER (PARTITION BY doc_id, text, source) AS number,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)})::INT + 1] AS weight FROM src),
filled AS (
  SELECT *, row_number() OVER w AS k,
    coalesce(sum(source_size * {CAP}::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM ranked WINDOW w AS (ORDER BY source_size * {CAP}::DOUBLE / weight, source)),
levels AS (
  SELECT k, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM src) - capped) / free AS level, source_size, weight FROM filled),
level AS (SELECT level FROM levels WHERE level * weight <= source_size * {CAP}::DOUBLE ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * coalesce((SELECT level FROM level), 'infinity'::DOUBLE), source_size * {CAP}::DOUBLE) AS target FROM ranked),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, {CAP}::DOUBLE) ELSE 0.0 END AS rate,
    ('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(s.doc_id::VARCHAR, ''), s.tag, s.number)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM rated
"""
