"""Line dedup by overlapping windows of three lines, with built-in functions only.

A text is cut at line feeds. Each run of three consecutive lines is hashed (two hashes, each of the lines'
own 64-bit hashes under another seed), windows that occur more than once anywhere are found, and of each only
the first occurrence stays: the lines that later occurrences cover are removed, the covered positions of a
row being merged. Rows are numbered in a written table, so each is a document of its own.

Occurrences are ordered by doc_id (null first), the MD5 of the text, and line; exactly repeated rows are
alike, so either may keep its lines.

Defined cases: null text stays null and texts of fewer than three lines stay as they are (they have
no window); empty lines are lines; windows may repeat within a document; rows of null or equal doc_id are
documents like any other, and of exactly repeated rows one keeps the lines that no other row has first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, write_table

LINES = 3


def numbered(docs: DataFrame) -> DataFrame:
    """docs with their columns in a struct, row, and _row, a number of the row; written, so that the numbers stay."""
    return write_table(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")


def windows(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """place (doc_id, MD5 of the text, row number, position from 0) and the window's two hashes."""
    hashes = lambda n: F.transform(F.split("row.text", "\n"), lambda x: F.xxhash64(F.lit(n), x)).alias(f"_h{n}")
    hashed = rows.select("_row", F.col("row.doc_id").alias("doc_id"), F.unhex(F.md5("row.text")).alias("tag"), hashes(1), hashes(2))
    # an empty array where there is no window: a filter would be pushed down and split the text again
    at = F.when(F.size("_h1") >= lines, F.sequence(F.lit(1), F.size("_h1") - lines + 1)).otherwise(F.array().cast("array<int>"))
    key = lambda i, n: F.xxhash64(*[F.element_at(f"_h{n}", i + k) for k in range(lines)])
    made = F.transform(at, lambda i: F.struct((i - 1).cast("int").alias("pos"), key(i, 1).alias("a"), key(i, 2).alias("b")))
    return hashed.select("doc_id", "tag", "_row", F.inline(made)).select(F.struct("doc_id", "tag", "_row", "pos").alias("place"), "a", "b")


def covered(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """_row and the sorted positions of the lines to remove, for rows that lose any."""
    found = windows(rows, lines)
    first = found.groupBy("a", "b").agg(F.min("place").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    # written, so that the join below deals both sides itself and a hot window can be split
    first = write_table(first.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("_first._row").alias("_of"), F.col("_first.pos").alias("_at")), "lines")
    found = found.select(F.col("place._row").alias("_row"), F.col("place.pos").alias("pos"), "a", "b")
    later = found.join(first, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).where((F.col("_row") != F.col("_of")) | (F.col("pos") != F.col("_at")))
    cover = F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + lines - 1)))
    return later.groupBy("_row").agg(F.array_sort(F.array_distinct(cover)).alias("_gone"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with their texts' remaining lines, and two last columns: n_lines and n_removed (with underscores before them if docs has such)."""
    rows = numbered(docs)
    gone = covered(rows, lines).withColumnRenamed("_row", "_of")
    joined = rows.join(gone, F.col("_row") == F.col("_of"), "left").withColumn("_parts", F.split("row.text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_gone")
    text = F.when(F.col("_gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_parts", i)), "\n"))
    counts = [F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(n) for c, n in zip(("_parts", "_gone"), fresh(docs, "n_lines", "n_removed"), strict=True)]
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], *counts)


def deduped(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text"))


LINES_SQL = """
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text)) AS rid FROM documents),
l AS (
  SELECT rid, i - 1 AS pos, parts[i] AS a, parts[i + 1] AS b, parts[i + 2] AS c
  FROM (SELECT rid, parts, unnest(range(1, len(parts) - 1)) AS i FROM d WHERE parts IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY rid, pos) AS n FROM l),
gone AS (SELECT DISTINCT rid, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE n > 1),
lines AS (
  SELECT rid, i - 1 AS pos, parts[i] AS line FROM (SELECT rid, parts, unnest(range(1, len(parts) + 1)) AS i FROM d WHERE parts IS NOT NULL)),
kept AS (
  SELECT l.rid, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text,
    count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed
  FROM lines l LEFT JOIN gone g ON l.rid = g.rid AND l.pos = g.pos GROUP BY l.rid)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN kept k ON d.rid = k.rid
"""
