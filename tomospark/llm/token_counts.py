"""Token counts: an exact histogram of encoded lengths.

Documents are aggregated by encoded length; sums from each length upward answer totals, quantiles and
truncated totals for every context limit. Null text counts as empty (length 0); an empty table gives
an empty histogram; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, write_table
from .tokens import default_path, encoder

#: Lengths are summed within blocks of so many; a block's rows are bounded by this number.
BLOCK = 1024


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row (n_tokens) per document."""
    path = path or default_path()

    def count(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            for counts, _ in enc.slices(batch.column(0), ids=False):
                yield pa.RecordBatch.from_arrays([pa.array(counts)], ["n_tokens"])

    return docs.select("text").mapInArrow(released(count), "n_tokens long")


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per length that occurs, as context limit L = n_tokens:

    n_docs: documents of that length; docs_at_least: of that or more; docs_total, tokens_total: of all;
    tokens_in: of the documents of at most L; truncated_total: sum of min(length, L) over all
    documents; quantile: share of documents of at most L.
    """
    # written, as it is read twice below and texts are encoded once; one row per length
    counts = write_table(lengths(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = counts.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    # a block table has at most (longest text / BLOCK) rows
    up, everything = Window.orderBy(F.col("_block").desc()), Window.partitionBy()
    above = blocks.select(
        "_block",
        (F.sum("_d").over(up) - F.col("_d")).alias("_docs_above"), (F.sum("_t").over(up) - F.col("_t")).alias("_tokens_above"),
        F.sum("_d").over(everything).alias("docs_total"), F.sum("_t").over(everything).alias("tokens_total"),
    )
    here = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc())
    at_least = F.col("_docs_above") + F.sum("n_docs").over(here)
    tokens_at_least = F.col("_tokens_above") + F.sum("_tokens").over(here)
    more = at_least - F.col("n_docs")
    tokens_in = F.col("tokens_total") - tokens_at_least + F.col("_tokens")
    return counts.join(above, "_block").select(
        "n_tokens", "n_docs", at_least.alias("docs_at_least"), "docs_total", "tokens_total", tokens_in.alias("tokens_in"),
        (tokens_in + F.col("n_tokens") * more).alias("truncated_total"),
        ((F.col("docs_total") - more) / F.col("docs_total")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens, and tokens left when each document is cut to limit tokens."""
    return hist.agg(
        F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"),
        F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))).alias("kept"),
    )
