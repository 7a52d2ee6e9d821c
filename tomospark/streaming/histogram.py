"""A running histogram of findings over a stream of annotation tables.

Findings' voxel centres are stateless per row; the counts are a streaming aggregate, so a restart resumes from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import masks


def running_histogram(findings: DataFrame, scans: DataFrame, edges) -> DataFrame:
    """Streaming (bz, by, bx, n) of a stream of findings (scan_id, nodule_id, center, size) joined with stored scans."""
    return masks.histogram(findings, scans, edges)


def start(findings: DataFrame, scans: DataFrame, edges, path: str, checkpoint: str):
    """Write each trigger's whole histogram over path."""
    spark: SparkSession = findings.sparkSession

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = running_histogram(findings, scans, edges).writeStream.outputMode("complete").foreachBatch(save)
    return query.option("checkpointLocation", checkpoint).queryName(f"histogram-{abs(hash(path))}").start() if spark else None
