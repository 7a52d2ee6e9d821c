"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None
#: Paths that write_table made, for each settled() under way.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which executors and driver share.

    Only where it is unset and all runs on one machine (as in tests) an own folder is made.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tomospark-")
    return _own_dir


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()), hadoop_path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The folder is deleted with the end of the settled() around it, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tomospark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, hadoop_path = _file_system(spark, path)
    files.deleteOnExit(hadoop_path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make, name: str) -> DataFrame:
    """The written table of make(); all tables that were written on the way are deleted."""
    _open.append([])
    spark = None
    try:
        df = make()
        spark = df.sparkSession
        out = write_table(df, name)
        kept = _open[-1].pop()
    finally:
        paths = _open.pop()
        if spark is not None:
            for path in paths:
                files, hadoop_path = _file_system(spark, path)
                files.delete(hadoop_path, True)
    if _open:
        _open[-1].append(kept)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of write_table that no later plan reads."""
    for file in df.inputFiles()[:1]:
        files, path = _file_system(df.sparkSession, file)
        files.delete(path.getParent(), True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the machine, as reused workers live long."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(rows):
    """A function of batches that ends with release()."""

    def run(batches):
        yield from rows(batches)
        release()

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front of those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of WORD matches, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shingles(text: str | None, size: int, seed: int):
    """XXH64 values of each run of size words of the lower-cased text, or of all its words if they are fewer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    spans = zip(starts, ends[size - 1 :], strict=False) if len(words) >= size else [(0, len(line))]
    return np.array([xxh64_intdigest(line[a:b], seed) for a, b in spans], "<u8")


def whole_groups(batches, key: list[str], least: int = 50_000):
    """Tables of whole groups of batches that are sorted by key, of least rows or more each."""
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(k)[-1].as_py() for k in key]
        cut = table.num_rows
        while cut and all(table.column(k)[cut - 1].as_py() == x for k, x in zip(key, last, strict=True)):
            cut -= 1
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, rows = table.to_batches(), 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
