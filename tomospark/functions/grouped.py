"""Arrow functions over sorted partitions: groups of many sizes in tables of many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of the files read (packed, all columns) for each task of dealt().
BYTES = 8_000_000


def dealt(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """df dealt by keys over as many tasks as the size of the tables that it reads asks for, so that a task's share doesn't grow with them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()) if leaves.apply(k).getClass().getSimpleName() != "LogicalRDD")
    spark = df.sparkSession
    tasks = max(least, min(size // BYTES + 1, 20_000), min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(tasks, *keys)


def whole_groups(batches, key: str, least: int = 20_000):
    """Tables of whole groups of batches that are sorted by key, of least rows or more each."""
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last, cut = table.column(key)[-1].as_py(), table.num_rows
        while cut and table.column(key)[cut - 1].as_py() == last:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbered(column, nulls_meet: bool = False):
    """Numbers from 0 of the groups of a sorted Arrow column, and the row where each begins. Nulls are groups of one row, or of all if nulls_meet."""
    import numpy as np
    import pyarrow.compute as pc

    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    after, before = values.slice(1), values.slice(0, len(values) - 1)
    new = pc.fill_null(pc.not_equal(after, before), True)
    if nulls_meet and values.null_count:
        new = pc.and_not(new, pc.and_(pc.is_null(after), pc.is_null(before)))
    new = np.append(True, new.to_numpy(zero_copy_only=False))
    return np.cumsum(new) - 1, np.flatnonzero(new)


def pairs_within(group, begin, most: int = 4_000_000):
    """All index pairs i < j of the rows of each group, in arrays of about most pairs at once."""
    import numpy as np

    size = np.diff(np.append(begin, len(group)))
    after = begin[group] + size[group] - 1 - np.arange(len(group))  # rows of the group after each row
    until, at = np.cumsum(after), 0
    while at < len(group):
        end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + most, "right")))
        part = after[at:end]
        i = np.repeat(np.arange(at, end), part)
        nth = np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        yield i, i + 1 + nth
        at = end
