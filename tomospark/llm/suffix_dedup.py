"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of LENGTH = 200 bytes that covers it also starts anywhere else.

1. Anchors. Each window of 200 bytes has one: the leftmost of its first STRETCH positions whose GRAM
   bytes have the least hash. It depends on the window's bytes alone, so equal windows have equal
   anchors at equal offsets, and share the HEAD bytes that follow the anchor. Neighbouring windows mostly
   share their anchor: about one row for 80 windows, holding the anchor, its windows and two hashes.
2. Rows are dealt by the hash of their head. Rows of equal context (all bytes of their windows) repeat
   whole; that is most of what repeats. Within a batch of input their bytes are compared and one row for
   each context goes on; between batches the SHA-256 of their bytes decides. A head with one context has no repeat.
3. Contexts that share a head but differ are fetched from their texts and their suffixes from the anchor
   on are sorted by a mergesort whose comparisons find the common extension by binary search over
   prefix polynomial hashes. For each offset of windows before the anchor, neighbours in suffix order that
   agree on the bytes left of it are tested for a common extension of the rest. What the hashes find
   equal is verified byte by byte; a bucket in which that fails is redone without hashes.
   A bucket takes CELL contexts at most. A head with more has several; for those heads, windows are also
   compared across buckets, by the SHA-256 of their bytes counted with partial sums.
4. The spans of a row are merged and cut out.

A passage that very many documents share gives one head very many rows. Such heads are found in a sample of
the anchors, which steers the dealing alone: their rows are dealt by head and context to several tasks.

Rows are numbered in a written table, so each is a document of its own.

Defined cases: null text counts as empty; texts under 200 bytes keep all; matches never cross documents;
an exactly repeated row is another document, so both lose all if they have 200 bytes; rows of null
or equal doc_id are documents like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, settled, whole_groups, write_table

LENGTH = 200
STRETCH = 160
GRAM = 16
HEAD = LENGTH - STRETCH + 1
SEGMENT = 1 << 19
CELL = 16_384
#: One in so many anchors is looked at to find crowded heads.
SAMPLE = 64
BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict = {}


def _powers(n: int):
    """BASE and inverse BASE to the powers 0..n, modulo 2^64."""
    import numpy as np

    if len(_tables.get("up", ())) <= n:
        inverse = pow(BASE, -1, 1 << 64)
        for name, x in (("up", BASE), ("down", inverse)):
            out = np.full(n + 1, x, np.uint64)
            out[0] = 1
            _tables[name] = np.multiply.accumulate(out)
    return _tables["up"], _tables["down"]


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefix:
    """Prefix polynomial hashes of bytes: hash(at, n) of any stretch in constant time, for arrays of both."""

    def __init__(self, raw):
        import numpy as np

        up, self.down = _powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def hash(self, at, n):
        return (self.sums[at + n] - self.sums[at]) * self.down[at]


def anchors(raw):
    """For bytes of one text: arrays (first window, number of windows, anchor - first window, head hash, context hash)."""
    import numpy as np

    out = []
    for base in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
        part = raw[base : base + SEGMENT + LENGTH - 1]
        prefix, windows = Prefix(part), len(part) - LENGTH + 1
        at = np.arange(windows + STRETCH - 1)
        # the hash's upper 44 bits, then the position: the least is the leftmost of the least hashes
        least = (_mix((prefix.sums[GRAM : GRAM + len(at)] - prefix.sums[: len(at)]) * prefix.down[: len(at)]) & ~np.uint64(0xFFFFF)) | at.astype(np.uint64)
        size = 1
        while 2 * size <= STRETCH:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < STRETCH:
            least = np.minimum(least[: -(STRETCH - size)], least[STRETCH - size :])
        chosen = (least & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        number, anchor = np.diff(np.append(first, windows)), chosen[first]
        context = prefix.hash(first, number + LENGTH - 1) ^ (((anchor - first) << 32) | number).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append((first + base, number, anchor - first, _mix(prefix.hash(anchor, HEAD)), _mix(context)))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def suffix_order(prefix: Prefix, raw, at, right, bucket):
    """Order of the suffixes raw[at : at + right] within buckets (bucket: ascending numbers from 0).

    A bottom-up mergesort: at each level every suffix finds its place in the sibling run by binary search.
    A comparison finds the common extension by binary search over prefix hashes, then compares a byte.
    """
    import numpy as np

    n = len(at)
    begin = np.searchsorted(bucket, np.arange(bucket[-1] + 2)) if n else np.zeros(1, np.int64)
    start, end = begin[bucket], begin[bucket + 1]
    order = np.arange(n)

    def less(i, j):
        """Suffix i before suffix j; the shorter of equal ones first, then the smaller number."""
        low, high = np.zeros(len(i), np.int64), np.minimum(right[i], right[j])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = prefix.hash(at[i], mid) == prefix.hash(at[j], mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        ended = low == np.minimum(right[i], right[j])
        x, y = raw[np.minimum(at[i] + low, len(raw) - 1)], raw[np.minimum(at[j] + low, len(raw) - 1)]
        tied = np.where(right[i] == right[j], i < j, right[i] < right[j])
        return np.where(ended, tied, x < y)

    size, largest = 1, int((end - start).max()) if n else 0
    while size < largest:
        pos = np.arange(n)
        inside = pos - start
        run = inside // size
        sibling = start + (run ^ 1) * size
        low, high = np.minimum(sibling, end), np.minimum(sibling + size, end)
        first, item = low.copy(), order[pos]
        moving = np.flatnonzero(low < high)
        while len(moving):
            mid = (low[moving] + high[moving]) // 2
            before = less(order[mid], item[moving])
            low[moving] = np.where(before, mid + 1, low[moving])
            high[moving] = np.where(before, high[moving], mid)
            moving = moving[low[moving] < high[moving]]
        place = start + (run // 2) * 2 * size + inside % size + (low - first)
        merged = np.empty(n, np.int64)
        merged[place] = item
        order, size = merged, 2 * size
    return order


def repeated_windows(raw, begin, left, number, bucket):
    """Which windows of the contexts in raw also start in another context of the same bucket.

    A context starts at begin, its anchor is left bytes on and it has number windows. Returns arrays (context, window).
    """
    import numpy as np

    prefix, at = Prefix(raw), begin + left
    right = number + LENGTH - 1 - left
    order = suffix_order(prefix, raw, at, right, bucket)
    found = []
    salt = _mix(bucket.astype(np.uint64))
    for offset in range(int((left - number + 1).min()), int(left.max()) + 1):
        # contexts that have a window offset bytes before their anchor, in suffix order
        has = order[(left[order] >= offset) & (left[order] - offset < number[order])]
        if len(has) < 2:
            continue
        side = prefix.hash(at[has] - offset, offset) ^ salt[has]
        near = np.argsort(side, kind="stable")
        has, side = has[near], side[near]
        i, j = has[:-1], has[1:]
        rest = LENGTH - offset
        same = (side[:-1] == side[1:]) & (bucket[i] == bucket[j]) & (prefix.hash(at[i], rest) == prefix.hash(at[j], rest))
        if same.any():
            found.append((i[same], j[same], np.full(int(same.sum()), offset)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, offset = (np.concatenate(x) for x in zip(*found, strict=True))
    good = _verified(raw, at, left, right, i, j, offset)
    wrong = np.unique(bucket[i[~good]])
    keep = ~np.isin(bucket[i], wrong)
    context = np.concatenate([i[keep], j[keep]])
    window = left[context] - np.concatenate([offset[keep], offset[keep]])
    more = [_plainly(raw, begin, left, number, np.flatnonzero(bucket == b)) for b in wrong]
    return np.concatenate([context, *[m[0] for m in more]]), np.concatenate([window, *[m[1] for m in more]])


def _verified(raw, at, left, right, i, j, offset):
    """Whether the windows offset bytes before the anchors of i and j are equal: each pair's bytes are compared once."""
    import numpy as np

    pair, which = np.unique(np.stack([i, j]), axis=1, return_inverse=True)
    which = which.reshape(-1)
    reach = [np.zeros(pair.shape[1], np.int64), np.zeros(pair.shape[1], np.int64)]
    for k in range(0, pair.shape[1], 20_000):
        a, b = pair[:, k : k + 20_000]
        for side, most, steps in ((0, np.minimum(left[a], left[b]), -np.arange(1, STRETCH)), (1, np.minimum(right[a], right[b]), np.arange(LENGTH))):
            x, y = (raw[np.clip(at[z][:, None] + steps, 0, len(raw) - 1)] for z in (a, b))
            same = np.logical_and.accumulate(x == y, axis=1).sum(axis=1)
            reach[side][k : k + 20_000] = np.minimum(same, most)
    return (offset <= reach[0][which]) & (LENGTH - offset <= reach[1][which])


def _plainly(raw, begin, left, number, members):
    """repeated_windows for one bucket, by comparing the windows' bytes themselves."""
    import numpy as np

    seen: dict[bytes, list] = {}
    for c in members:
        for w in range(number[c]):
            seen.setdefault(raw[begin[c] + w : begin[c] + w + LENGTH].tobytes(), []).append((c, w))
    pairs = np.array([x for group in seen.values() if len(group) > 1 for x in group], np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


ANCHORS = "head long, context long, row long, first int, number int, left int, state int"
#: state of an anchor's row: the only one of its context in its batch, the one of several that goes on, a further one
SINGLE, FIRST, FURTHER = 0, 1, 2


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _same_bytes(raw, a, b, size):
    """Whether raw[a : a + size] equals raw[b : b + size], for arrays of places and sizes."""
    import numpy as np

    out = np.ones(len(a), bool)
    steps = np.arange(int(size.max()) if len(size) else 0)
    for k in range(0, len(a), 20_000):
        part = slice(k, k + 20_000)
        inside = steps < size[part, None]
        x, y = (raw[np.minimum(p[part, None] + steps, len(raw) - 1)] for p in (a, b))
        out[part] = ((x == y) | ~inside).all(axis=1)
    return out


def _anchor_rows(batches):
    import numpy as np
    import pyarrow as pa

    names = _names(ANCHORS)
    for batch in batches:
        rows, parts, sizes, held = batch.column("row"), [], [], []
        for text in batch.column("text").to_pylist():
            held.append((text or "").encode())
            got = anchors(np.frombuffer(held[-1], np.uint8))
            parts.append(got)
            sizes.append(len(got[0]))
        if not sum(sizes):
            continue
        first, number, left, head, context = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((context, head))
        same = (head[order[1:]] == head[order[:-1]]) & (context[order[1:]] == context[order[:-1]])
        # what the hashes call equal is compared; a group that differs goes on row by row
        begin = np.cumsum([0, *map(len, held[:-1])])[row] + first
        i, j = order[:-1][same], order[1:][same]
        equal = (number[i] == number[j]) & (left[i] == left[j]) & _same_bytes(np.frombuffer(b"".join(held), np.uint8), begin[i], begin[j], number[i] + LENGTH - 1)
        group = np.cumsum(np.append(True, ~same)) - 1
        wrong = np.zeros(group[-1] + 1, bool)
        wrong[group[1:][same][~equal]] = True
        same &= ~wrong[group[1:]]
        state = np.zeros(len(order), np.int32)
        state[order[1:][same]] = FURTHER
        lead = order[:-1][same]
        state[lead[state[lead] == SINGLE]] = FIRST
        columns = [pa.array(head.view(np.int64)), pa.array(context.view(np.int64)), rows.take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (first, number, left, state))]
        yield pa.RecordBatch.from_arrays(columns, names)


def crowded(table: DataFrame, cell: int) -> DataFrame:
    """_head and cells (2 or more) of the heads with more than about cell rows, from a sample of the rows."""
    dealt = table.where(F.col("state") < FURTHER)
    part = F.pmod(F.xxhash64("row", "first"), F.lit(SAMPLE)) == 0
    heads = dealt.where(part).groupBy("head").agg((F.count("*") * SAMPLE).alias("_n")).where(F.col("_n") > cell)
    # at most (rows / cell) of them
    return write_table(heads.select(F.col("head").alias("_head"), F.ceil(F.col("_n") / cell).cast("int").alias("cells")), "heads")


BUCKETS = "head long, context long, part long, row long, first int, number int, left int, whole boolean, several boolean"


def _with_next(items):
    """Pairs of an item and the one after it, None at the end."""
    held = None
    for item in items:
        if held is not None:
            yield held, item
        held = item
    if held is not None:
        yield held, None


def _bucket_rows(cell: int):
    """Rows whose context repeats (whole), and one row of each context that shares its head with another.

    Rows come by head, dealt (the share of a crowded head that the task got) and context. A context has at most one row
    per input batch; of a head only its last context and their number are held, so it may have any number. All contexts
    of a crowded head may have others in other tasks, so all go on.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, held = None, 0
        for table, after in _with_next(whole_groups(batches, ["head", "dealt", "context"])):
            head, dealt, context, state = (table.column(k).to_numpy() for k in ("head", "dealt", "context", "state"))
            split = table.column("cells").to_numpy() > 1
            change = (head[1:] != head[:-1]) | (dealt[1:] != dealt[:-1])
            new = np.append(True, change | (context[1:] != context[:-1]))
            group = np.cumsum(new) - 1
            times = np.bincount(group)
            several = np.bincount(group, weights=state == FIRST) > 0
            whole = (times[group] > 1) | several[group]
            at = np.flatnonzero(new)
            heads, deals = head[at], dealt[at]
            follows = (heads[1:] == heads[:-1]) & (deals[1:] == deals[:-1])
            key = lambda t, k: (t.column("head")[k].as_py(), t.column("dealt")[k].as_py())
            as_before = np.append(last is not None and key(table, 0) == last, follows)
            as_after = np.append(follows, after is not None and key(after, 0) == key(table, table.num_rows - 1))
            # the number of each context within its head's share
            begin = np.maximum.accumulate(np.where(as_before, 0, np.arange(len(heads))))
            number = np.arange(len(heads)) - begin
            if as_before[0]:
                number[: int((~as_before).argmax()) if not as_before.all() else len(heads)] += held
            last, held = key(table, table.num_rows - 1), int(number[-1]) + 1
            compare = at[as_before | as_after | split[at]]
            take = np.concatenate([np.flatnonzero(whole), compare])
            rows = table.take(pa.array(take))
            columns = {k: rows.column(k).combine_chunks() for k in ("head", "context", "row", "first", "number", "left")}
            columns["part"] = pa.array(dealt[take].astype(np.int64) << 32 | number[group[take]] // cell)
            columns["whole"] = pa.array(np.arange(len(take)) < whole.sum())
            columns["several"] = pa.array(state[take] == FIRST)
            names = _names(BUCKETS)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return run


CONTEXTS = "head long, context long, part long, row long, first int, number int, left int, whole boolean, several boolean, digest binary, bytes binary"


def _context_rows(batches):
    """The contexts with the bytes of those that are to be compared, and the SHA-256 of those that repeat whole."""
    import hashlib

    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in CONTEXTS.split(", ")])
    for batch in batches:
        for one in range(batch.num_rows):
            row = batch.slice(one, 1).to_pylist()[0]
            raw, out = row["text"].encode(), []
            for x in row["rows"]:
                part = raw[x["first"] : x["first"] + x["number"] + LENGTH - 1]
                digest = hashlib.sha256(b"%d:" % x["left"] + part).digest() if x["whole"] else None
                out.append(x | {"row": row["row"], "digest": digest, "bytes": None if x["whole"] else part})
            yield pa.RecordBatch.from_pylist(out, schema)


def _suffix_rows(batches):
    import numpy as np
    import pyarrow as pa

    for table in whole_groups(batches, ["head", "part"], 20_000):
        head, part = table.column("head").to_numpy(), table.column("part").to_numpy()
        first, number, left = (table.column(k).to_numpy().astype(np.int64) for k in ("first", "number", "left"))
        held = table.column("bytes").combine_chunks()
        raw = np.frombuffer(b"".join(held.to_pylist()), np.uint8)
        sizes = number + LENGTH - 1
        bucket = np.cumsum(np.append(False, (head[1:] != head[:-1]) | (part[1:] != part[:-1])))
        context, window = repeated_windows(raw, np.cumsum(sizes) - sizes, left, number, bucket)
        # runs of windows of one context make one span
        key = np.unique((context << 32) | window)
        context, window = key >> 32, key & 0xFFFFFFFF
        begins = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (window[1:] != window[:-1] + 1))[: len(key)])
        ends = np.append(begins[1:], len(key)) - 1 if len(begins) else begins
        at = pa.array(context[begins])
        start, end = first[context[begins]] + window[begins], first[context[begins]] + window[ends] + LENGTH
        yield pa.RecordBatch.from_arrays([table.column("row").take(at).combine_chunks(), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["row", "start", "end"])


def _window_rows(batches):
    """A row for each window of the contexts: its SHA-256 and place."""
    import hashlib

    import pyarrow as pa

    for batch in batches:
        for one in range(batch.num_rows):
            x = batch.slice(one, 1).to_pylist()[0]
            starts = range(x["number"])
            shas = [hashlib.sha256(x["bytes"][s : s + LENGTH]).digest() for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array([x["row"]] * len(starts), pa.int64()), pa.array([x["first"] + s for s in starts], pa.int32())], ["digest", "row", "start"])


SPANS = "row long, start int, end int"


def _compared(contexts: DataFrame) -> DataFrame:
    """Spans of contexts that repeat in part, within their buckets and, for heads of several buckets, across them."""
    within = contexts.repartition("head", "part").sortWithinPartitions("head", "part").mapInArrow(released(_suffix_rows), SPANS)
    heads = write_table(contexts.groupBy("head").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a < _b").select(F.col("head").alias("_head")), "heads")
    if heads.isEmpty():
        return within
    hot = contexts.join(heads, F.col("head") == F.col("_head"), "left_semi").select("row", "first", "number", "bytes")
    windows = write_table(hot.mapInArrow(_window_rows, "digest binary, row long, start int"), "windows")
    twice = write_table(windows.groupBy("digest").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("digest").alias("_digest")), "digests")
    across = windows.join(twice, F.col("digest") == F.col("_digest"), "left_semi")
    return within.unionAll(across.select("row", "start", (F.col("start") + LENGTH).alias("end")))


def _fetched(rows: DataFrame, need: DataFrame) -> DataFrame:
    """need's contexts (BUCKETS) with their bytes or digests; a text's anchors bound the number of its contexts."""
    listed = need.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct(*[c for c in _names(BUCKETS) if c != "row"])).alias("rows"))
    return rows.select("row", "text").join(listed, F.col("row") == F.col("_row")).select("row", "text", "rows").mapInArrow(released(_context_rows), CONTEXTS)


def _wholly(whole: DataFrame) -> DataFrame:
    """head, context, digest and whether the context repeats."""
    return whole.groupBy("head", "context", "digest").agg((F.max("several") | (F.count("*") > 1)).alias("repeats"))


def spans(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """row, start and end in bytes, not merged, of what goes; rows has row (unique and stable), and text."""
    table = write_table(rows.select("row", "text").mapInArrow(released(_anchor_rows), ANCHORS), "anchors")
    heads = crowded(table, cell)
    dealt = table.where(F.col("state") < FURTHER).join(heads, F.col("head") == F.col("_head"), "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    dealt = dealt.withColumn("dealt", F.pmod(F.xxhash64("context"), F.col("cells")).cast("int")).select("head", "dealt", "cells", "context", "row", "first", "number", "left", "state")
    key = ["head", "dealt"]
    buckets = write_table(dealt.repartition(*key).sortWithinPartitions(*key, "context").mapInArrow(_bucket_rows(cell), BUCKETS), "buckets")
    contexts = write_table(_fetched(rows, buckets), "contexts")

    place = lambda df: df.select("row", F.col("first").alias("start"), (F.col("first") + F.col("number") + LENGTH - 1).alias("end"))
    whole, compare = contexts.where("whole"), contexts.where("NOT whole")
    # contexts whose hashes are equal and whose bytes aren't: hardly ever any
    unlike = _wholly(whole).groupBy("head", "context").agg(F.count("*").alias("_n")).where("_n > 1")
    unlike = write_table(unlike.select(F.col("head").alias("_h"), F.col("context").alias("_c")), "unlike")
    if not unlike.isEmpty():
        met = (F.col("head") == F.col("_h")) & (F.col("context") == F.col("_c"))
        doubtful = whole.join(unlike, met, "left_semi")
        good = _wholly(doubtful).where("repeats").select(F.col("head").alias("_h"), F.col("context").alias("_c"), F.col("digest").alias("_d"))
        again = buckets.where("whole").join(unlike, met, "left_semi").withColumn("whole", F.lit(False))
        more = write_table(_fetched(rows, again), "contexts")
        kept = compare.join(more.select(F.col("row").alias("_r"), F.col("first").alias("_f")), (F.col("row") == F.col("_r")) & (F.col("first") == F.col("_f")), "left_anti")
        compare = write_table(kept.unionByName(more), "contexts")
        whole = whole.join(unlike, met, "left_anti").unionByName(doubtful.join(good, met & (F.col("digest") == F.col("_d")), "left_semi"))
    return place(whole).unionAll(place(table.where(F.col("state") > SINGLE))).unionAll(_compared(compare))


def cut(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans of each row of docs."""
    rows = write_table(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "rows")
    merged = lambda: spans(rows, cell).groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))
    gone = settled(merged, "gone")

    def remove(batches):
        import pyarrow as pa

        for batch in batches:
            kept, sizes, removed, runs = [], [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                raw = text.encode()
                at, out, n = 0, [], 0
                for span in gone or ():
                    start, end = span["start"], span["end"]
                    if start > at or not n:
                        out.append(raw[at:start])
                        n += 1
                    at = max(at, end)
                out.append(raw[at:])
                kept.append(b"".join(out))
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                runs.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = rows.join(gone, F.col("row") == F.col("_row"), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(released(remove), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def digests(docs: DataFrame) -> DataFrame:
    return cut(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
