"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits link at THRESHOLD = 4 or fewer differing bits. The bits are split into two
blocks of 23 and one of 18. Of four differing bits either one 23-bit block has at most one, or both
have two and the 18-bit block has none. So the anchors are
- the 4,096 words of the binary Golay code for each 23-bit block: its covering radius is 3, so
  a fingerprint goes to every anchor within 3 + 1 bits (5.3 on average), and
- all words of the 18-bit block (covering radius 0, threshold 0).
Two linked fingerprints meet at an anchor in one of the three; there they are compared on 64 bits.
Equal fingerprints are one node. At an anchor only those fingerprints are compared that agree in one of five chunks
of their 64 bits, as any two that link do: a small share of all pairs, so the work of an anchor grows with its fingerprints
times some thousandths of them. An anchor with more than CELL fingerprints is split into parts and each
pair of parts is compared in a task of its own; the table of such anchors has at most 2 * 4,096 + 2^18 rows.
Each task returns a spanning forest of its links, never all pairs.

Defined cases: null text counts as empty; texts without a word have fingerprint zero and link like
any other; rows of one doc_id belong together, whatever their texts; a row of null doc_id links like any
other, and a component of such rows alone has a null component_id; repeated rows are one node.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grouped import pairs_within
from .common import released, settled, shingles, whole_groups, write_table
from .components import components

THRESHOLD = 4
SHINGLE = 4
SEED = 42
CELL = 16_384
#: Bits of the blocks, and of the Golay code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
BLOCKS = (23, 23, 18)
GOLAY = 0b110001110101
RADIUS = 3


def majority(h) -> int:
    """Bit i is 1 if it is 1 in over half of the uint64 values; 0 for none."""
    import numpy as np

    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        ones += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The majority of the shingles' XXH64 values."""
    return majority(shingles(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def make(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(make), "doc_id long, fp long")


def _syndromes(x):
    """Remainders of 23-bit words by the generator polynomial."""
    import numpy as np

    x = x.astype(np.int64).copy()
    for k in range(22, 10, -1):
        x ^= np.where((x >> k) & 1, GOLAY << (k - 11), 0)
    return x


def _patterns():
    """The error patterns of up to RADIUS + 1 bits ordered by syndrome, and where each syndrome's begin."""
    import numpy as np

    words = np.array([sum(1 << b for b in c) for w in range(RADIUS + 2) for c in combinations(range(23), w)], np.int64)
    syn = _syndromes(words)
    order = np.argsort(syn, kind="stable")
    return words[order], np.searchsorted(syn[order], np.arange(2049))


def anchors(fp):
    """uint64 array -> arrays (index into fp, block, anchor)."""
    import numpy as np

    patterns, begin = _patterns()
    out, shift = [], 0
    for block, bits in enumerate(BLOCKS):
        word = ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        shift += bits
        if bits == 23:
            syn = _syndromes(word)
            n = begin[syn + 1] - begin[syn]
            at = np.repeat(np.arange(len(fp)), n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            out.append((at, np.full(len(at), block), word[at] ^ patterns[begin[syn[at]] + nth]))
        else:
            out.append((np.arange(len(fp)), np.full(len(fp), block), word))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _join(root, a, b) -> None:
    """Unite the sets of a and b in root, an array that names each index's set by its least index."""
    import numpy as np

    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != root[root]).any():
            root[:] = root[root]


def forest(fp, threshold: int = THRESHOLD):
    """Pairs (i, j) of indices that connect exactly what links of at most threshold bits connect."""
    import numpy as np

    root, shift = np.arange(len(fp)), 0
    for k in range(threshold + 1):
        bits = (64 - shift) // (threshold + 1 - k)
        key = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        shift += bits
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order[1:]] != key[order[:-1]])[: len(fp)]
        for i, j in pairs_within(np.cumsum(new) - 1, np.flatnonzero(new)):
            a, b = order[i], order[j]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= threshold
            _join(root, a[near], b[near])
    at = np.flatnonzero(root != np.arange(len(fp)))
    return list(zip(root[at].tolist(), at.tolist(), strict=True))


def links(nodes: DataFrame, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(fp, rep), one row per fingerprint -> (u, v), pairs of rep (a name of the fingerprint) whose components are those of the links."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover thresholds up to {THRESHOLD}")

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            at, block, anchor = anchors(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(anchor, pa.int32()), pa.array(fp[at]), batch.column(1).take(pa.array(at))], ["block", "anchor", "fp", "rep"])

    spreaded = nodes.select("fp", "rep").mapInArrow(released(spread), "block int, anchor int, fp long, rep long")
    large = spreaded.groupBy("block", "anchor").count().where(F.col("count") > cell)
    parts = F.ceil(F.col("count") / cell).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, "part").alias("lo"), F.greatest(j, "part").alias("hi")))
    # bounded by the number of anchors
    placed = spreaded.join(F.broadcast(large.withColumn("parts", parts).drop("count")), ["block", "anchor"], "left")
    placed = placed.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
    placed = placed.select("block", "anchor", F.inline(cells), "fp", "rep")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def found(table):
            cols = [table.column(k).to_numpy() for k in ("block", "anchor", "lo", "hi")]
            fp, rep = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            begin, end = np.append(0, new), np.append(new, len(fp))
            pairs = [(a + i, a + j) for a, b in zip(begin, end, strict=True) if b - a > 1 for i, j in forest(fp[a:b], threshold)]
            ij = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rep[ij[:, 0]]), pa.array(rep[ij[:, 1]])], ["u", "v"])

        for table in whole_groups(batches, ["block", "anchor", "lo", "hi"]):
            yield found(table)

    key = ["block", "anchor", "lo", "hi"]
    return placed.repartition(*key).sortWithinPartitions(*key).mapInArrow(released(compare), "u long, v long")


def near_dups(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """doc_id, fp (signed long) and component_id for each row of docs."""
    prints = write_table(fingerprints(docs, shingle), "prints")
    # written, so that the join below deals both sides itself and a hot fingerprint can be split
    named = settled(lambda: _named(prints, threshold, cell), "named")
    return prints.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def _named(prints: DataFrame, threshold: int, cell: int) -> DataFrame:
    """_fp and component_id of each fingerprint."""
    nodes = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    # fingerprints of one doc_id are tied to the least of them
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("_most")).where("u < _most").select(F.col("doc_id").alias("_doc"), "u")
    tied = prints.join(several, F.col("doc_id") == F.col("_doc")).select("u", F.col("fp").alias("v")).where("u <> v").distinct()
    joined = components(links(nodes.select("fp", F.col("fp").alias("rep")), threshold, cell).unionAll(tied)).select(F.col("node").alias("_fp"), "component")
    joined = write_table(joined.unionAll(joined.select("component", "component").distinct()), "joined")
    # a component's name is its least doc_id
    least = joined.join(nodes, F.col("_fp") == F.col("fp")).groupBy("component").agg(F.min("rep").alias("_least"))
    least = write_table(least.withColumnRenamed("component", "_component"), "least")
    member = joined.join(least, F.col("component") == F.col("_component")).select("_fp", "_least")
    return nodes.join(member, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_fp"), F.coalesce("_least", "rep").alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    found = near_dups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
