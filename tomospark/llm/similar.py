"""Near copies by the Jaccard similarity of their sets of five-word shingles, as the pipeline removes them.

Two texts link if their sets have a similarity of SIMILARITY or more. Texts of one set are one node.

1. Candidates are the pairs that operator 8 links, by SimHash fingerprints of five-word shingles at anchor points,
   and, as most pairs of similarity 0.8 differ in more bits than anchors reach, the sets that share one of
   BANDS keys of ROWS min-hashes. A pair of similarity 0.8 shares one with probability
   1 - (1 - 0.8^7)^32 = 0.9995, more similar ones more surely.
2. A key's sets are tied to the least of them, and the components of all ties are groups.
3. In a group all pairs of sets that can still join two parts are compared exactly. A group of over CELL sets
   is split into parts, and each pair of parts is compared in a task of its own.
4. The components of these links are the near copies; of each one row stays: that of least doc_id, null last,
   then of least hash of the text and of the other columns.

Rows are numbered in a written table. Rows of null or equal doc_id are compared like any other, and exactly
repeated rows are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import released, settled, shingles, whole_groups, write_table
from .components import components

SIMILARITY = 0.8
SHINGLE = 5
BANDS = 32
ROWS = 7
SEED = 42
CELL = 8_192


def _hashes():
    import numpy as np

    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_of(text: str | None, shingle: int = SHINGLE):
    """The sorted distinct shingles."""
    import numpy as np

    return np.unique(shingles(text, shingle, SEED))


def bands(found, by):
    """The set's keys as int64; by: the values of _hashes()."""
    import numpy as np

    times, plus, mix = by
    least = np.full(len(times), 0xFFFFFFFF, np.uint32)
    # the middle bits, as a product's low bits see only a factor's low bits
    h = (found >> np.uint64(16)).astype(np.uint32)
    h ^= h >> np.uint32(15)
    for k in range(0, len(h), 2_048):
        x = h[k : k + 2_048] * times[:, None]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x += plus[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    # the sum differs from band to band by its factors
    key = (least.reshape(mix.shape).astype(np.uint64) * mix).sum(axis=1, dtype=np.uint64)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def prints(rows: DataFrame) -> DataFrame:
    """(text, place) -> place, node (a hash of the set), SimHash fingerprint of the shingles and the set's keys."""

    def make(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        by = _hashes()
        for batch in batches:
            nodes, fps, keys = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, BANDS), np.int64)
            for k, text in enumerate(batch.column(0).to_pylist()):
                h = shingles(text, SHINGLE, SEED)
                found = np.unique(h)
                nodes[k], fps[k], keys[k] = xxh64_intdigest(found.tobytes(), SEED), simhash.majority(h), bands(found, by)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x.view(np.int64)) for x in (nodes, fps)), listed], ["place", "node", "fp", "keys"])

    place = rows.schema["place"].dataType.simpleString()
    return rows.select("text", "place").mapInArrow(released(make), f"place {place}, node long, fp long, keys array<long>")


def forest(sets, similarity: float = SIMILARITY):
    """Pairs (i, j) of indices that connect exactly what links of at least the similarity connect."""
    import numpy as np

    sizes = np.array([len(s) for s in sets], np.int64)
    left, pairs = np.ones(len(sets), bool), []

    def index():
        """The shingles of the sets that are left, sorted, with their sets."""
        at = np.flatnonzero(left)
        if not len(at):
            return np.zeros(0, np.uint64), at, 0
        of = np.repeat(at, sizes[at])
        values = np.concatenate([sets[i] for i in at])
        order = np.argsort(values, kind="stable")
        return values[order], of[order], len(at)

    values, of, held = index()
    count = len(sets)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        count -= 1
        while queue and count:
            if 2 * count < held:
                values, of, held = index()
            x = queue.pop()
            low, high = np.searchsorted(values, sets[x]), np.searchsorted(values, sets[x], "right")
            times = high - low
            met = of[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            met, both = np.unique(met[left[met]], return_counts=True)
            new = met[both >= similarity * (sizes[x] + sizes[met] - both) - 1e-9]
            left[new] = False
            count -= len(new)
            pairs += [(x, y) for y in new.tolist()]
            queue += new.tolist()
    return pairs


def groups(nodes: DataFrame) -> DataFrame:
    """node and group: the components of sets that share keys or whose fingerprints link, those of two sets or more."""
    spread = nodes.select("node", F.explode("keys").alias("key"))
    least = spread.groupBy("key").agg(F.min("node").alias("_least"), F.max("node").alias("_most")).where("_least < _most")
    # written, so that the join below deals both sides itself and a hot key can be split
    least = write_table(least.select(F.col("key").alias("_key"), "_least"), "keys")
    ties = spread.join(least, F.col("key") == F.col("_key")).select(F.col("_least").alias("u"), F.col("node").alias("v")).where("u <> v").distinct()
    # operator 8: a fingerprint's sets are tied to the least of them, and those meet at anchors
    by_print = write_table(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    same = nodes.select("node", "fp").join(by_print.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).select(F.col("rep").alias("u"), F.col("node").alias("v")).where("u <> v")
    tied = components(ties.unionAll(same).unionAll(simhash.links(by_print)))
    return tied.select("node", F.col("component").alias("group")).unionAll(tied.select(F.col("component").alias("node"), F.col("component").alias("group")).distinct())


def links(texts: DataFrame, cell: int = CELL) -> DataFrame:
    """(group, node, text), a row per node -> (u, v), pairs of nodes whose components are those of the links."""
    large = texts.groupBy("group").count().where(F.col("count") > cell)
    large = large.select(F.col("group").alias("_group"), F.ceil(F.col("count") / cell).cast("int").alias("_parts"))
    # bounded by the number of nodes / cell
    placed = texts.join(F.broadcast(large), F.col("group") == F.col("_group"), "left").withColumn("parts", F.coalesce("_parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, "part").alias("lo"), F.greatest(j, "part").alias("hi")))
    placed = placed.select("group", F.inline(cells), "node", "text")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for table in whole_groups(batches, key, 4_096):
            cols = [table.column(k).to_numpy() for k in key]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            begin, end = np.append(0, new), np.append(new, table.num_rows)
            node, pairs = table.column("node").to_numpy(), []
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                if b - a > 1:
                    sets = [set_of(t) for t in table.column("text").slice(a, b - a).to_pylist()]
                    pairs += [(a + i, a + j) for i, j in forest(sets)]
            ij = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[ij[:, 0]]), pa.array(node[ij[:, 1]])], ["u", "v"])

    key = ["group", "lo", "hi"]
    return placed.repartition(*key).sortWithinPartitions(*key).mapInArrow(released(compare), "u long, v long")


def near_copies(rows: DataFrame, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, first: the least place of its rows), and (node, component) of those that aren't least in their component.

    rows has text and place, a struct by which rows are ordered, with row (unique and stable) last.
    """
    # keys depend on the set alone, the fingerprint on how often its shingles occur
    made = prints(rows).groupBy("node").agg(F.min("place").alias("first"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = write_table(made, "nodes")
    found = groups(nodes).join(nodes.select(F.col("node").alias("_node"), F.col("first.row").alias("_row")), F.col("node") == F.col("_node"))
    found = write_table(found.select("node", "group", "_row"), "groups")
    # texts are dealt by row at any size: what would be sent to all tasks grows with the corpus
    texts = rows.select(F.col("place.row").alias("row"), "text").join(found.hint("merge"), F.col("row") == F.col("_row"))
    texts = write_table(texts.select("group", "node", "text"), "texts")
    return nodes.select("node", "first"), components(links(texts, cell))


def _kept(rows: DataFrame, cell: int) -> DataFrame:
    """_row of the row that stays of each component."""
    nodes, joined = near_copies(rows, cell)
    joined = joined.select(F.col("node").alias("_node"), "component")
    first = nodes.join(joined, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
    return first.select(F.col("first.row").alias("_row"))


def keep_one(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """docs with one row of each component of near copies."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit(0))
    place = F.struct(
        F.col("doc_id").isNull().alias("anonymous"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text"), rest.alias("rest"), F.monotonically_increasing_id().alias("row"),
    )
    rows = write_table(docs.select(place.alias("place"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")), "rows")
    stay = settled(lambda: _kept(rows.select("place", F.col("all.text").alias("text")), cell), "stay")
    return rows.join(stay.hint("merge"), F.col("place.row") == F.col("_row"), "left_semi").select("all.*")
