"""Nearest neighbours by low-dimensional stable projections indexed by kd-trees.

Vectors are projected to DIMS dimensions with Gaussian (2-stable) coefficients, so a projected squared
distance over the squared distance is chi-square with DIMS degrees of freedom. A query takes its neighbours one
after another in order of projected distance and verifies them in double precision, until the next one's is so large
that, by the chi-square test, a vector nearer than the k-th best so far lies there with probability 1 - CONFIDENCE at most.

1. The top of the kd-tree is fitted on a bounded sample of projections (SAMPLE rows or fewer); its cells hold
   about PLACE rows each. Every row goes to its cell, and a cell with more rows (equal vectors, or more cells
   than a sample can tell apart) is dealt to several places. No row is copied.
2. Each query goes to the places of its own cell; the k-th distance found there is its first bound.
3. With that bound each query goes to those places whose cells the test leaves open.
4. In a place, the rest of the kd-tree is built over its rows, once; queries pass by in batches of any number.

On data without structure the test leaves much open: of vectors that point anywhere in 64 dimensions, with the 10th neighbour at 0.8
of the mean distance, about half the rows are verified; in clusters, a few per cent.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components take no
part, neither do rows of null vec_id, nor vectors that have another length than most (the least such length on ties), as
no distance to the others is defined; ties go to the smaller vec_id; repeated rows are candidates of their own; of rows
that share a query's vec_id the least vector (component by component) asks, once; a row isn't its own candidate (rows of
the query's vec_id aren't); queries with fewer than k candidates return all; empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, settled, write_table

K = 10
DIMS = 16
CONFIDENCE = 0.92
PLACE = 8_192
SAMPLE = 131_072
LEAF = 64
SEED = 42


def chi2_below(x: float, dims: int = DIMS) -> float:
    """P(chi-square of an even number of degrees of freedom <= x)."""
    if x <= 0:
        return 0.0
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def stop_at(limit: float, bound: float, low) -> float:
    """The projected squared distance beyond which the test stops; rounding mustn't part equal vectors."""
    return bound * limit * limit + 1e-12 * float(low @ low)


def chi2_bound(p: float, dims: int = DIMS) -> float:
    """The x with chi2_below(x) = p."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, dims) < p else (low, mid)
    return high


class Tree:
    """kd-tree over projected points: leaves of at most LEAF points with their bounding boxes."""

    def __init__(self, points, leaf: int = LEAF):
        import numpy as np

        self.order = np.arange(len(points))
        cuts, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                cuts.append((a, b))
                continue
            part = self.order[a:b]
            axis = int(np.ptp(points[part], axis=0).argmax())
            mid = (b - a) // 2
            self.order[a:b] = part[np.argpartition(points[part, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.cuts = np.array(sorted(cuts), np.int64).reshape(-1, 2)
        ordered = points[self.order]
        starts = self.cuts[:, 0]
        self.low = np.minimum.reduceat(ordered, starts, axis=0) if len(points) else ordered
        self.high = np.maximum.reduceat(ordered, starts, axis=0) if len(points) else ordered

    def leaves(self, q):
        """Leaf numbers by ascending squared distance from q to their boxes, and those distances."""
        import numpy as np

        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        dist = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(dist, kind="stable")
        return order, dist[order]


class Cells:
    """The top of a kd-tree over projections: 2 ** levels cells, cut at a sample's medians along the widest axes."""

    def __init__(self, sample, levels: int):
        import numpy as np

        inner, dims = (1 << levels) - 1, sample.shape[1]
        self.levels, self.axis, self.cut = levels, np.zeros(inner, np.int64), np.zeros(inner)
        low, high = np.full((2 * inner + 1, dims), -np.inf), np.full((2 * inner + 1, dims), np.inf)
        parts = [sample]
        for node in range(inner):
            part = parts[node]
            if len(part):
                self.axis[node] = np.ptp(part, axis=0).argmax()
                self.cut[node] = np.median(part[:, self.axis[node]])
            axis, cut = self.axis[node], self.cut[node]
            right = part[:, axis] > cut
            parts += [part[~right], part[right]]
            for child in (2 * node + 1, 2 * node + 2):
                low[child], high[child] = low[node], high[node]
            high[2 * node + 1, axis], low[2 * node + 2, axis] = cut, cut
            parts[node] = None
        self.low, self.high = low[inner:], high[inner:]
        self.share = np.array([len(x) for x in parts[inner:]]) / max(1, len(sample))

    def of(self, points):
        """The cell of each point."""
        import numpy as np

        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - len(self.axis)

    def gaps(self, point):
        """Squared distance from the point to each cell."""
        import numpy as np

        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


class Place:
    """Rows of one place: their kd-tree over projections, and their vectors."""

    def __init__(self, ids, vectors, stable, confidence: float = CONFIDENCE):
        low = vectors @ stable
        self.tree, self.stable = Tree(low), stable
        order = self.tree.order
        self.ids, self.vectors, self.low = ids[order], vectors[order], low[order]
        self.bound = chi2_bound(confidence, stable.shape[1])

    def nearest(self, q_id, q, k: int, limit: float = math.inf):
        """Indices and distances of the k nearest found, none beyond limit, nearest first; and how many rows were verified."""
        import numpy as np

        low = q @ self.stable
        order, box = self.tree.leaves(low)
        waiting, far = np.zeros(0, np.int64), np.zeros(0)  # rows of opened leaves, and their projected squared distances
        best, dist, at, leaves, chunk, verified = np.zeros(0, np.int64), np.zeros(0), 0, 4, 4 * k, 0
        while True:
            frontier, stop = box[at] if at < len(order) else math.inf, stop_at(limit, self.bound, low)
            is_ready = far <= min(frontier, stop)
            ready, reach = waiting[is_ready], far[is_ready]
            waiting, far = waiting[~is_ready], far[~is_ready]
            by = np.argsort(reach)
            ready, reach = ready[by], reach[by]
            while len(ready):
                rows = ready[: min(chunk, int(np.searchsorted(reach, stop_at(limit, self.bound, low), "right")))]
                if not len(rows):
                    break  # as the bound only shrinks
                ready, reach, chunk = ready[len(rows) :], reach[len(rows) :], min(2 * chunk, 4_096)
                diff = self.vectors[rows] - q
                found, verified = np.sqrt(np.einsum("ij,ij->i", diff, diff)), verified + len(rows)
                near = found <= limit
                best, dist = np.append(best, rows[near]), np.append(dist, found[near])
                keep = np.lexsort((self.ids[best], dist))[:k]
                best, dist = best[keep], dist[keep]
                if len(dist) == k:
                    limit = min(limit, float(dist[-1]))
            if at >= len(order) or frontier > stop_at(limit, self.bound, low):
                return best, dist, verified
            rows = np.concatenate([np.arange(*self.tree.cuts[x]) for x in order[at : at + leaves]])
            rows = rows[self.ids[rows] != q_id]
            gap = self.low[rows] - low
            waiting, far = np.append(waiting, rows), np.append(far, np.einsum("ij,ij->i", gap, gap))
            at, leaves = at + leaves, min(2 * leaves, 512)


def _matrix(column):
    """A list column as rows of doubles."""
    import numpy as np

    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), wide.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    # one row: the most frequent length
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(length), F.size("vector") == F.col("n"), "left_semi")


def _projections(vectors: DataFrame, stable) -> DataFrame:
    def project(batches):
        import pyarrow as pa

        for batch in batches:
            low = _matrix(batch.column(0)) @ stable
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.list_(pa.float64()))], ["low"])

    return vectors.select("vector").mapInArrow(project, "low array<double>")


def fit(rows: DataFrame, n_rows: int, stable, place: int = PLACE, sample: int = SAMPLE) -> Cells:
    """Cells of about place rows, from a sample that holds 16 rows or more for each of them."""
    import numpy as np

    levels = max(0, min(math.ceil(math.log2(n_rows / place)) if n_rows > place else 0, int(math.log2(sample / 16))))
    if not levels:
        return Cells(np.zeros((1, stable.shape[1])), 0)
    part = min(1.0, max(2_048, 64 << levels) / n_rows, sample / n_rows)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) < int(part * (1 << 30))
    found = _projections(rows.where(draw), stable).collect()  # about sample rows of DIMS numbers at most
    return Cells(np.array([r[0] for r in found]).reshape(len(found), stable.shape[1]), levels)


def _met(placed: DataFrame, asked: DataFrame, n_places: int, stable, k: int, confidence: float) -> DataFrame:
    """query_id, vec_id and score of the k nearest of each place to each query that came to it.

    placed: place, vec_id, vector; asked: also limit, a distance beyond which nothing is sought. A place's rows come first.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        here, held, rows = None, [], None
        for batch in batches:
            place, kind = (batch.column(n).to_numpy() for n in ("place", "kind"))
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if place[a] != here:
                    here, held, rows = place[a], [], None
                part = batch.slice(a, b - a)
                ids, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("vector"))
                if not kind[a]:
                    held.append((ids, vectors))
                    continue
                if not held:
                    continue
                if rows is None:
                    rows = Place(*(np.concatenate(x) for x in zip(*held, strict=True)), stable, confidence)
                found = [rows.nearest(i, q, k, limit) for i, q, limit in zip(ids, vectors, part.column("limit").to_numpy(), strict=True)]
                times = [len(f[0]) for f in found]
                columns = [np.repeat(ids, times), rows.ids[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    data = placed.select("place", F.lit(0).alias("kind"), "vec_id", "vector", F.lit(0.0).alias("limit"))
    both = data.unionAll(asked.select("place", F.lit(1), "vec_id", "vector", "limit"))
    dealt = both.repartition(max(1, min(n_places, 20_000)), "place").sortWithinPartitions("place", "kind")
    return dealt.mapInArrow(released(run), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, place: int = PLACE, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors that is_query (on vec_id) selects, against all rows."""
    import numpy as np

    rows = usable(vectors)
    n_rows, length = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    # 1 / sqrt(1) scaling: a coordinate of the projection has the variance of the squared norm
    stable = np.random.default_rng(seed).standard_normal((length or 1, dims))
    cells = fit(rows, n_rows, stable, place, sample)
    number = np.maximum(1, np.ceil(1.1 * n_rows * cells.share / place)).astype(np.int64)
    first = np.cumsum(number) - number
    n_places, bound = int(number.sum()), chi2_bound(confidence, dims)

    def to_cell(batches):
        import pyarrow as pa

        for batch in batches:
            cell = cells.of(_matrix(batch.column("vector")) @ stable)
            nth = batch.column("_at").to_numpy() % number[cell]
            columns = [pa.array(first[cell] + nth), pa.array(cell), batch.column("vec_id"), batch.column("vector")]
            yield pa.RecordBatch.from_arrays(columns, ["place", "cell", "vec_id", "vector"])

    at = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31)).alias("_at"), "vec_id", "vector")
    placed = write_table(at.mapInArrow(released(to_cell), "place long, cell long, vec_id long, vector array<double>"), "placed")
    asked = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("vector", "cell")).alias("_q")).select("vec_id", "_q.vector", "_q.cell")
    asked = write_table(asked, "asked")

    def own(batches):
        return _routed(batches, lambda cell, low, limit: np.arange(first[cell], first[cell] + number[cell]))

    def others(batches):
        def open_(cell, low, limit):
            far = cells.gaps(low) > stop_at(limit, bound, low)
            far[cell] = True
            return np.flatnonzero(~np.repeat(far, number))

        return _routed(batches, open_)

    def _routed(batches, places):
        import pyarrow as pa

        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            for n, (cell, q, limit) in enumerate(zip(batch.column("cell").to_pylist(), vectors, batch.column("limit").to_numpy(), strict=True)):
                found = places(cell, q @ stable, limit)
                for k in range(0, len(found), 4_096):
                    to = found[k : k + 4_096]
                    same = pa.array(np.full(len(to), n))
                    yield pa.RecordBatch.from_arrays([pa.array(to), *(batch.column(c).take(same) for c in ("vec_id", "vector", "limit"))], ["place", "vec_id", "vector", "limit"])

    schema = "place long, vec_id long, vector array<double>, limit double"
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    mine = asked.withColumn("limit", F.lit(float("inf"))).mapInArrow(own, schema)
    near = write_table(best(_met(placed, mine, n_places, stable, k, confidence)), "near")
    if len(number) == 1:
        return near
    limits = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    rest = asked.join(limits, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vector", "cell", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    further = _met(placed, rest.mapInArrow(others, schema), n_places, stable, k, confidence)
    return best(near.drop("rank").unionAll(further))


def neighbours(vectors: DataFrame) -> DataFrame:
    return settled(lambda: nearest(vectors, F.col("vec_id") % 100 == 0), "neighbours")
