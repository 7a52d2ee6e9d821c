"""Confidence of findings and of doctors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import squared_distance
from ..functions.grouped import dealt, numbered, whole_groups


def finding_confidence(nodules: DataFrame, r: float = 20.0, alpha: float | None = None, weight_by_doctor: bool = True) -> DataFrame:
    """NoduleID and NoduleConfidence: what other doctors' findings of the same scan within r say for each finding.

    The scan is an equality key, the distance a filter of the join; each side sends only what is needed.
    """
    cols = ["seriesuid", "NoduleID", "DoctorID", "coordX", "coordY", "coordZ", "DoctorConfidence"]
    a, b = nodules.select(*cols).alias("a"), nodules.select(*cols).alias("b")
    dist2 = squared_distance("a", "b")
    own = F.col("a.NoduleID") == F.col("b.NoduleID")
    pairs = a.join(b, (F.col("a.seriesuid") == F.col("b.seriesuid")) & (dist2 <= r * r))
    weight = 0.75 * (1 - dist2 / (r * r)) * F.col("b.DoctorConfidence")
    if weight_by_doctor:
        weight = weight * F.col("a.DoctorConfidence")
    if alpha is not None:
        weight = F.when(own, weight * (alpha / 0.75)).otherwise(weight * (1 - alpha))
    counted = F.when(own | (F.col("a.DoctorID") != F.col("b.DoctorID")), weight).otherwise(0.0)
    return pairs.groupBy(F.col("a.NoduleID").alias("NoduleID")).agg(F.sum(counted).alias("NoduleConfidence"))


def with_confidence(nodules: DataFrame, **options) -> DataFrame:
    return nodules.join(finding_confidence(nodules, **options), "NoduleID", "left")


def meetings(pairs: DataFrame) -> DataFrame:
    """doc_i < doc_j and the number of scans that both annotated."""
    d = pairs.select("seriesuid", "DoctorID").distinct()
    a, b = d.alias("a"), d.alias("b")
    met = a.join(b, (F.col("a.seriesuid") == F.col("b.seriesuid")) & (F.col("a.DoctorID") < F.col("b.DoctorID")))
    return met.groupBy(F.col("a.DoctorID").alias("doc_i"), F.col("b.DoctorID").alias("doc_j")).agg(F.count("*").alias("meetings"))


def pair_probability(pairs: DataFrame) -> DataFrame:
    met = meetings(pairs)
    total = met.agg(F.sum("meetings").alias("_total"))  # one row
    return met.crossJoin(F.broadcast(total)).select("doc_i", "doc_j", "meetings", (F.col("meetings") / F.col("_total")).alias("probability"))


def consiliums(pairs: DataFrame) -> DataFrame:
    """seriesuid, DoctorID and each pair doc_i < doc_j of the other doctors of the scan."""
    d = pairs.select("seriesuid", "DoctorID").distinct()
    a, b, c = d.alias("a"), d.alias("b"), d.alias("c")
    same = lambda x, y: F.col(f"{x}.seriesuid") == F.col(f"{y}.seriesuid")
    two = b.join(c, same("b", "c") & (F.col("b.DoctorID") < F.col("c.DoctorID")))
    three = a.join(two, same("a", "b") & (F.col("a.DoctorID") != F.col("b.DoctorID")) & (F.col("a.DoctorID") != F.col("c.DoctorID")))
    return three.select(F.col("a.seriesuid").alias("seriesuid"), F.col("a.DoctorID").alias("DoctorID"), F.col("b.DoctorID").alias("doc_i"), F.col("c.DoctorID").alias("doc_j"))


def _placed(nodules: DataFrame, factor: float) -> DataFrame:
    """seriesuid, DoctorID, r, X, Y, Z, nX, nY, nZ: findings scaled and shifted per scan, in whole voxels of a grid of the scan's own."""
    scan = Window.partitionBy("seriesuid")
    d = F.col("diameter_mm") * factor
    placed = nodules.select("seriesuid", "DoctorID", d.alias("d"), *[(F.col(f"coord{a}") * factor).alias(a) for a in "XYZ"])
    largest = F.max("d").over(scan)
    shifted = placed.withColumns({a: F.col(a) - (F.min(a).over(scan) - largest) for a in "XYZ"})
    sized = shifted.withColumns({f"n{a}": F.ceil(F.max(F.col(a) + F.col("d") + 10).over(scan)).cast("int") for a in "XYZ"})
    return sized.select("seriesuid", "DoctorID", F.col("d").cast("int").alias("r"), *[F.col(a).cast("int").alias(a) for a in "XYZ"], "nX", "nY", "nZ")


def ball_voxels(nodules: DataFrame, factor: float = 0.3) -> DataFrame:
    """Distinct voxels (seriesuid, DoctorID, x, y, z) of doctors' findings, scaled and shifted per scan.

    A finding's ball has its scaled diameter, truncated, as radius; centres are truncated too.
    """
    whole = _placed(nodules, factor).where("r > 0")
    span = lambda a: F.sequence(F.greatest(F.lit(0), F.col(a) - F.col("r")), F.least(F.col(f"n{a}"), F.col(a) + F.col("r") + 1) - 1)
    for a in "XYZ":
        whole = whole.withColumn(f"v{a}", F.explode(span(a)))
        # a slab beyond the ball ends here, not after three explodes
        far = sum((F.col(f"v{b}") - F.col(b)) * (F.col(f"v{b}") - F.col(b)) for b in "XYZ"[: "XYZ".index(a) + 1])
        whole = whole.where(far < F.col("r") * F.col("r"))
    return whole.select("seriesuid", "DoctorID", F.col("vX").alias("x"), F.col("vY").alias("y"), F.col("vZ").alias("z")).distinct()


#: Voxels of balls that a task holds at once, unless one scan has more.
VOXELS = 2_000_000
#: Rows of consiliums or pairs in a batch that leaves a task, unless one scan has more.
ROWS = 200_000


def _fitted(of, begin, at, d):
    """Whole centres, radii and grid sizes of findings, scaled and shifted per scan (_placed in numpy); unknown ones get radius 0."""
    import numpy as np

    largest = np.fmax.reduceat(d, begin)[of]
    known = np.isfinite(d)
    place, size = np.zeros(at.shape, np.int64), np.zeros(at.shape, np.int64)
    for k in range(at.shape[1]):
        x = at[:, k] - (np.fmin.reduceat(at[:, k], begin)[of] - largest)
        n = np.ceil(np.fmax.reduceat(x + d + 10, begin))[of]
        known &= np.isfinite(x) & np.isfinite(n)
        place[:, k], size[:, k] = np.where(np.isfinite(x), x, 0), np.where(np.isfinite(n), n, 0)
    return place, np.where(known & (d > 0), d, 0).astype(np.int64), size


def _ball(r: int):
    """Voxels strictly inside a ball around 0."""
    import numpy as np

    grid = np.mgrid[-r : r + 1, -r : r + 1, -r : r + 1].reshape(3, -1).T
    return grid[(grid * grid).sum(axis=1) < r * r]


def _voxel_codes(at, radius, size):
    """Owner (row) and code of every voxel of balls at whole centres, inside a grid: arrays, for balls of any radii."""
    import numpy as np

    owners, codes = [], []
    for r in np.unique(radius[radius > 0]):
        ball, rows = _ball(int(r)), np.flatnonzero(radius == r)
        ny, nz = size[rows, 1:2], size[rows, 2:3]
        code = ((at[rows, 0:1] + ball[:, 0]) * ny + at[rows, 1:2] + ball[:, 1]) * nz + at[rows, 2:3] + ball[:, 2]
        owner = np.broadcast_to(rows[:, None], code.shape)
        if ((at[rows] >= r) & (at[rows] + r < size[rows])).all():
            owners.append(owner.ravel())
            codes.append(code.ravel())
            continue
        inside = np.ones(code.shape, bool)
        for k in range(3):
            cell = at[rows, k : k + 1] + ball[:, k]
            inside &= (cell >= 0) & (cell < size[rows, k : k + 1])
        owners.append(owner[inside])
        codes.append(code[inside])
    return (np.concatenate(owners), np.concatenate(codes)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sorted_voxels(scan, doctor, n_doctors: int, own, code, volume):
    """Different (scan, code, doctor) of voxels in order; one number each where they fit 62 bits."""
    import numpy as np

    s, d = scan[own], doctor[own]
    if float(volume.astype(float).sum()) * n_doctors < 2**62:
        base = np.cumsum(volume) - volume
        key = np.sort((base[s] + code) * n_doctors + d)
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        cell, d = np.divmod(key, n_doctors)
        return np.searchsorted(base, cell, "right") - 1, cell, d
    order = np.lexsort((d, code, s))
    s, code, d = s[order], code[order], d[order]
    new = np.append(True, (s[1:] != s[:-1]) | (code[1:] != code[:-1]) | (d[1:] != d[:-1]))[: len(s)]
    return s[new], code[new], d[new]


def _common(scan, doctor, number, at, radius, size, pairs: bool = True):
    """Voxels that doctors of a scan have in common: for each scan its doctors' square, row by row, one after the other; the
    diagonal holds their masks' sizes. Without pairs, the sizes alone."""
    import numpy as np

    width = number if pairs else np.ones(len(number), np.int64)
    first = np.cumsum(number * width) - number * width
    out = np.zeros(int((number * width).sum()), np.int64)
    voxels = np.zeros(len(radius), np.int64)
    for r in np.unique(radius[radius > 0]):
        voxels[radius == r] = len(_ball(int(r)))
    step, begin = np.cumsum(voxels), 0
    grid = size.prod(axis=1)
    while begin < len(scan):
        end = max(begin + 1, int(np.searchsorted(step, (step[begin - 1] if begin else 0) + VOXELS, "right")))
        if end < len(scan):  # a scan's masks meet
            end = max(end, int(np.searchsorted(scan, scan[end - 1], "right")))
        own, code = _voxel_codes(at[begin:end], radius[begin:end], size[begin:end])
        low = scan[begin]
        volume = np.zeros(scan[end - 1] - low + 1, np.int64)
        volume[scan[begin:end] - low] = grid[begin:end]
        s, code, d = _sorted_voxels(scan[begin:end] - low, doctor[begin:end], int(number.max()), own, code, volume)
        s = s + low
        add = lambda w: np.add(out, np.bincount(w, minlength=len(out)), out=out) if len(out) < 4 * len(w) else np.add.at(out, w, 1)
        add(first[s] + d * width[s] + (d if pairs else 0))
        for k in range(1, int(number.max()) if pairs else 0):  # voxels of k + 1 doctors or more
            same = np.flatnonzero((s[k:] == s[:-k]) & (code[k:] == code[:-k])) if len(s) > k else np.zeros(0, np.int64)
            if not len(same):
                break
            i, j, of = d[same], d[same + k], s[same]
            add(np.append(first[of] + i * width[of] + j, first[of] + j * width[of] + i))
        begin = end
    return out


def _scan_tables(batches, sizes: bool = False):
    """Of tables of whole scans: the scans (Arrow), the number of doctors and of rows without a doctor of each, the doctors (Arrow,
    sorted, a scan's after another's) and _common's counts; with sizes, those alone, and rows without a doctor are one doctor's."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for table in whole_groups(batches, "seriesuid"):
        held = table.column("DoctorID").combine_chunks()
        of, begin = numbered(table.column("seriesuid"), nulls_meet=True)
        value = lambda c: table.column(c).fill_null(float("nan")).to_numpy()  # noqa: E731, B023
        at, radius, size = _fitted(of, begin, np.stack([value(c) for c in "XYZ"], axis=1), value("d"))
        known = held.is_valid().to_numpy(zero_copy_only=False)
        unknown = np.bincount(of[~known], minlength=len(begin))
        encoded = held.dictionary_encode()
        names = pa.concat_arrays([encoded.dictionary, pa.nulls(1, held.type)])  # the last one for rows without a doctor
        order = np.append(pc.sort_indices(encoded.dictionary).to_numpy(), len(names) - 1).astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        who = rank[encoded.indices.fill_null(len(names) - 1).to_numpy()]
        keep = np.ones(len(of), bool) if sizes else known
        of, who = of[keep], who[keep]
        # a scan's own doctors, numbered from 0
        key, node = np.unique(of * len(order) + who, return_inverse=True)
        doc_of, doc = np.divmod(key, len(order))
        number = np.bincount(doc_of, minlength=len(begin))
        counts = _common(of, node - (np.cumsum(number) - number)[of], number, at[keep], radius[keep], size[keep], not sizes)
        yield table.column("seriesuid").combine_chunks().take(pa.array(begin)), number, unknown, names.take(pa.array(order[doc])), counts


def _per_scan(nodules: DataFrame, factor: float, make, more: str, sizes: bool = False) -> DataFrame:
    """make(scans, number, unknown, doctors, counts) over _scan_tables: it yields lists of columns of the schema more, in which @ and # stand for
    the types of DoctorID and seriesuid.

    Findings are dealt by scan once, over as many tasks as the tables' size asks for; balls are painted where they meet,
    and no voxel leaves its task.
    """
    import re

    doctor, scan = (nodules.schema[c].dataType.simpleString() for c in ("DoctorID", "seriesuid"))
    schema = more.replace("@", doctor).replace("#", scan)
    names = [re.split(r"\s+", part.strip())[0] for part in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for held in _scan_tables(batches, sizes):
            for columns in make(*held):
                yield pa.RecordBatch.from_arrays(columns, names)

    scaled = nodules.select("seriesuid", "DoctorID", (F.col("diameter_mm").cast("double") * factor).alias("d"), *[(F.col(f"coord{a}").cast("double") * factor).alias(a) for a in "XYZ"])
    return dealt(scaled if sizes else scaled.where("seriesuid IS NOT NULL"), "seriesuid").sortWithinPartitions("seriesuid").mapInArrow(run, schema)


def scan_masks(nodules: DataFrame, factor: float = 0.3) -> DataFrame:
    """A row per scan: seriesuid, doctors (sorted) and common, the voxels that each two of
    their masks share (row by row; the diagonal holds the sizes)."""

    def make(scans, number, unknown, doctors, counts):
        import numpy as np
        import pyarrow as pa

        ends = lambda n: pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        rows = pa.table({"s": scans, "d": pa.ListArray.from_arrays(ends(number), doctors), "c": pa.ListArray.from_arrays(ends(number * number), pa.array(counts))}).filter(pa.array(number > 0))
        yield [c.combine_chunks() for c in rows.columns]

    return _per_scan(nodules, factor, make, "seriesuid #, doctors array<@>, common array<bigint>")


def mask_sizes(nodules: DataFrame, factor: float = 0.3) -> DataFrame:
    """seriesuid, DoctorID and voxels, the number of different voxels of a doctor's findings; doctors without any are left out."""

    def make(scans, number, unknown, doctors, counts):
        import numpy as np
        import pyarrow as pa

        on = pa.array(np.flatnonzero(counts))
        yield [scans.take(pa.array(np.repeat(np.arange(len(number)), number))).take(on), doctors.take(on), pa.array(counts).take(on)]

    return _per_scan(nodules, factor, make, "seriesuid #, DoctorID @, voxels bigint", sizes=True)


def _blocks(number, least: int, per_scan):
    """(doctors of a scan, scans of that many) in blocks of about ROWS rows, for scans of least doctors or more."""
    import numpy as np

    for n in np.unique(number[number >= least]):
        rows = np.flatnonzero(number == n)
        step = max(1, ROWS // max(1, per_scan(int(n))))
        for k in range(0, len(rows), step):
            yield int(n), rows[k : k + step]


def dice(common: Column, total: Column) -> Column:
    return (2 * common + 1e-6) / (total + 1e-6)


def _consiliums(nodules: DataFrame, factor: float) -> DataFrame:
    """seriesuid, DoctorID, doc_i, doc_j, score and first: 1 for one row of each scan and pair of its doctors, else 0.

    A scan of three doctors or more that also has rows without a doctor gives one row of nulls for them.
    """

    def make(scans, number, unknown, doctors, counts):
        import numpy as np
        import pyarrow as pa

        first, square = np.cumsum(number) - number, np.cumsum(number * number) - number * number
        for n, rows in _blocks(number, 3, lambda n: n * (n - 1) * (n - 2) // 2):
            i, j = np.triu_indices(n, 1)
            a = np.repeat(np.arange(n), len(i))
            i, j = np.tile(i, n), np.tile(j, n)
            on = (a != i) & (a != j)
            a, i, j = a[on], i[on], j[on]
            least = (a == np.where(i > 0, 0, np.where(j > 1, 1, 2))).astype(np.int64)
            c = lambda x, y: counts[square[rows][:, None] + x * n + y].astype(float)  # noqa: E731, B023
            score = (2 * ((c(a, i) + c(a, j)) / 2) + 1e-6) / (c(a, a) + (c(i, i) + c(j, j)) / 2 + 1e-6)
            who = lambda x: doctors.take(pa.array((first[rows][:, None] + x).ravel()))  # noqa: E731, B023
            yield [scans.take(pa.array(np.repeat(rows, len(a)))), who(a), who(i), who(j), pa.array(score.ravel()), pa.array(np.tile(least, len(rows)))]
        lone = np.flatnonzero((number >= 3) & (unknown > 0))
        if len(lone):
            yield [scans.take(pa.array(lone)), *[pa.nulls(len(lone), doctors.type)] * 3, pa.nulls(len(lone), pa.float64()), pa.array(np.zeros(len(lone), np.int64))]

    return _per_scan(nodules, factor, make, "seriesuid #, DoctorID @, doc_i @, doc_j @, score double, first bigint")


def consilium_scores(nodules: DataFrame, factor: float = 0.3) -> DataFrame:
    """seriesuid, DoctorID, doc_i, doc_j and the dice of the doctor's mask and the mean of the pair's.

    Only sizes and pairwise intersections of masks are needed: sum(a * (b + c) / 2) = (|ab| + |ac|) / 2.
    """
    return _consiliums(nodules, factor).where("DoctorID IS NOT NULL").drop("first")


def pair_table(nodules: DataFrame, factor: float = 0.3) -> DataFrame:
    """doc_i, doc_j, mean dice of their masks over common scans, and the number of these."""

    def make(scans, number, unknown, doctors, counts):
        import numpy as np
        import pyarrow as pa

        first, square = np.cumsum(number) - number, np.cumsum(number * number) - number * number
        for n, rows in _blocks(number, 2, lambda n: n * (n - 1) // 2):
            i, j = np.triu_indices(n, 1)
            c = lambda x, y: counts[square[rows][:, None] + x * n + y].astype(float)  # noqa: E731, B023
            score = (2 * c(i, j) + 1e-6) / (c(i, i) + c(j, j) + 1e-6)
            who = lambda x: doctors.take(pa.array((first[rows][:, None] + x).ravel()))  # noqa: E731, B023
            yield [who(i), who(j), pa.array(score.ravel())]

    every = _per_scan(nodules, factor, make, "doc_i @, doc_j @, dice double")
    return every.groupBy("doc_i", "doc_j").agg(F.avg("dice").alias("mean_dice"), F.count("*").alias("meetings"))


def doctor_confidences(nodules: DataFrame, n_iters: int = 25, alpha: float = 0.7, factor: float = 0.3, start: float = 0.5, n_consiliums: int | None = None, seed: int = 42) -> DataFrame:
    """DoctorID, iteration and confidence, from 0 to n_iters.

    Scores do not depend on confidences, so with all consiliums each iteration is c' = alpha c + (1 - alpha) (c + S) / W with
    the doctor's sums W of weights 1 / P(pair) and S of weight * score. With n_consiliums, each iteration
    takes its own hash-seeded sample of each doctor's consiliums. Doctors without any keep their confidence.

    Scans of three doctors or more count. With all consiliums they are gone through once: sums per doctor and pair are what is left.
    """
    every = _consiliums(nodules.dropna(subset=["coordX", "coordY", "coordZ", "diameter_mm"]), factor)
    if n_consiliums is None:
        tripled = every.groupBy("DoctorID", "doc_i", "doc_j").agg(F.count("score").alias("n"), F.sum("score").alias("s"), F.sum("first").alias("m"))
        met = F.nullif(F.sum("m").over(Window.partitionBy("doc_i", "doc_j")), F.lit(0))
        parts = tripled.withColumn("_met", met).groupBy("DoctorID").agg(F.sum(F.col("n") / F.col("_met")).alias("W"), F.sum(F.col("s") / F.col("_met")).alias("S"), F.sum("m").alias("m"))
        total = F.sum("m").over(Window.partitionBy())  # one row a doctor
        steps = parts.select("DoctorID", (total * F.col("W")).alias("W"), (total * F.col("S")).alias("S")).select("DoctorID", F.array_repeat(F.struct("W", "S"), n_iters).alias("steps"))
    else:
        met = every.groupBy("doc_i", "doc_j").agg(F.sum("first").alias("_met")).where("_met > 0")
        whole = F.broadcast(met.agg(F.sum("_met").alias("_total")))  # one row
        weighed = every.join(met.crossJoin(whole), ["doc_i", "doc_j"]).select("DoctorID", "seriesuid", "doc_i", "doc_j", (F.col("_total") / F.col("_met")).alias("w"), "score")
        everyone = every.select("DoctorID").distinct()
        repeated = weighed.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(n_iters))))
        order = Window.partitionBy("DoctorID", "iteration").orderBy(F.xxhash64(F.lit(seed), "iteration", "seriesuid", "doc_i", "doc_j"))
        sample = repeated.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n_consiliums)
        sums = sample.groupBy("DoctorID", "iteration").agg(F.sum("w").alias("W"), F.sum(F.col("w") * F.col("score")).alias("S"))
        listed = sums.groupBy("DoctorID").agg(F.sort_array(F.collect_list(F.struct("iteration", "W", "S"))).alias("steps"))
        steps = everyone.join(listed, "DoctorID", "left").select("DoctorID", F.coalesce(F.transform("steps", lambda s: F.struct(s["W"].alias("W"), s["S"].alias("S"))), F.array_repeat(F.struct(F.lit(None).cast("double").alias("W"), F.lit(None).cast("double").alias("S")), n_iters)).alias("steps"))
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, s: F.array_append(acc, F.when(s["W"].isNull(), last(acc)).otherwise(alpha * last(acc) + (1 - alpha) * (last(acc) + s["S"]) / s["W"]))
    path = F.aggregate("steps", F.array(F.lit(float(start))), step)
    return steps.select("DoctorID", F.posexplode(path).alias("iteration", "confidence"))


def rolling_confidence(history: DataFrame, smooth: int) -> DataFrame:
    """Per doctor the mean of the last smooth confidences; null where there are fewer."""
    order = Window.partitionBy("DoctorID").orderBy(F.desc("iteration"))
    last = history.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= smooth)
    return last.groupBy("DoctorID").agg(F.when(F.count("*") == smooth, F.avg("confidence")).alias("confidence"))


def moving_mean(history: DataFrame, smooth: int, key: str, order: str, value: str) -> DataFrame:
    """Trailing mean over smooth rows, null before so many."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(smooth - 1), 0)
    return history.withColumn("mean", F.when(F.count("*").over(w) == smooth, F.avg(value).over(w)))


def rating(confidences: DataFrame) -> DataFrame:
    """Doctors by falling confidence; ties to the smaller id. One row per doctor goes to one task."""
    return confidences.withColumn("rating", F.row_number().over(Window.orderBy(F.desc("confidence"), "DoctorID")))
