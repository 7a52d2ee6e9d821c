"""Seeded sampling, batches and crops. Draws come from hashes of ids, so reruns and lost tasks agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES, fit_start, zyx
from ..functions.voxels import dim
from . import volumes


def uniform(seed: int, *keys) -> Column:
    """In [0, 1), from the first 32 bits of the MD5 of seed and keys (columns or constants), joined by bars."""
    cols = [(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *cols)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int, *keys) -> Column:
    u = 1 - uniform(seed, "u", *keys)
    return F.sqrt(-2 * F.ln(u)) * F.cos(6.283185307179586 * uniform(seed, "v", *keys))


class Sampler:
    """A random quantity: a column given a seed and keys. Samplers add and multiply, and are mixed by |."""

    def __init__(self, make, weight: float = 1.0):
        self.make, self.weight = make, weight

    @classmethod
    def uniform(cls, low: float = 0.0, high: float = 1.0) -> Sampler:
        return cls(lambda seed, *keys: low + (high - low) * uniform(seed, *keys))

    @classmethod
    def normal(cls, mean: float = 0.0, sigma: float = 1.0) -> Sampler:
        return cls(lambda seed, *keys: mean + sigma * normal(seed, *keys))

    @classmethod
    def constant(cls, value: float) -> Sampler:
        return cls(lambda seed, *keys: F.lit(float(value)))

    def _with(self, other, rule) -> Sampler:
        other = other if isinstance(other, Sampler) else Sampler.constant(other)
        return Sampler(lambda seed, *keys: rule(self.make(seed, "left", *keys), other.make(seed, "right", *keys)))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    def weighed(self, weight: float) -> Sampler:
        return Sampler(self.make, weight)

    def __or__(self, other: Sampler) -> Sampler:
        share, total = self.weight / (self.weight + other.weight), self.weight + other.weight
        return Sampler(lambda seed, *keys: F.when(uniform(seed, "which", *keys) < share, self.make(seed, "left", *keys)).otherwise(other.make(seed, "right", *keys)), total)

    def truncate(self, low=None, high=None, tries: int = 8) -> Sampler:
        """Drawn again, up to tries times, while outside; then moved to the nearest bound."""

        def make(seed, *keys):
            draws = [self.make(seed, f"try{k}", *keys) for k in range(tries)]
            inside = lambda c: (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
            last = draws[-1]
            if low is not None:
                last = F.greatest(last, F.lit(float(low)))
            if high is not None:
                last = F.least(last, F.lit(float(high)))
            return F.coalesce(*[F.when(inside(d), d) for d in draws], last)

        return Sampler(make, self.weight)

    def sample(self, seed: int, *keys) -> Column:
        return self.make(seed, *keys)


def split(df: DataFrame, shares, seed: int = 42, key: str = "scan_id") -> list[DataFrame]:
    """Parts of the given shares by a hash of key; a last share that is left out is the rest."""
    shares = [float(s) for s in (shares if isinstance(shares, (list, tuple)) else [shares])]
    if sum(shares) < 1 - 1e-9:
        shares.append(1 - sum(shares))
    u, low, parts = uniform(seed, F.col(key)), 0.0, []
    for k, s in enumerate(shares):
        high = low + s if k < len(shares) - 1 else 2.0
        parts.append(df.where((u >= low) & (u < high)))
        low = high
    return parts


def batch_numbers(df: DataFrame, batch_size: int, order, drop_last: bool = False) -> DataFrame:
    """batch_no and the row's place in its batch, along an order.

    The order's rows are numbered by one task, so number ids, not pixels: join these back by id.
    """
    rows = df.withColumn("_n", F.row_number().over(Window.orderBy(*(order if isinstance(order, (list, tuple)) else [order]))) - 1)
    rows = rows.withColumns({"batch_no": F.floor(F.col("_n") / batch_size).cast("int"), "place": F.pmod(F.col("_n"), F.lit(batch_size)).cast("int")}).drop("_n")
    if drop_last:
        rows = rows.withColumn("_c", F.count("*").over(Window.partitionBy("batch_no"))).where(F.col("_c") == batch_size).drop("_c")
    return rows


def split_batch(df: DataFrame, k: int, order) -> tuple[DataFrame | None, DataFrame | None]:
    """The first k rows of an order, and the others; None for an empty part."""
    if k <= 0:
        return None, df
    first = df.orderBy(order).limit(k)
    rest = df.orderBy(order).offset(k)
    return (first, None) if rest.isEmpty() else (first, rest)


def concat(*parts: DataFrame | None, order=None) -> DataFrame | None:
    """Rows of all parts with an index from 0; None without any part."""
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    rows = parts[0].withColumn("_part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("_part", F.lit(k)), allowMissingColumns=True)
    return rows.withColumn("index", F.row_number().over(Window.orderBy("_part", order or parts[0].columns[0])) - 1).drop("_part")


def merge(*parts: DataFrame | None, batch_size: int | None = None, order=None) -> tuple[DataFrame | None, DataFrame | None]:
    """All parts as one, cut at batch_size."""
    whole = concat(*parts, order=order)
    return (whole, None) if whole is None or batch_size is None else split_batch(whole, batch_size, F.col("index"))


def merge_by_batch(first: DataFrame, second: DataFrame, sizes, order, drop_last: bool = True) -> DataFrame:
    """Batches made of sizes[0] rows of first and sizes[1] of second, as far as both have them."""
    a = batch_numbers(first, sizes[0], order, drop_last).withColumn("part", F.lit(0))
    b = batch_numbers(second, sizes[1], order, drop_last).withColumn("part", F.lit(1))
    whole = a.unionByName(b)
    return whole.withColumn("_p", F.size(F.collect_set("part").over(Window.partitionBy("batch_no")))).where("_p = 2").drop("_p")


def hex_name(length: int, seed: int, *keys) -> Column:
    """A deterministic hex id of columns and a seed."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]), 256), 1, length)


def nodule_starts(nodules: DataFrame, scans: DataFrame, size, variance=None, seed: int = 42) -> DataFrame:
    """scan_id, nodule_id and start: boxes of size around findings (shifted at random), inside their scans."""
    rows = nodules.join(scans.select("scan_id", "shape", "spacing", "origin"), "scan_id")
    if variance:
        # one small expression for the three axes: spelled out, the generated method is too large for the JVM to compile
        rows = rows.withColumn("_draws", F.transform(F.array(*map(F.lit, AXES)), lambda a: normal(seed, a, F.col("scan_id"), F.col("nodule_id"))))
    start = []
    for k, a in enumerate(AXES):
        base = fit_start(F.col(f"center.{a}"), F.col(f"origin.{a}"), F.col(f"spacing.{a}"), size[k], dim(a)) if not variance else _shifted(a, size[k], variance[k], F.col("_draws")[k])
        start.append(F.when(base < 0, F.raise_error(F.lit("the crop is larger than the scan"))).otherwise(base))
    return rows.select("scan_id", "nodule_id", zyx(*start).alias("start"))


def _shifted(a: str, size: int, variance: float, draw: Column) -> Column:
    at = F.rint(F.abs(F.col(f"center.{a}") - F.col(f"origin.{a}")) / F.col(f"spacing.{a}")) - float(round(size / 2))
    at = at + draw * math.sqrt(int(variance))
    at = F.greatest(F.least(at, (dim(a) - size).cast("double")), F.lit(0.0))
    return F.when(dim(a) < size, F.lit(-1)).otherwise(at.cast("int"))


def random_starts(scans: DataFrame, n: int, size, seed: int = 42, histo=None) -> DataFrame:
    """n rows scan_id, nodule_id (null) and start: random scans with replacement, random places in them.

    histo, if given, is (counts, edges) of numpy's histogramdd: places follow it, rescaled to each scan.
    Scans are drawn by rank, over a table of ids alone.
    """
    spark = scans.sparkSession
    # rank and number without pixels
    ids = scans.select("scan_id", "shape").withColumn("_rank", F.row_number().over(Window.orderBy("scan_id")) - 1)
    total = F.broadcast(scans.agg(F.count("*").alias("_total")))
    draws = spark.range(n).crossJoin(total).where("_total > 0").withColumn("_rank", F.floor(uniform(seed, "scan", F.col("id")) * F.col("_total")).cast("int"))
    rows = _random_places(draws.join(ids, "_rank"), size, seed, histo)
    return rows.select("scan_id", F.lit(None).cast("string").alias("nodule_id"), "start", "id")


def _random_places(rows: DataFrame, size, seed: int, histo=None) -> DataFrame:
    """rows (with id and shape) and start."""
    if histo is None:
        start = [F.floor(uniform(seed, a, F.col("id")) * (dim(a) - size[k] + 1)).cast("int") for k, a in enumerate(AXES)]
    else:
        rows, edges = sample_histogram(rows, histo, seed), histo[1]
        top = [float(e[-1]) for e in edges]
        start = [F.floor(F.col(f"h_{a}") * (dim(a) - size[k]) / top[k]).cast("int") for k, a in enumerate(AXES)]
    return rows.withColumn("start", zyx(*start))


def sample_histogram(rows: DataFrame, histo, seed: int = 42) -> DataFrame:
    """rows (with id) and h_z, h_y, h_x: a bin in proportion to its count, and a uniform place in it.

    The bins are a literal of the histogram's size, looked up by binary intervals of the running sum.
    """
    counts, edges = histo
    flat = [float(x) for plane in counts for line in plane for x in line]
    total, run = sum(flat) or 1.0, 0.0
    bins = []
    ny, nx = len(edges[1]) - 1, len(edges[2]) - 1
    for p, c in enumerate(flat):
        z, y, x = p // (ny * nx), (p // nx) % ny, p % nx
        if c:
            bins.append((run / total, (run + c) / total, *[float(v) for e, k in zip(edges, (z, y, x), strict=True) for v in (e[k], e[k + 1])]))
        run += c
    names = "_lo double, _hi double, z0 double, z1 double, y0 double, y1 double, x0 double, x1 double"
    table = rows.sparkSession.createDataFrame(bins, names)
    u = uniform(seed, "bin", F.col("id"))
    met = rows.withColumn("_u", u).join(F.broadcast(table), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    inner = {f"h_{a}": F.col(f"{a}0") + uniform(seed, f"in{a}", F.col("id")) * (F.col(f"{a}1") - F.col(f"{a}0")) for a in AXES}
    return met.withColumns(inner).drop("_u", *[n.split()[0] for n in names.split(", ")])


def triples(a, b, c, spark: SparkSession) -> DataFrame:
    """All (a, b, c) of three lists, in order: n, a, b, c."""
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, a))).alias("a"))
    for name, values in (("b", b), ("c", c)):
        rows = rows.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return rows


def ellipsoid_region(rows: DataFrame, center, axes, mult_range=(0.8, 1.2), seed: int = 42) -> DataFrame:
    """rows (with id) and z, y, x: points of an ellipsoidal shell; the pole is the last axis, latitudes are uniform in -90..90 degrees."""
    longitude = 6.283185307179586 * uniform(seed, "longitude", F.col("id"))
    latitude = 3.141592653589793 * (uniform(seed, "latitude", F.col("id")) - 0.5)
    r = mult_range[0] + (mult_range[1] - mult_range[0]) * uniform(seed, "r", F.col("id"))
    unit = (F.cos(latitude) * F.cos(longitude), F.cos(latitude) * F.sin(longitude), F.sin(latitude))
    return rows.withColumns({a: float(c) + float(x) * r * u for a, c, x, u in zip(AXES, center, axes, unit, strict=True)})


def sample_nodules(scans: DataFrame, nodules: DataFrame, size=(32, 64, 64), batch_size: int | None = 20, share: float = 0.8, variance=None, histo=None, seed: int = 42, columns=("images",)) -> DataFrame:
    """Crops: min(int(share * batch_size), findings) around findings drawn without replacement, the others at random.

    Without batch_size there are findings / share crops. Only starts are ranked; pixels meet them by scan_id.
    """
    starts = sample_starts(scans, nodules, size, batch_size, share, variance, histo, seed)
    return volumes.crops(scans, starts, size, columns)


def sample_per_run(scans: DataFrame, nodules: DataFrame, size, batch_size: int, share: float, run_size: int, variance=None, histo=None, seed: int = 42, columns=("images",)) -> DataFrame:
    """sample_nodules within each run of run_size scans, in the order of their ids; crops carry run.

    Scans are numbered by ids alone, as are the findings of a run; pixels meet the starts by scan_id.
    """
    if not 0 <= share <= 1:
        raise ValueError("share lies in 0..1")
    runs = batch_numbers(scans.select("scan_id"), run_size, "scan_id").withColumnsRenamed({"batch_no": "run", "place": "_place"})
    most = int(share * batch_size)
    placed = nodule_starts(nodules.join(scans.select("scan_id"), "scan_id", "left_semi"), scans, size, variance, seed).join(runs.select("scan_id", "run"), "scan_id")
    order = Window.partitionBy("run").orderBy(uniform(seed, "pick", F.col("scan_id"), F.col("nodule_id")), "nodule_id")
    placed = placed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    placed = placed.withColumn("crop_id", F.concat_ws("_", F.col("scan_id").cast("string"), hex_name(8, seed, F.col("nodule_id"))))
    # as many random places as a run's findings leave, each in a scan of the run
    per_run = runs.groupBy("run").agg(F.count("*").alias("_scans")).join(placed.groupBy("run").agg(F.count("*").alias("_own")), "run", "left")
    free = per_run.where(F.coalesce("_own", F.lit(0)) < batch_size).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(batch_size) - F.coalesce("_own", F.lit(0)) - 1)))
    draws = free.withColumn("id", F.concat_ws("_", "run", "_k")).withColumn("_place", F.floor(uniform(seed, "scan", F.col("id")) * F.col("_scans")).cast("int"))
    rows = draws.join(runs, ["run", "_place"]).join(scans.select("scan_id", "shape"), "scan_id")
    others = _random_places(rows, size, seed, histo)
    others = others.withColumn("crop_id", F.concat_ws("_", F.col("scan_id").cast("string"), hex_name(8, seed, F.lit("random"), F.col("id"))))
    cols = ["scan_id", "nodule_id", "start", "crop_id", "run"]
    starts = placed.withColumn("nodule_id", F.col("nodule_id").cast("string")).select(*cols).unionByName(others.withColumn("nodule_id", F.lit(None).cast("string")).select(*cols))
    return volumes.crops(scans, starts, size, columns, ("run",))


def sample_starts(scans: DataFrame, nodules: DataFrame, size, batch_size, share, variance=None, histo=None, seed: int = 42) -> DataFrame:
    if not 0 <= share <= 1:
        raise ValueError("share lies in 0..1")
    if batch_size is None and share == 0:
        raise ValueError("share 0 needs a batch size")
    own = nodules.join(scans.select("scan_id"), "scan_id", "left_semi")
    if batch_size is None:
        # all findings; their number matters only to what is added to them
        cancer = own.count() if share < 1 else 0
        whole, picked = int(cancer / share), own
    else:
        whole, most = int(batch_size), int(share * batch_size)
        cancer = own.limit(most).count() if most > 0 else 0  # one number; no more than most rows are looked at in a task
        picked = own if 0 < cancer < most else _first(own, cancer, uniform(seed, "pick", F.col("scan_id"), F.col("nodule_id")), "nodule_id")
    placed = nodule_starts(picked, scans, size, variance, seed)
    placed = placed.withColumn("crop_id", F.concat_ws("_", F.col("scan_id").cast("string"), hex_name(8, seed, F.col("nodule_id"))))
    if whole <= cancer:
        return placed
    others = random_starts(scans, whole - cancer, size, seed, histo)
    others = others.withColumn("crop_id", F.concat_ws("_", F.col("scan_id").cast("string"), hex_name(8, seed, F.lit("random"), F.col("id")))).drop("id")
    if cancer == 0:
        return others
    return placed.withColumn("nodule_id", F.col("nodule_id").cast("string")).unionByName(others)


#: The most rows that each task keeps of an order.
TOP = 100_000


def _first(rows: DataFrame, k: int, u: Column, tie: str) -> DataFrame:
    """The k rows of least u (in [0, 1)) and tie. No order of all rows is made: a task keeps k at most, or, for a large k,
    all below a share of u that holds nearly so many and the first of the next share."""
    if k <= TOP:
        return rows.orderBy(u, tie).limit(k)
    share = F.floor(u * 65536).cast("int")
    below = 0
    for at, n in sorted((r[0], r[1]) for r in rows.groupBy(share.alias("_share")).count().collect()):  # 65,536 numbers at most
        if below + n >= k:
            rest = _first(rows.where(share == at), k - below, u, tie) if k - below <= TOP else _ranked(rows.where(share == at), k - below, u, tie)
            return rows.where(share < at).unionByName(rest)
        below += n
    return rows


def _ranked(rows: DataFrame, k: int, u: Column, tie: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.orderBy(u, tie))).where(F.col("_n") <= k).drop("_n")


def sample_rounds(scans: DataFrame, nodules: DataFrame, rounds: int, seed: int = 42, **options) -> DataFrame:
    """sample_nodules so many times with other seeds, as one table with a column round."""
    size = options.get("size", (32, 64, 64))
    rest = {k: v for k, v in options.items() if k not in ("size", "columns")}
    starts = None
    for k in range(rounds):
        part = sample_starts(scans, nodules, size, rest.get("batch_size", 20), rest.get("share", 0.8), rest.get("variance"), rest.get("histo"), seed + k)
        part = part.withColumn("round", F.lit(k)).withColumn("crop_id", F.concat_ws("_", "crop_id", F.lit(str(k))))
        starts = part if starts is None else starts.unionByName(part)
    return volumes.crops(scans, starts, size, options.get("columns", ("images",)), ("round",))


def sample_xip(scans: DataFrame, depth: int, stride: int, batch_size: int = 20, share: float = 0.5, seed: int = 42, **options) -> DataFrame:
    """Projections of images and masks: int(batch_size * share) slices whose mask isn't empty, the others of any kind, in random order."""
    squeeze = options.pop("squeeze", (False, True))
    channels = options.pop("channels", 3)
    images = volumes.xip(scans, depth, stride=stride, squeeze=squeeze[0], channels=channels, **options)
    masks = volumes.xip(scans.withColumn("images", F.col("masks")), depth, stride=stride, squeeze=squeeze[1], channels=channels, **options)
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(dim("z") - 1, F.lit(0))), lambda k: F.slice(c, (k * dim("y") * dim("x") * F.col("channels") + 1).cast("int"), (dim("y") * dim("x") * F.col("channels")).cast("int")))
    a = images.where(dim("z") > 0).select("scan_id", F.posexplode(cut("images")).alias("slice_no", "pixels"))
    b = masks.where(dim("z") > 0).select("scan_id", F.posexplode(cut("images")).alias("slice_no", "mask"))
    rows = a.join(b, ["scan_id", "slice_no"]).withColumn("cancer", F.exists("mask", lambda v: v > 0))
    n = int(batch_size * share)
    order = lambda salt: (uniform(seed, salt, F.col("scan_id"), F.col("slice_no")), "scan_id", "slice_no")
    true = rows.where("cancer").orderBy(*order(1)).limit(n)
    others = rows.orderBy(*order(2)).limit(batch_size - n)
    return true.unionByName(others).orderBy(*order(3))
