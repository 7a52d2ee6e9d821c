"""Operators on scans: DataFrame -> DataFrame, columns scan_id, shape, spacing, origin, images and others kept.

Every one works within its row. Gathers and element-wise rules are built-in functions; moving windows and resampling
are Arrow kernels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.geometry import AXES, clip, each, linear, rescaled, zyx
from ..functions.voxels import dim, source_index, span, take


def _dims(shape) -> Column:
    return zyx(*[F.lit(int(n)) for n in shape])


def _array(struct: Column) -> Column:
    return F.array(*[struct[a] for a in AXES])


def _shifted(n: int, start: Column) -> Column:
    """start .. start + n - 1."""
    return F.transform(span(n), lambda i: i + start)


def normalize_hu(scans: DataFrame, min_hu: float = -1000, max_hu: float = 400, column: str = "images") -> DataFrame:
    return scans.withColumn(column, F.transform(column, lambda v: clip((v - float(min_hu)) / float(max_hu - min_hu), 0.0, 1.0) * 255))


def to_hu(pixels: Column, slope: Column, intercept: Column) -> Column:
    """Stored pixels of a slice to Hounsfield units: -2000 is air, the product with slope and the intercept truncate."""
    base = lambda v: F.when(v == -2000, 0).otherwise(v)
    scaled = lambda v: F.when(slope == 1, base(v)).otherwise((base(v) * slope).cast("int"))
    return F.transform(pixels, lambda v: (scaled(v) + intercept.cast("int")).cast("short"))


def gather(scans: DataFrame, zs: Column, ys: Column, xs: Column, shape: Column, columns=("images",), fill=None) -> DataFrame:
    """The columns' voxels at (zs x ys x xs), in a scan of the given shape."""
    # shape in a step of its own: in one select, lambdas would see the new one (a lateral alias)
    return scans.withColumns({c: take(F.col(c), F.col("shape"), zs, ys, xs, fill) for c in columns}).withColumn("shape", shape)


def flip(scans: DataFrame, columns=("images",)) -> DataFrame:
    """Reverse the order of slices."""
    nz = dim("z")
    return gather(scans, F.reverse(span(nz)), span(dim("y")), span(dim("x")), F.col("shape"), columns)


def central_crop(scans: DataFrame, size, columns=("images",)) -> DataFrame:
    """Crop about the centre; the origin moves by spacing * rint(crop / 2). A smaller scan raises."""
    fits = [F.lit(int(k)) <= dim(a) for a, k in zip(AXES, size, strict=True)]
    guard = F.when(fits[0] & fits[1] & fits[2], F.col("shape")).otherwise(F.raise_error(F.lit("the crop is larger than the scan")))
    scans = scans.withColumn("shape", guard)
    first = {a: (F.rint(dim(a) / 2) - F.lit(-(-int(k) // 2))).cast("int") for a, k in zip(AXES, size, strict=True)}
    index = [_shifted(int(k), first[a]) for a, k in zip(AXES, size, strict=True)]
    half = dict(zip(AXES, (float(round(k / 2)) for k in size), strict=True))
    moved = scans.withColumn("origin", each(lambda a: F.col(f"origin.{a}") + F.col(f"spacing.{a}") * half[a]))
    return gather(moved, *index, _dims(size), columns)


def to_shape(scans: DataFrame, shape, padding: str = "edge", columns=("images",), fill: float = 0.0) -> DataFrame:
    """Centre crop, then pad, to shape; padding edge, reflect or constant."""
    index = [source_index(dim(a), m, padding) for a, m in zip(AXES, shape, strict=True)]
    return gather(scans, *index, _dims(shape), columns, fill if padding == "constant" else None)


def crops(scans: DataFrame, starts: DataFrame, size, columns=("images",), keep=()) -> DataFrame:
    """A row per row of starts (scan_id, crop_id, start: struct): boxes of fixed size at integer starts.

    Starts join their scan by scan_id; origin + spacing * start is a crop's origin. keep names further columns of starts.
    """
    joined = scans.join(starts.select("scan_id", "crop_id", "start", *keep), "scan_id")
    moved = joined.withColumn("origin", each(lambda a: F.col(f"origin.{a}") + F.col(f"spacing.{a}") * F.col(f"start.{a}")))
    return moved.withColumns({c: _box(c, size) for c in columns}).withColumn("shape", _dims(size))


def _box(column: str, size) -> Column:
    """The box of size at start: lines along x are cut whole, where it lies inside the scan."""
    nz, ny, nx = (int(k) for k in size)
    index = [_shifted(int(k), F.col(f"start.{a}")) for a, k in zip(AXES, size, strict=True)]
    inside = F.col(column).isNotNull()
    for a, k in zip(AXES, size, strict=True):
        inside = inside & (F.col(f"start.{a}") >= 0) & (F.col(f"start.{a}") + int(k) <= dim(a))
    line = lambda z, y: F.slice(F.col(column), ((F.col("start.z") + z) * dim("y") + F.col("start.y") + y) * dim("x") + F.col("start.x") + 1, nx)
    if nz * ny <= 64:
        cut = F.concat(*[line(z, y) for z in range(nz) for y in range(ny)]) if nz * ny else F.slice(F.col(column), 1, 0)
    else:
        cut = F.flatten(F.transform(span(nz), lambda z: F.flatten(F.transform(span(ny), lambda y: line(z, y)))))
    return F.when(inside, cut).otherwise(take(F.col(column), F.col("shape"), *index))


def axial_slice(scans: DataFrame, height: float, column: str = "images", mask: str | None = None) -> DataFrame:
    """scan_id, number and pixels of the slice int(height * nz); with mask (a column's name) also mask, null where the scan has none."""
    number = (F.lit(float(height)) * dim("z")).cast("int")
    area = dim("y") * dim("x")
    cut = lambda c: F.slice(c, number * area + 1, area)
    more = [] if mask is None else [(cut(mask) if mask in scans.columns else F.lit(None).cast("array<double>")).alias("mask")]
    return scans.select("scan_id", number.alias("number"), cut(column).alias("pixels"), *more)


def truncate_mask(scans: DataFrame, threshold: float = 0.2, min_val: float = 0, max_val: float = 255) -> DataFrame:
    over = lambda m, v: (m * v > threshold * (max_val - min_val)).cast("int").cast("double")
    return scans.withColumn("masks", F.zip_with("masks", "images", over))


def binarize_mask(scans: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Values up to the threshold become 0; others stay as they are."""
    return scans.withColumn("masks", F.transform("masks", lambda m: F.when(m > threshold, m).otherwise(0.0)))


def trim_uint8(scans: DataFrame, limits=None, column: str = "images") -> DataFrame:
    """Clip to limits (else the scan's own range) and spread over 0..255, whole numbers; a constant scan becomes 0."""
    low, high = (F.lit(float(x)) for x in limits) if limits else (F.array_min(column), F.array_max(column))
    ends = F.struct(low.alias("low"), high.alias("high"))

    def one(v, e):
        share = (F.least(F.greatest(v, e["low"]), e["high"]) - e["low"]) / F.nullif(e["high"] - e["low"], F.lit(0.0))
        return F.coalesce(F.rint(share * 255), F.lit(0.0)).cast("int")

    # the ends once per row, not once per voxel
    return scans.withColumn(column, F.flatten(F.transform(F.array(ends), lambda e: F.transform(F.col(column), lambda v: one(v, e)))))


def get(scans: DataFrame, item, component: str = "images") -> DataFrame:
    """A scan's component by its id, or by its position (from 0) in the order of ids; a position beyond the end raises."""
    if not isinstance(item, int):
        return scans.where(F.col("scan_id") == item).select("scan_id", component)
    ids = scans.select("scan_id").orderBy("scan_id").offset(max(item, 0)).limit(1)
    if item < 0 or ids.isEmpty():
        raise IndexError(f"no scan at position {item}")
    return scans.join(ids, "scan_id", "left_semi").select("scan_id", component)


def unpack(scans: DataFrame, component: str = "images", channel_axis: bool = False) -> DataFrame:
    """scan_id and the component as nested arrays z, y, x (and a channel of one value); null where there is no such column."""
    if component not in scans.columns:
        return scans.select("scan_id", F.lit(None).alias(component))
    ny, nx = dim("y"), dim("x")
    value = (lambda v: F.array(v)) if channel_axis else (lambda v: v)
    line = lambda z, y: F.transform(F.slice(component, (z * ny + y) * nx + 1, nx), value)
    nested = F.transform(span(dim("z")), lambda z: F.transform(span(ny), lambda y: line(z, y)))
    return scans.select("scan_id", nested.alias(component))


def ones(ids: DataFrame, shape=(32, 64, 64)) -> DataFrame:
    """A scan of ones for each scan_id."""
    n = shape[0] * shape[1] * shape[2]
    return ids.select("scan_id", _dims(shape).alias("shape"), zyx(1.0, 1.0, 1.0).alias("spacing"), zyx(0.0, 0.0, 0.0).alias("origin"), F.array_repeat(F.lit(1.0), n).alias("images"))


def encode_linear(scans: DataFrame, column: str = "images") -> DataFrame:
    """codes (tinyint) with low and high: [low, high] goes to [-128, 127]; a constant volume has codes 0."""
    low, high = F.array_min(column), F.array_max(column)
    slope = 255 / F.nullif(high - low, F.lit(0.0))
    code = lambda v: F.coalesce(F.rint(slope * v - 128 - slope * low), F.lit(0.0)).cast("tinyint")
    return scans.withColumns({"codes": F.transform(column, code), "low": low, "high": high}).drop(column)


def decode_linear(encoded: DataFrame, column: str = "images") -> DataFrame:
    low, high = F.col("low"), F.col("high")
    return encoded.withColumn(column, F.transform("codes", lambda c: F.when(low == high, low).otherwise((c + 128) * ((high - low) / 255) + low))).drop("codes", "low", "high")


def encode_quantized(scans: DataFrame, column: str = "images", clusters: int = 256) -> DataFrame:
    """codes (tinyint) and centers: k-means of each volume's values."""

    def both(image):
        codes, centers = kernels.quantize(image, clusters)
        return codes.tolist() + centers.tolist()

    packed = kernels.per_row(both, "array<double>")(F.col(column), F.col("shape"))
    n = F.size(column)
    split = scans.withColumn("_packed", packed).withColumns({"codes": F.transform(F.slice("_packed", 1, n), lambda c: c.cast("tinyint")), "centers": F.slice("_packed", n + 1, clusters)})
    return split.drop("_packed", column)


def decode_quantized(encoded: DataFrame, column: str = "images") -> DataFrame:
    return encoded.withColumn(column, F.transform("codes", lambda c: F.get("centers", c.cast("int") + 128))).drop("codes", "centers")


def rescale(scans: DataFrame, new_shape) -> DataFrame:
    """Spacing after resampling to new_shape."""
    new = dict(zip(AXES, new_shape, strict=True))
    return scans.withColumn("spacing", each(lambda a: rescaled(F.col(f"spacing.{a}"), dim(a), F.lit(float(new[a])))))


METHODS = ("linear", "lanczos", "nearest", "spline")


def _resampler(method: str, order: int, axes_pairs=None):
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; one of {METHODS}")
    for a, b in axes_pairs or ():
        if a == b or not {a, b} <= {0, 1, 2}:
            raise ValueError(f"a pair has two of the axes 0, 1 and 2, not {(a, b)}")
    if method == "spline":
        return lambda image, shape: kernels.zoom(image, shape, order)
    if axes_pairs is None:
        return lambda image, shape: kernels.resize(image, shape, method)
    orders = [[*(k for k in range(3) if k != a), a] for a, _ in axes_pairs]
    return lambda image, shape: sum(kernels.resize(image, shape, method, o) for o in orders) / len(orders)


def resize(scans: DataFrame, shape=(128, 256, 256), method: str = "linear", order: int = 3, columns=("images",), axes_pairs=None) -> DataFrame:
    """Resample to shape; spacing follows, the origin stays.

    axes_pairs, for all methods but spline: the mean over pairs of axes; of each pair, planes across its first and then
    across its second axis are resampled. Without it axes are resampled in order.

    linear and lanczos are separable filters with pixel centres at half and rows of weights that sum to 1; spline maps first to
    first and last to last sample.
    """
    sample = kernels.per_row(_resampler(method, order, axes_pairs))
    target = F.array(*[F.lit(int(n)) for n in shape])
    done = scans.withColumns({c: sample(F.col(c), F.col("shape"), target) for c in columns})
    return rescale(done, shape).withColumn("shape", _dims(shape))


def unify_spacing(scans: DataFrame, spacing=(1.0, 1.0, 1.0), shape=(128, 256, 256), method: str = "linear", order: int = 3, padding: str = "edge", columns=("images",), axes_pairs=None) -> DataFrame:
    """Resample to nearly the spacing asked for, then crop or pad to shape; spacing and origin are the actual ones."""
    want, out = dict(zip(AXES, spacing, strict=True)), dict(zip(AXES, shape, strict=True))
    scans = scans.withColumn("_m", each(lambda a: F.rint(dim(a) * F.col(f"spacing.{a}") / float(want[a])).cast("int")))
    sample = _resampler(method, order, axes_pairs)
    kernel = kernels.per_row(lambda image, m: kernels.to_shape(sample(image, m), shape, padding))
    done = scans.withColumns({c: kernel(F.col(c), F.col("shape"), _array(F.col("_m"))) for c in columns})
    done = done.withColumn("spacing", each(lambda a: F.col(f"spacing.{a}") * dim(a) / F.col(f"_m.{a}")))
    done = done.withColumn("origin", each(lambda a: F.col(f"origin.{a}") + F.col(f"spacing.{a}") * F.floor((F.col(f"_m.{a}") - out[a]) / 2)))
    return done.withColumn("shape", _dims(shape)).drop("_m")


def rotate(scans: DataFrame, angle: float, columns=("images",), axes=(1, 2), random: bool = True, seed: int = 42) -> DataFrame:
    """Rotate by angle degrees, or by a share of it drawn per scan by a hash; all columns of a scan turn alike."""
    from .sampling import uniform

    draw = uniform(seed, "angle", F.col("scan_id")) if random else F.lit(1.0)
    kernel = kernels.per_row(lambda image, a: kernels.rotate(image, a, axes))
    return scans.withColumns({c: kernel(F.col(c), F.col("shape"), draw * float(angle)) for c in columns})


def _count(n: Column, depth: int, stride: int, start: int) -> Column:
    return F.greatest(F.floor((n - depth - start) / stride) + 1, F.lit(0)).cast("int")


def xip(scans: DataFrame, depth: int, mode="max", stride: int = 1, start: int = 0, projection: str = "axial", squeeze: bool = False, channels: int = 1, column: str = "images") -> DataFrame:
    """Intensity projections without padding: images become (slices, y, x, channels), described by shape and channels."""
    modes = [mode] if isinstance(mode, str) else list(mode)
    bad = [m for m in modes if m not in kernels.MODES]
    if bad:
        raise ValueError(f"unknown modes {bad}")
    kernel = kernels.per_row(lambda image: kernels.xip(image, depth, modes, stride, start, projection, squeeze, channels))
    order = [AXES[k] for k in kernels.PROJECTIONS[projection]]
    slices = F.floor(_count(dim(order[0]), depth, stride, start) / channels).cast("int")
    made = (1 if squeeze or channels == 1 else channels) * len(modes)
    done = scans.withColumns({column: kernel(F.col(column), F.col("shape")), "_shape": zyx(slices, dim(order[1]), dim(order[2])), "channels": F.lit(made)})
    return done.withColumn("shape", F.col("_shape")).drop("_shape")


def make_xip(scans: DataFrame, depth: int, stride: int = 1, mode: str = "max", projection: str = "axial", padding: str = "reflect", column: str = "images") -> DataFrame:
    """Padded projection along one axis; spacing follows the new shape."""
    kernel = kernels.per_row(lambda image: kernels.padded_xip(image, depth, stride, mode, projection, padding))
    axis = AXES[kernels.PROJECTIONS[projection][0]]
    pad = depth // 2 + F.floor(F.pmod(dim("z") - 2 * (depth // 2), F.lit(stride)) / 2)
    size = {a: dim(a) for a in AXES} | {axis: _count(dim(axis) + 2 * pad, depth, stride, 0)}
    done = scans.withColumn(column, kernel(F.col(column), F.col("shape"))).withColumn("_shape", zyx(*[size[a].cast("int") for a in AXES]))
    return done.withColumn("spacing", each(lambda a: rescaled(F.col(f"spacing.{a}"), dim(a), F.col(f"_shape.{a}")))).withColumn("shape", F.col("_shape")).drop("_shape")


def unxip(scans: DataFrame, stack: str, depth: int, stride: int, start: int = 0, projection: str = "axial", squeeze: bool = True, channels: int = 1, adjust_nodule_size: bool = True, threshold: float = 0.95, dst: str = "masks") -> DataFrame:
    """Unfold the projections in column stack (slices, y, x of the projection) into a volume of the scan's shape, by sum over windows."""
    order = kernels.PROJECTIONS[projection]

    def kernel(image, flat):
        shape = [image.shape[k] for k in order]
        parts = 1 if squeeze else channels
        held = flat.reshape(-1, shape[1], shape[2], parts)
        if adjust_nodule_size:
            held = (held >= threshold).astype(float)
        whole = kernels.unfold(held, shape, depth, stride, start, channels, squeeze)
        if adjust_nodule_size:
            whole = kernels.refit_heights(whole)
        return whole.transpose(kernels.REVERSE[projection])

    return scans.withColumn(dst, kernels.per_row(kernel)(F.col("images"), F.col("shape"), F.col(stack)))


#: Bytes of boxes that leave a task in one Arrow batch.
BATCH_BYTES = 32 << 20


def get_patches(scans: DataFrame, patch, stride, padding: str = "edge", column: str = "images") -> DataFrame:
    """A row (scan_id, scan_shape, patch_no, pixels) per sliding box, in z-major order, after padding so that strides fit.

    Boxes are views of one padded scan and leave it some at a time, so a scan's boxes need never fit a value or memory together.
    """
    patch, stride = tuple(int(n) for n in patch), tuple(int(n) for n in stride)
    n = patch[0] * patch[1] * patch[2]

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        step = max(1, BATCH_BYTES // (8 * n))
        for batch in batches:
            ids, shapes, volumes = (batch.column(k) for k in range(3))
            for k in range(batch.num_rows):
                if not volumes[k].is_valid:
                    continue
                dims = tuple(shapes[k].as_py()[a] for a in AXES)
                boxes = kernels.box_view(np.asarray(volumes[k].values, float).reshape(dims), patch, stride, padding)
                total = boxes.shape[0] * boxes.shape[1] * boxes.shape[2]
                for at in range(0, total, step):
                    number = np.arange(at, min(total, at + step))
                    part = boxes[np.unravel_index(number, boxes.shape[:3])]
                    pixels = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, n), pa.int32()), pa.array(part.ravel()))
                    same = pa.array(np.full(len(number), k))
                    yield pa.RecordBatch.from_arrays([ids.take(same), shapes.take(same), pa.array(number.astype(np.int32)), pixels], ["scan_id", "scan_shape", "patch_no", "pixels"])

    held = scans.select("scan_id", F.col("shape").alias("scan_shape"), F.col(column).cast("array<double>"))
    kind = scans.schema["scan_id"].dataType.simpleString()
    return held.mapInArrow(cut, f"scan_id {kind}, scan_shape struct<z:int,y:int,x:int>, patch_no int, pixels array<double>")


def load_from_patches(patches: DataFrame, patch, stride, name: str = "images") -> DataFrame:
    """scan_id, shape and volume of patches' rows: overlaps are averaged and the padding is cut off.

    A scan's patches meet once, by scan_id, and are added to its volume one after another.
    """
    patch, stride = tuple(int(n) for n in patch), tuple(int(n) for n in stride)

    def add(batches):
        import numpy as np
        import pyarrow as pa

        here, whole = None, None

        def done():
            image = whole.image()
            values = pa.ListArray.from_arrays(pa.array([0, image.size], pa.int32()), pa.array(image.ravel()))
            return pa.RecordBatch.from_arrays([here[0], here[1], values], ["scan_id", "shape", name])

        for batch in batches:
            ids, shapes, numbers, pixels = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                if whole is None or ids[k] != here[0][0]:
                    if whole is not None:
                        yield done()
                    here = ids.slice(k, 1), shapes.slice(k, 1)
                    whole = kernels.Assembly(tuple(shapes[k].as_py()[a] for a in AXES), patch, stride)
                whole.add(numbers[k].as_py(), np.asarray(pixels[k].values, float))
        if whole is not None:
            yield done()

    kind = patches.schema["scan_id"].dataType.simpleString()
    held = patches.select("scan_id", "scan_shape", "patch_no", F.col("pixels").cast("array<double>")).repartition("scan_id").sortWithinPartitions("scan_id", "patch_no")
    return held.mapInArrow(add, f"scan_id {kind}, shape struct<z:int,y:int,x:int>, {name} array<double>")


def lung_mask(scans: DataFrame, erosion_radius: int = 2, dst: str = "masks") -> DataFrame:
    return scans.withColumn(dst, kernels.per_row(lambda image: kernels.lung_mask(image, erosion_radius))(F.col("images"), F.col("shape")))


def segment(scans: DataFrame, erosion_radius: int = 2, outside: float = -2000.0) -> DataFrame:
    """Keep what lies in the lungs; all else becomes air."""
    masked = lung_mask(scans, erosion_radius, "_lungs")
    return masked.withColumn("images", F.zip_with("images", "_lungs", lambda v, m: F.when(m == 1, v).otherwise(F.lit(outside)))).drop("_lungs")


def cutout(scans: DataFrame, position, size, fill_with=0, columns=("images",)) -> DataFrame:
    """Fill a box, clipped to the scan, with a value or the scan's own 'mean', 'min' or 'max'."""
    low = dict(zip(AXES, position, strict=True))
    high = {a: p + s for a, p, s in zip(AXES, position, size, strict=True)}

    def column(c):
        own = {"mean": F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(c), F.lit(0)), "min": F.array_min(c), "max": F.array_max(c)}
        value = own[fill_with] if isinstance(fill_with, str) else F.lit(float(fill_with))
        ny, nx = dim("y"), dim("x")

        def one(v, p, value):
            at = {"z": F.floor(p / (ny * nx)), "y": F.pmod(F.floor(p / nx), ny), "x": F.pmod(p, nx)}
            inside = [(at[a] >= low[a]) & (at[a] < high[a]) for a in AXES]
            return F.when(inside[0] & inside[1] & inside[2], value).otherwise(v)

        # the value once per row, not once per voxel
        return F.flatten(F.transform(F.array(value), lambda value: F.transform(F.col(c), lambda v, p: one(v, p, value))))

    return scans.withColumns({c: column(c) for c in columns})


OPERATIONS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}


def apply_noise(scans: DataFrame, noise: Column, op: str = "+", column: str = "images") -> DataFrame:
    """Combine with an array of noise voxel by voxel."""
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op}")
    return scans.withColumn(column, F.zip_with(column, noise, OPERATIONS[op]))


def gaussian_noise(seed: int, sigma: float, column: str = "images") -> Column:
    """Normal noise from hashes of seed, scan and voxel, so that reruns agree."""
    u = lambda p, salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "scan_id", p), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return F.transform(F.col(column), lambda v, p: float(sigma) * F.sqrt(-2 * F.ln(u(p, 1))) * F.cos(6.283185307179586 * u(p, 2)))


def mix_images(scans: DataFrame, partners: DataFrame, p: float = 0.8, mode: str = "sum", mix_masks: bool = True) -> DataFrame:
    """Mix each scan with its partner (scan_id, partner_id): sum p a + (1 - p) b, or the larger of both parts, rescaled."""
    if mode == "none":
        return scans
    if mode not in ("sum", "max"):
        raise ValueError(f"unknown mode {mode}")
    other = scans.select(F.col("scan_id").alias("partner_id"), F.col("images").alias("_b"), *([F.col("masks").alias("_m")] if mix_masks else []))
    joined = scans.join(partners, "scan_id").join(other, "partner_id")
    rule = (lambda a, b: p * a + (1 - p) * b) if mode == "sum" else (lambda a, b: F.greatest(p * a, (1 - p) * b) / max(p, 1 - p))
    mixed = joined.withColumn("images", F.zip_with("images", "_b", rule)).drop("_b", "partner_id")
    return mixed.withColumn("masks", F.zip_with("masks", "_m", lambda a, b: F.greatest(a, b))).drop("_m") if mix_masks else mixed


def permutation(scans: DataFrame, seed: int = 42) -> DataFrame:
    """scan_id and partner_id: a cyclic shift along a hashed order, over rows of ids only."""
    from pyspark.sql import Window

    from .sampling import uniform

    order = Window.orderBy(uniform(seed, "partner", F.col("scan_id")), "scan_id")
    ids = scans.select("scan_id").withColumn("_next", F.lead("scan_id").over(order)).withColumn("_first", F.first("scan_id").over(order))
    return ids.select("scan_id", F.coalesce("_next", "_first").alias("partner_id"))
