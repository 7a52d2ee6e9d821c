"""Scans at rest and from medical file formats.

Stored scans are Parquet with zstd, a row per scan; only the columns asked for are read. The file formats are
Python data sources (pyspark.sql.datasource): one partition per item, and no pixels are read when metadata is asked for.
Paths may be URIs of other file systems (files.py).
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import AXES, zyx
from . import files

TRIPLE = "struct<z:double,y:double,x:double>"
SCAN = f"scan_id string, shape struct<z:int,y:int,x:int>, spacing {TRIPLE}, origin {TRIPLE}, images array<double>"
FORMATS = ("parquet", "raw", "nii", "dicom")
COMPONENTS = ("images", "spacing", "origin", "masks")


def dump(scans: DataFrame, path: str, components=None, rename: Column | None = None, mode: str = "overwrite") -> None:
    """Write scans; a null component raises. rename gives other ids."""
    components = list(components or [c for c in COMPONENTS if c in scans.columns])
    keep = [c for c in ("scan_id", "shape") if c in scans.columns]
    rows = scans.select((rename.alias("scan_id") if rename is not None else F.col("scan_id")), *[c for c in keep if c != "scan_id"], *components)
    for c in components:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"component {c} is null"))).otherwise(F.col(c)))
    rows.write.mode(mode).option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path=None, fmt: str | None = "parquet", components=None, dst=None, src=None, legacy_origin: bool = False) -> DataFrame:
    """Scans with the components asked for, under the names in dst.

    fmt None takes src: a DataFrame, or a dict of arrays (scan_id to array, or component to list).
    """
    components = list(components or ("images", "spacing", "origin"))
    dst = list(dst or components)
    if len(dst) != len(components):
        raise ValueError("dst and components differ in length")
    if fmt is None:
        if src is None:
            raise ValueError("without a format, src is needed")
        scans = src if isinstance(src, DataFrame) else from_arrays(spark, src)
    elif fmt == "parquet":
        scans = spark.read.parquet(*([path] if isinstance(path, str) else path))
    elif fmt in ("raw", "nii"):
        register(spark)
        scans = spark.read.format("metaimage" if fmt == "raw" else "nifti").load(path)
    elif fmt == "dicom":
        scans = read_dicom(spark, path, legacy_origin)
    else:
        raise TypeError(f"unknown format {fmt}; one of {FORMATS}")
    return scans.select("scan_id", "shape", *[F.col(c).alias(d) for c, d in zip(components, dst, strict=True)])


def from_arrays(spark: SparkSession, arrays: dict) -> DataFrame:
    """Scans of unit spacing from arrays (z, y, x) by id."""
    import numpy as np

    rows = [(str(k), tuple(int(n) for n in np.shape(v)), (1.0,) * 3, (0.0,) * 3, np.asarray(v, float).ravel().tolist()) for k, v in arrays.items()]
    return spark.createDataFrame(rows, SCAN)


def from_ids(spark: SparkSession, ids) -> DataFrame:
    return spark.createDataFrame([(str(i),) for i in ids], "scan_id string")


def subset(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose scan_id is among ids."""
    return df.join(ids.select("scan_id"), "scan_id", "left_semi")


def files_index(spark: SparkSession, path: str | None = None, no_ext: bool = True, dirs: bool = False, sort: bool = False, paths: dict | None = None) -> DataFrame:
    """scan_id (base name) and path of the files, or directories, that a glob names; contents aren't read.

    paths, an own mapping of ids to paths, takes the place of a glob. Names are listed by the driver's file system client
    alone where directories are asked for.
    """
    if (path is None) == (paths is None):
        raise ValueError("give exactly one of path and paths")
    name = F.element_at(F.split("path", "/"), -1)
    if paths is not None:
        rows = spark.createDataFrame([(str(k), str(v)) for k, v in paths.items()], "scan_id string, path string")
    elif dirs:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        listed = [(str(x.getPath()),) for x in found if x.isDirectory()]
        rows = spark.createDataFrame(listed, "path string").select(name.alias("scan_id"), "path")
    else:
        listed = spark.read.format("binaryFile").load(path).select("path")
        rows = listed.select((F.regexp_replace(name, r"\.[^.]*$", "") if no_ext else name).alias("scan_id"), "path")
    return rows.orderBy("scan_id") if sort else rows


# --- file formats ---------------------------------------------------------------------------------------------------


@dataclass
class Item(InputPartition):
    path: str


def _items(options: dict, suffix: str) -> list[Item]:
    path = options["path"]
    found = files.matched(f"{path.rstrip('/')}/*{suffix}") if files.is_dir(path) else files.matched(path)
    return [Item(p) for p in found]


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, schema, options):
        self.options, self.names = dict(options), schema.fieldNames()

    def partitions(self):
        return _items(self.options, self.suffix)

    def read(self, partition):
        row = self.parse(partition.path, "images" in self.names)
        yield tuple(row.get(n) for n in self.names)

    def parse(self, path: str, pixels: bool) -> dict:
        raise NotImplementedError


META_TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "<i2", "MET_USHORT": "<u2", "MET_INT": "<i4", "MET_UINT": "<u4", "MET_FLOAT": "<f4", "MET_DOUBLE": "<f8"}


def parse_metaimage(path: str, pixels: bool = True) -> dict:
    """A MetaImage header and, if asked for, its raw voxels; header order x, y, z is turned."""
    import numpy as np

    with files.opened(path) as f:
        head = dict(line.split(" = ", 1) for line in f.read().decode("latin-1").splitlines() if " = " in line)
    triple = lambda k, default, kind=float: tuple(kind(v) for v in head.get(k, default).split())[::-1]
    shape = triple("DimSize", "0 0 0", int)
    images = None
    if pixels:
        kind = np.dtype(META_TYPES[head["ElementType"]])
        if head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")).strip() == "True":
            kind = kind.newbyteorder(">")
        with files.opened(os.path.join(os.path.dirname(path), head["ElementDataFile"].strip())) as f:
            raw = f.read()
        if head.get("CompressedData", "False").strip() == "True":
            import zlib

            raw = zlib.decompress(raw)
        images = np.frombuffer(raw, kind).astype(float).tolist()
    name = os.path.splitext(os.path.basename(path))[0]
    origin = triple("Offset", head.get("Position", head.get("Origin", "0 0 0")))
    return {"scan_id": name, "shape": shape, "spacing": triple("ElementSpacing", "1 1 1"), "origin": origin, "images": images}


NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def parse_nifti(path: str, pixels: bool = True) -> dict:
    """A NIfTI-1 file: the affine's diagonal is the spacing and its last column the origin, in the array's axis order."""
    import gzip

    import numpy as np

    with files.opened(path) as held, gzip.GzipFile(fileobj=held) if path.endswith(".gz") else held as f:
        head = f.read(348)
        end = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
        dims = struct.unpack(f"{end}8h", head[40:56])
        kind = struct.unpack(f"{end}h", head[70:72])[0]
        steps = struct.unpack(f"{end}8f", head[76:108])
        offset, slope, inter = struct.unpack(f"{end}3f", head[108:120])
        qform, sform = struct.unpack(f"{end}2h", head[252:256])
        rows = np.array(struct.unpack(f"{end}12f", head[280:328])).reshape(3, 4)
        shape = tuple(int(n) for n in dims[1:4])
        if sform > 0:
            spacing, origin = [float(rows[k, k]) for k in range(3)], [float(v) for v in rows[:, 3]]
        else:
            spacing, origin = [float(v) for v in steps[1:4]], [float(v) for v in struct.unpack(f"{end}3f", head[268:280])] if qform > 0 else [0.0] * 3
        images = None
        if pixels:
            f.read(int(offset) - 348)
            flat = np.frombuffer(f.read(), np.dtype(NIFTI_TYPES[kind]).newbyteorder(end), count=int(np.prod(shape))).astype(float)
            if slope not in (0.0, 1.0) or inter:
                flat = flat * (slope or 1.0) + inter
            images = flat.reshape(shape, order="F").ravel().tolist()  # the first axis varies fastest in the file
    name = re.sub(r"\.nii(\.gz)?$", "", os.path.basename(path))
    return {"scan_id": name, "shape": shape, "spacing": tuple(spacing), "origin": tuple(origin), "images": images}


LONG_VR = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"OL", b"UC", b"UR"}
#: The tags that a slice needs.
TAGS = {
    (0x0020, 0x000D): "study", (0x0020, 0x000E): "series", (0x0010, 0x0020): "patient", (0x0020, 0x0032): "position", (0x0018, 0x0050): "thickness",
    (0x0028, 0x0030): "pixel_spacing", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0028, 0x0100): "bits", (0x0028, 0x0103): "signed",
    (0x0028, 0x1052): "intercept", (0x0028, 0x1053): "slope", (0x7FE0, 0x0010): "pixels",
}


PIXELS = (0x7FE0, 0x0010)
UNDEFINED = 0xFFFFFFFF


def _elements(f, explicit: bool, meta: bool, until: tuple[int, int] | None, found: dict) -> None:
    """Read data elements of f into found up to tag until, an end of the file, or the end of an item.

    Values of other tags are skipped; sequences and items of undefined length are walked through to their end marks.
    """
    while True:
        head = f.read(8)
        if len(head) < 8:
            return
        group, element = struct.unpack_from("<HH", head)
        if (group, element) in ((0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), until):  # end of an item, of a sequence
            return
        if meta and group != 2:
            meta = False
            explicit = found.get("syntax", "1.2.840.10008.1.2.1") != "1.2.840.10008.1.2"
        kind = head[4:6]
        if group == 0xFFFE or not explicit and not meta:
            kind, size = b"", struct.unpack_from("<I", head, 4)[0]
        elif kind in LONG_VR:
            size = struct.unpack("<I", f.read(4))[0]
        else:
            size = struct.unpack_from("<H", head, 6)[0]
        if size == UNDEFINED:
            if (group, element) == PIXELS:
                raise ValueError("compressed pixels aren't read")
            if (group, element) == (0xFFFE, 0xE000):  # an item: elements up to its end mark
                _elements(f, explicit, False, None, {})
            else:  # a sequence: items up to its end mark
                _elements(f, explicit if kind != b"UN" else False, False, None, {})
            continue
        name = "syntax" if (group, element) == (2, 0x10) else TAGS.get((group, element))
        if name is None:
            f.seek(size, 1)
            continue
        value = f.read(size)
        if name in ("rows", "columns", "bits", "signed"):
            found[name] = struct.unpack("<H", value)[0]
        elif name == "pixels":
            found[name] = value
        else:
            found[name] = value.rstrip(b"\0 ").decode("latin-1")


def parse_dicom(path: str, pixels: bool = True) -> dict:
    """The tags above of an uncompressed little-endian DICOM slice, explicit or implicit. Without pixels, reading stops before them."""
    found: dict = {}
    with files.opened(path) as f:
        if f.read(132)[128:] != b"DICM":
            f.seek(0)
        _elements(f, True, True, None if pixels else PIXELS, found)
    numbers = lambda k, default: [float(v) for v in found.get(k, default).split("\\")]
    out = {"scan_id": os.path.basename(os.path.dirname(path)), "file": os.path.basename(path), "study": found.get("study"), "series": found.get("series"), "patient": found.get("patient")}
    out |= {"position": numbers("position", "0\\0\\0"), "thickness": numbers("thickness", "1")[0], "pixel_spacing": numbers("pixel_spacing", "1\\1")}
    out |= {"rows": found["rows"], "columns": found["columns"], "slope": numbers("slope", "1")[0], "intercept": numbers("intercept", "0")[0], "pixels": None}
    if pixels:
        import numpy as np

        kind = {8: "u1", 16: "<i2" if found.get("signed", 0) else "<u2"}[found.get("bits", 16)]
        out["pixels"] = np.frombuffer(found["pixels"], kind)
    return out


class MetaImageReader(_Reader):
    suffix = ".mhd"

    def parse(self, path, pixels):
        return parse_metaimage(path, pixels)


class MetaImageSource(DataSource):
    @classmethod
    def name(cls):
        return "metaimage"

    def schema(self):
        return SCAN

    def reader(self, schema):
        return MetaImageReader(schema, self.options)


class NiftiReader(_Reader):
    suffix = ".nii*"

    def parse(self, path, pixels):
        return parse_nifti(path, pixels)


class NiftiSource(DataSource):
    @classmethod
    def name(cls):
        return "nifti"

    def schema(self):
        return SCAN

    def reader(self, schema):
        return NiftiReader(schema, self.options)


SLICE = "scan_id string, file string, study string, series string, patient string, position array<double>, thickness double, pixel_spacing array<double>, rows int, columns int, slope double, intercept double, pixels array<int>"


def _folders(path: str) -> list[str]:
    """The directories that a glob names, or those within the one directory that it names."""
    folders = [p for p in files.matched(path) if files.is_dir(p)]
    within = [p for p, is_folder in files.entries(folders[0]) if is_folder] if len(folders) == 1 else []
    return within or folders


class DicomReader(_Reader):
    """One partition per slice; path is a glob of directories (one scan each) or a directory of such."""

    def partitions(self):
        return [Item(p) for folder in _folders(self.options["path"]) for p, is_folder in files.entries(folder) if not is_folder]

    def read(self, partition):
        row = parse_dicom(partition.path, "pixels" in self.names)
        if row["pixels"] is not None:
            row["pixels"] = row["pixels"].astype("int64").tolist()
        yield tuple(row.get(n) for n in self.names)


class DicomScanReader(_Reader):
    """One partition per directory, so that a scan is put together where its slices are read."""

    def partitions(self):
        return [Item(folder) for folder in _folders(self.options["path"])]

    def read(self, partition):
        legacy = str(self.options.get("legacyorigin", self.options.get("legacyOrigin", "false"))).lower() == "true"
        row = parse_dicom_folder(partition.path, "images" in self.names, legacy)
        yield tuple(row.get(n) for n in self.names)


class DicomScanSource(DataSource):
    @classmethod
    def name(cls):
        return "dicom_scans"

    def schema(self):
        return SCAN

    def reader(self, schema):
        return DicomScanReader(schema, self.options)


class DicomSource(DataSource):
    @classmethod
    def name(cls):
        return "dicom_slices"

    def schema(self):
        return SLICE

    def reader(self, schema):
        return DicomReader(schema, self.options)


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    for source in (MetaImageSource, NiftiSource, DicomSource, DicomScanSource):
        spark.dataSource.register(source)


def dicom_slices(spark: SparkSession, path: str, pixels: bool = True) -> DataFrame:
    register(spark)
    reader = spark.read.format("dicom_slices")
    if not pixels:
        reader = reader.schema(SLICE.replace(", pixels array<int>", ""))
    return reader.load(path)


def _origin(position: Column, legacy: bool) -> Column:
    """z, y, x of a slice's position; legacy gives (third, first, second)."""
    return zyx(position[2], position[0], position[1]) if legacy else zyx(position[2], position[1], position[0])


def parse_dicom_folder(folder: str, pixels: bool = True, legacy_origin: bool = False) -> dict:
    """A scan from the slices of a directory: slices by falling whole z (then name), in Hounsfield units.

    -2000 is air; the product with slope and the intercept truncate to whole numbers.
    """
    import numpy as np

    slices = [parse_dicom(p, pixels) for p, is_folder in files.entries(folder) if not is_folder]
    slices.sort(key=lambda s: (-int(s["position"][2]), s["file"]))
    first, images = slices[0], None
    if pixels:
        planes = []
        for s in slices:
            plane = s["pixels"].astype(np.int64)
            plane[plane == -2000] = 0
            if s["slope"] != 1:
                plane = np.trunc(plane * s["slope"]).astype(np.int64)
            planes.append((plane + int(s["intercept"])).astype(np.int16))
        images = np.concatenate(planes).astype(float).tolist()
    x, y, z = first["position"]
    return {
        "scan_id": os.path.basename(folder), "shape": (len(slices), first["rows"], first["columns"]), "spacing": (first["thickness"], *first["pixel_spacing"]),
        "origin": (z, x, y) if legacy_origin else (z, y, x), "images": images,
    }


def read_dicom(spark: SparkSession, path: str, legacy_origin: bool = False) -> DataFrame:
    """A row per directory; nothing is shuffled."""
    register(spark)
    return spark.read.format("dicom_scans").option("legacyOrigin", str(legacy_origin).lower()).load(path)


def dicom_info(spark: SparkSession, path: str, load_origin: bool = True, legacy_origin: bool = False) -> DataFrame:
    """Scan information from the first file of each directory; no pixels are kept."""
    slices = dicom_slices(spark, path, pixels=False)
    first = F.min_by(F.struct("thickness", "pixel_spacing", "study", "series", "patient", "rows", "columns"), "file")
    top = F.min_by("position", F.struct((-F.col("position")[2].cast("int")).alias("o"), "file"))
    info = slices.groupBy("scan_id").agg(first.alias("f"), top.alias("top"), F.count("*").alias("n"))
    origin = _origin(F.col("top"), legacy_origin) if load_origin else zyx(0.0, 0.0, 0.0)
    return info.select(
        F.col("f.thickness").alias("SpacingZ"), F.col("f.pixel_spacing")[0].alias("SpacingY"), F.col("f.pixel_spacing")[1].alias("SpacingX"), F.col("f.study").alias("StudyID"),
        F.col("f.series").alias("seriesuid"), F.col("f.patient").alias("PatientID"), F.col("f.rows").alias("Rows"), F.col("f.columns").alias("Columns"), F.col("n").cast("int").alias("NumSlices"),
        F.col("scan_id").alias("ScanID"), *[origin[a].alias(f"Origin{a.upper()}") for a in AXES],
    )


def stored_info(spark: SparkSession, path: str, load_origin: bool = True) -> DataFrame:
    """Scan information of stored scans, from their small columns alone."""
    scans = spark.read.parquet(path)
    origin = (lambda a: F.col(f"origin.{a}")) if load_origin else (lambda a: F.lit(0.0))
    return scans.select(
        *[F.col(f"spacing.{a}").alias(f"Spacing{a.upper()}") for a in AXES], *[origin(a).alias(f"Origin{a.upper()}") for a in AXES],
        F.col("scan_id").alias("seriesuid"), F.lit(path).alias("ScanPath"), F.col("scan_id").alias("ScanID"),
    )


def read_info(spark: SparkSession, path=None, paths=None, fmt: str = "dicom", filter_by_min_spacing: bool = False, load_origin: bool = True) -> DataFrame:
    """Scan information from exactly one of path (a glob) and paths (a list)."""
    from ..operators.annotations import best_spacing

    if (path is None) == (paths is None):
        raise ValueError("give exactly one of path and paths")
    if fmt not in ("dicom", "parquet"):
        raise ValueError(f"unknown format {fmt}")
    one = dicom_info if fmt == "dicom" else stored_info
    info = None
    for p in [path] if paths is None else paths:
        part = one(spark, p, load_origin)
        info = part if info is None else info.unionByName(part)
    return best_spacing(info, tie="ScanID") if fmt == "dicom" and filter_by_min_spacing else info
