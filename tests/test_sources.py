"""File formats on synthetic files, stored scans, annotation texts."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from tomospark.functions.geometry import zyx
from tomospark.operators import annotations as ann
from tomospark.sources import annotations as made
from tomospark.sources import scans as files


def element(group, tag, kind, value):
    value += b" " * (len(value) % 2) if kind not in (b"OW", b"US") else b""
    head = struct.pack("<HH", group, tag) + kind
    return head + (b"\0\0" + struct.pack("<I", len(value)) if kind in files.LONG_VR else struct.pack("<H", len(value))) + value


def write_slice(path, z, pixels, slope=1, intercept=-1024, position=None):
    body = element(0x0020, 0x000D, b"UI", b"1.2") + element(0x0020, 0x000E, b"UI", b"1.2.3") + element(0x0010, 0x0020, b"LO", b"p1")
    body += element(0x0020, 0x0032, b"DS", (position or f"-10\\-20\\{z}").encode()) + element(0x0018, 0x0050, b"DS", b"2.5") + element(0x0028, 0x0030, b"DS", b"0.5\\0.75")
    for tag, value in ((0x10, pixels.shape[0]), (0x11, pixels.shape[1]), (0x100, 16), (0x103, 1)):
        body += element(0x0028, tag, b"US", struct.pack("<H", value))
    body += element(0x0028, 0x1052, b"DS", str(intercept).encode()) + element(0x0028, 0x1053, b"DS", str(slope).encode())
    body += element(0x7FE0, 0x0010, b"OW", pixels.astype("<i2").tobytes())
    syntax = element(2, 0x10, b"UI", b"1.2.840.10008.1.2.1")
    path.write_bytes(b"\0" * 128 + b"DICM" + syntax + body)


def test_dicom(spark, tmp_path):
    folder = tmp_path / "scan1"
    folder.mkdir()
    planes = {z: np.arange(6).reshape(2, 3) + 100 * z for z in (1, 2, 3)}
    planes[2][0, 0] = -2000
    for z, plane in planes.items():
        write_slice(folder / f"s{z}.dcm", z, plane, slope=2)
    row = files.load(spark, str(tmp_path / "*"), "dicom").first()
    assert (row.scan_id, tuple(row.shape), tuple(row.spacing), tuple(row.origin)) == ("scan1", (3, 2, 3), (2.5, 0.5, 0.75), (3.0, -20.0, -10.0))
    want = np.stack([planes[z] for z in (3, 2, 1)])
    want = np.where(want == -2000, 0, want) * 2 - 1024
    assert np.array(row.images).reshape(3, 2, 3).tolist() == want.tolist()
    assert tuple(files.load(spark, str(tmp_path / "*"), "dicom", legacy_origin=True).first().origin) == (3.0, -10.0, -20.0)
    info = files.read_info(spark, str(tmp_path / "*")).first()
    assert (info.NumSlices, info.Rows, info.Columns, info.SpacingZ, info.OriginZ, info.seriesuid) == (3, 2, 3, 2.5, 3.0, "1.2.3")
    assert files.read_info(spark, str(tmp_path / "*"), load_origin=False).first().OriginZ == 0.0


def test_formats_by_uri(spark, tmp_path):
    """Paths with a scheme go through pyarrow's file systems."""
    for name in ("s1", "s2"):
        (tmp_path / name).mkdir()
        write_slice(tmp_path / name / "a.dcm", 1, np.zeros((2, 2)))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "v.raw").write_bytes(np.arange(8, dtype="<i2").tobytes())
    (tmp_path / "m" / "v.mhd").write_text("DimSize = 2 2 2\nElementType = MET_SHORT\nElementDataFile = v.raw\n")
    assert {r.scan_id for r in files.load(spark, f"file://{tmp_path}/s*", "dicom").collect()} == {"s1", "s2"}
    assert files.read_info(spark, f"file://{tmp_path}/s?").count() == 2
    for path in (f"file://{tmp_path}/m", f"file://{tmp_path}/m/*.mhd", f"file://{tmp_path}/m/v.mhd"):
        assert files.load(spark, path, "raw").first().images == list(map(float, range(8)))


def test_dicom_sequences_of_undefined_length(spark, tmp_path):
    """They are walked through, nested ones too; their elements don't count."""
    folder = tmp_path / "scan1"
    folder.mkdir()
    plane = np.arange(6).reshape(2, 3)
    write_slice(folder / "s.dcm", 1, plane)
    raw = (folder / "s.dcm").read_bytes()
    at = raw.index(struct.pack("<HH", 0x0020, 0x0032))
    element = lambda tag, vr, value: struct.pack("<HH", *tag) + vr + struct.pack("<H", len(value)) + value
    item, end_item, end = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF), struct.pack("<HHI", 0xFFFE, 0xE00D, 0), struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    start = lambda tag: struct.pack("<HH", *tag) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF)
    inner = start((0x0008, 0x1199)) + item + element((0x0020, 0x0032), b"DS", b"7\\7\\7 ") + end_item + end
    sized = struct.pack("<HHI", 0xFFFE, 0xE000, 12) + element((0x0010, 0x0020), b"LO", b"else")
    sequence = start((0x0008, 0x1140)) + item + inner + element((0x0010, 0x0020), b"LO", b"else") + end_item + sized + end
    (folder / "s.dcm").write_bytes(raw[:at] + sequence + raw[at:])
    row = files.load(spark, str(tmp_path / "*"), "dicom").first()
    assert (tuple(row.origin), row.images) == ((1.0, -20.0, -10.0), (plane - 1024).ravel().astype(float).tolist())
    assert files.read_info(spark, str(tmp_path / "*")).first().PatientID != "else"


def test_dicom_info_reads_no_pixels(tmp_path):
    write_slice(tmp_path / "s.dcm", 1, np.zeros((50, 60)))
    raw = (tmp_path / "s.dcm").read_bytes()
    (tmp_path / "s.dcm").write_bytes(raw[: raw.index(struct.pack("<HH", 0x7FE0, 0x0010)) + 8])  # the pixels are cut off
    assert files.parse_dicom(str(tmp_path / "s.dcm"), pixels=False)["rows"] == 50


def test_files_index(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_text("x")
    assert [r.scan_id for r in files.files_index(spark, str(tmp_path / "*"), dirs=True, sort=True).collect()] == ["a", "b"]
    assert {r.scan_id for r in files.files_index(spark, str(tmp_path / "*" / "*.txt")).collect()} == {"a", "b"}
    assert [tuple(r) for r in files.files_index(spark, paths={"k": "/x"}).collect()] == [("k", "/x")]


def test_metaimage(spark, tmp_path):
    voxels = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    (tmp_path / "a.raw").write_bytes(voxels.tobytes())
    (tmp_path / "a.mhd").write_text("ObjectType = Image\nDimSize = 4 3 2\nElementSpacing = 0.5 0.6 2\nOffset = 1 2 3\nElementType = MET_SHORT\nElementDataFile = a.raw\n")
    row = files.load(spark, str(tmp_path), "raw").first()
    assert (tuple(row.shape), tuple(row.spacing), tuple(row.origin)) == ((2, 3, 4), (2.0, 0.6, 0.5), (3.0, 2.0, 1.0))
    assert row.images == voxels.ravel().tolist()


def test_nifti(spark, tmp_path):
    voxels = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, 2, 0, 0, -5, 0, 3, 0, -6, 0, 0, 4, -7)
    (tmp_path / "b.nii").write_bytes(bytes(head) + voxels.ravel(order="F").tobytes())
    row = files.load(spark, str(tmp_path), "nii").first()
    assert (row.scan_id, tuple(row.spacing), tuple(row.origin)) == ("b", (2.0, 3.0, 4.0), (-5.0, -6.0, -7.0))
    assert row.images == voxels.ravel().tolist()


def test_dump_and_load(spark, tmp_path):
    scans = files.load(spark, fmt=None, src={"a": np.ones((1, 2, 2)), "b": np.zeros((2, 2, 2))})
    files.dump(scans, str(tmp_path / "x"), rename=F.concat(F.lit("n_"), "scan_id"))
    back = files.load(spark, str(tmp_path / "x"), components=["images"], dst=["voxels"])
    assert {r.scan_id: r.voxels for r in back.collect()} == {"n_a": [1.0] * 4, "n_b": [0.0] * 8}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "spacing" not in plan.split("ReadSchema")[1]
    with pytest.raises(PySparkException, match="null"):
        files.dump(scans.withColumn("masks", F.lit(None).cast("array<double>")), str(tmp_path / "y"))
    with pytest.raises(AnalysisException):
        files.load(spark, str(tmp_path / "x"), components=["masks"])
    info = files.read_info(spark, str(tmp_path / "x"), fmt="parquet")
    assert info.count() == 2 and "images" not in info._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_load_arguments(spark):
    with pytest.raises(TypeError):
        files.load(spark, "x", "png")
    with pytest.raises(ValueError, match="length"):
        files.load(spark, "x", components=["images"], dst=["a", "b"])
    with pytest.raises(ValueError, match="src"):
        files.load(spark, fmt=None)
    with pytest.raises(ValueError, match="one of"):
        files.read_info(spark)
    with pytest.raises(ValueError, match="format"):
        files.read_info(spark, "x", fmt="csv")


def test_annotation_text(spark, tmp_path):
    def line(scan, doctor, *places):
        return "\t".join([scan, "st", doctor, "", str(len(places)), *[f for p in places for f in p]])

    first = line("s1", "'001'", ("1", "2", "3", "4.5", "G"), ("5", "-", "7", "8", "м"))
    second = line("s1", "002")
    third = line("s2", "002", ("1", "1", "1", "", "с 3"), ("9", "8", "7", "6", "с 3"))
    path = tmp_path / "a.txt"
    path.write_text(f"{ann.HEADER}\n\n\n{first}\n{second}\n\n\n{third}", encoding="utf-16")
    parsed = ann.read_annotation(spark, str(path))
    assert parsed.count() == 3
    found = ann.to_nodules(parsed).select("seriesuid", "DoctorID", "coordX", "coordY", "coordZ", "diameter_mm", "NoduleType").collect()
    assert sorted(map(tuple, found)) == [("s1", "001", 1.0, 2.0, 3.0, 4.5, "semi_solid"), ("s2", "002", 9.0, 8.0, 7.0, 6.0, "solid")]
    pairs = ann.annotators(parsed)
    assert sorted(map(tuple, pairs.collect())) == [("s1", "001"), ("s1", "002"), ("s2", "002")]
    wide = {r.seriesuid: tuple(r)[1:] for r in ann.annotators_pivot(pairs, ["001", "002"]).collect()}
    assert wide == {"s1": (1, 1), "s2": (0, 1)}
    info = spark.createDataFrame([("s1", 2.0, 1.0, 1.0, 10.0, 0.0, 0.0), ("s1", 1.0, 1.0, 1.0, 10.0, 0.0, 0.0)], "seriesuid string, SpacingZ double, SpacingY double, SpacingX double, OriginZ double, OriginY double, OriginX double")
    whole = ann.transform_annotation(spark, str(path), info)
    assert sorted((r.DoctorID, r.coordZ) for r in whole.collect() if r.coordZ is not None) == [("001", 13.0)] and whole.count() == 2


def test_nodules_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text("seriesuid,coordX,coordY,coordZ,diameter_mm\na,1,2,3,4\n")
    assert tuple(made.read_nodules_csv(spark, str(tmp_path / "n.csv")).first()) == ("a", 1.0, 2.0, 3.0, 4.0)


def test_generated_annotation(spark):
    rows = made.generate_annotation(spark, 30, 6, [0], [1]).toPandas()
    per_scan = rows.groupby("seriesuid").DoctorID.nunique()
    assert per_scan.between(3, 4).all() and len(per_scan) == 30
    assert rows.diameter_mm.dropna().between(1, 14).all()


def test_files_index(spark, tmp_path):
    for name in ("a.raw", "b.raw", "c.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r.scan_id for r in files.files_index(spark, f"{tmp_path}/*.raw").collect()) == ["a", "b"]
    ids = files.from_ids(spark, ["a"])
    assert [r.scan_id for r in files.subset(files.files_index(spark, f"{tmp_path}/*.raw"), ids).collect()] == ["a"]


def test_struct_helper(spark):
    assert tuple(spark.range(1).select(zyx(1, 2, 3).alias("s")).first().s) == (1, 2, 3)
