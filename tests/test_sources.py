"""Files that the tests write themselves."""

import gzip
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.sources import dicom, formats, volumes


def test_dicom_round_trip(spark, tmp_path):
    pixels = np.arange(12, dtype=np.uint16)
    tags = {"Modality": "MR", "Rows": "3", "Columns": "4", "BitsAllocated": "16", "PixelRepresentation": "0", "ImageType": "ORIGINAL\\PRIMARY", "SOPInstanceUID": "1.2.3"}
    (tmp_path / "a.dcm").write_bytes(dicom.build(tags, pixels))
    (tmp_path / "b.dcm").write_bytes(b"nothing")
    found = {r.path[-5:]: r for r in dicom.read(spark, str(tmp_path), ["Modality", "ImageType"], pixels=True).collect()}
    assert found["a.dcm"].tags["ImageType"] == "ORIGINAL\\PRIMARY" and found["a.dcm"].data == pixels.tolist() and found["a.dcm"].n_cols == 4
    assert found["b.dcm"].status == "not_dicom"


def test_dicom_files(spark, tmp_path):
    formats.register(spark)
    rows = spark.createDataFrame([(f"x{k}.dcm", {"Modality": "CT", "Rows": "1", "Columns": "2", "BitsAllocated": "16", "PixelRepresentation": "0"}, [7.0 + k, 9.0]) for k in range(40)], "name string, tags map<string,string>, data array<double>")
    out = f"file://{tmp_path}/out"
    rows.repartition(4).write.format("dicom").mode("append").save(out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"x{k}.dcm" for k in range(40))
    (tmp_path / "out" / "broken.dcm").write_bytes(b"DICM")
    (tmp_path / "out" / "cut.dcm").write_bytes(dicom.build({"Modality": "CT", "PatientID": "p"})[:-4])
    (tmp_path / "out" / "_hidden.dcm").write_bytes(b"x")
    found = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("dicom").option("pixels", "true").option("taskBytes", "2000").load(out).collect()}
    assert len(found) == 42 and found["x5.dcm"].data == [12.0, 9.0] and found["x5.dcm"].n_cols == 2
    assert found["broken.dcm"].status == "not_dicom" and found["cut.dcm"].status == "truncated"
    heads = spark.read.format("dicom").option("tags", "Modality").load(out)
    assert "data" not in heads.columns and {r.path.rsplit("/", 1)[1]: r.tags.get("Modality") for r in heads.collect()}["x7.dcm"] == "CT"
    rows.limit(1).write.format("dicom").mode("overwrite").save(out)
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_")] == ["x0.dcm"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("dicom").load(str(tmp_path / "none")).count() == 0


def test_head_is_enough(tmp_path, monkeypatch):
    """Without pixels only the head of a file is read, doubled until the pixels are in sight."""
    monkeypatch.setattr(formats, "HEAD_BYTES", 64)
    (tmp_path / "a.dcm").write_bytes(dicom.build({"Modality": "MR", "Rows": "300", "Columns": "300", "PatientID": "p" * 60}, np.zeros(90000, dtype="u2")))
    read = []

    class File:
        def __init__(self, path):
            self.data = open(path, "rb").read()

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read_at(self, n, at):
            read.append(n)
            return self.data[at : at + n]

    class Store:
        open_input_file = staticmethod(File)

    source = formats.DicomSource({"path": str(tmp_path)})
    size = (tmp_path / "a.dcm").stat().st_size
    row = source.row(Store, str(tmp_path / "a.dcm"), size)
    assert row["n_rows"] == 300 and row["status"] == "ok" and max(read) <= 1024 < size
    assert formats.plan([("a", 5), ("b", 6), ("c", 50), ("d", 1)], 12, lambda n: n) == [[("a", 5), ("b", 6)], [("c", 50)], [("d", 1)]]


def test_failed_job_leaves_no_file(spark, tmp_path):
    formats.register(spark)
    rows = spark.range(8).selectExpr("concat('v', id, '.npz') as name", "array(2, 2) as shape", "cast(null as array<double>) as affine", "if(id = 6, array(1d), array(1d, 2d, 3d, 4d)) as data").repartition(4)
    with pytest.raises(Exception, match="reshape"):
        rows.write.format("npz").mode("append").save(str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []
    with pytest.raises(Exception, match="same file name"):
        rows.where("name <> 'v6.npz'").withColumn("name", F.lit("a.npz")).write.format("npz").mode("append").save(str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []
    rows.where("name <> 'v6.npz'").write.format("npz").mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 7


def test_volumes(spark, tmp_path):
    values = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    affine = np.diag([1.0, 2.0, 3.0, 1.0])
    (tmp_path / "v.nii.gz").write_bytes(volumes.build_nifti(values, affine))
    (tmp_path / "bad.nii.gz").write_bytes(gzip.compress(b"x"))
    np.savez_compressed(tmp_path / "w.npz", data=values)
    found = {r.path.rsplit("/", 1)[1]: r for r in volumes.read_volumes(spark, str(tmp_path)).collect()}
    assert found["v.nii.gz"].shape == [2, 3, 4] and found["v.nii.gz"].data == values.ravel(order="F").tolist() and found["v.nii.gz"].affine == affine.ravel().tolist()
    assert found["w.npz"].data == values.ravel().tolist() and found["bad.nii.gz"].status == "unsupported_format"


def test_canonical_axes():
    values = np.arange(24).reshape(2, 3, 4)
    affine = np.array([[0, -2.0, 0, 10], [1.0, 0, 0, 5], [0, 0, 3.0, 0], [0, 0, 0, 1]])
    out, matrix = volumes.canonical(values, affine)
    assert out.shape == (3, 2, 4) and (np.diag(matrix)[:3] > 0).all()
    spot = affine @ np.array([1, 2, 3, 1])
    i, j, k = np.round(np.linalg.solve(matrix, spot))[:3].astype(int)
    assert out[i, j, k] == values[1, 2, 3]


def test_unzip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("s/1.dcm", b"abc")
    (tmp_path / "b.zip").write_bytes(b"broken")
    found = sorted((r.archive[-5:], r.name) for r in volumes.unzip(spark, str(tmp_path)).collect())
    assert found == [("a.zip", "s/1.dcm"), ("b.zip", None)]


def test_templates(spark, tmp_path):
    from voxelmill.functions.templates import TEMPLATES, read_templates

    assert {k: len(set(v)) for k, v in TEMPLATES.items()} == {"CT": 48, "MR": 56, "DX": 50, "MG": 47}
    (tmp_path / "ct.json").write_text('["Modality", "KVP"]')
    (tmp_path / "xx.json").write_text("no list")
    assert {r.modality: r.tags for r in read_templates(spark, str(tmp_path)).collect()} == {"CT": ["Modality", "KVP"], "XX": None}


def test_dicom_behind_open_sequences(spark, tmp_path):
    body = len(dicom.build({}))
    item = lambda number, raw=b"": struct.pack("<HHI", 0xFFFE, number, len(raw) if raw else 0xFFFFFFFF if number == 0xE000 else 0) + raw
    open_sequence = lambda group, number, vr, inner: struct.pack("<HH2s2xI", group, number, vr, 0xFFFFFFFF) + inner + item(0xE0DD)
    nested = open_sequence(0x0008, 0x1199, b"SQ", item(0xE000, dicom.build({"PatientID": "in"})[body:]) + item(0xE000) + struct.pack("<HH2sH", 0x0008, 0x1150, b"UI", 2) + b"1\0" + item(0xE00D))
    implicit = struct.pack("<HHI", 0x0009, 0x1010, 4) + b"abcd"
    sequences = open_sequence(0x0008, 0x1140, b"SQ", item(0xE000) + nested + item(0xE00D)) + open_sequence(0x0009, 0x1001, b"UN", item(0xE000) + implicit + item(0xE00D))
    pixels = np.array([1, 70000, 2**31 + 1, 16777217], dtype="<u4")
    tags = {"PatientID": "p", "SeriesNumber": "4", "Rows": "2", "Columns": "2", "BitsAllocated": "32", "PixelRepresentation": "0"}
    whole = dicom.build({"Modality": "CT"}) + sequences + dicom.build(tags)[body:] + struct.pack("<HH2s2xI", 0x7FE0, 0x10, b"OW", 16) + pixels.tobytes()
    (tmp_path / "a.dcm").write_bytes(whole)
    (tmp_path / "b.dcm").write_bytes(whole[:-3])
    (tmp_path / "c.dcm").write_bytes(whole[: len(dicom.build({"Modality": "CT"})) + 30])
    (tmp_path / "d.dcm").write_bytes(dicom.build(tags | {"BitsAllocated": "64"}, np.zeros(16)))
    found = {r.path[-5:]: r for r in dicom.read(spark, str(tmp_path), pixels=True).collect()}
    assert found["a.dcm"].tags == tags | {"Modality": "CT"} and found["a.dcm"].data == pixels.tolist() and found["a.dcm"].status == "ok"
    assert found["b.dcm"].status == found["c.dcm"].status == "truncated" and found["c.dcm"].tags == {"Modality": "CT"}
    assert found["d.dcm"].status == "unsupported_format" and found["d.dcm"].data is None
