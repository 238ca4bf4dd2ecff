"""Surface files: formats, pruning, writing by tasks."""

import base64
import io
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlex.sources import surface as su


def array_xml(values, how="GZipBase64Binary", kind="NIFTI_TYPE_FLOAT32", endian="LittleEndian", order="RowMajorOrder"):
    code = (">" if endian == "BigEndian" else "<") + su.TYPES[kind]
    raw = values.astype(code).tobytes(order="F" if order == "ColumnMajorOrder" else "C")
    text = {"ASCII": " ".join(repr(float(v)) for v in values.ravel(order="F" if order == "ColumnMajorOrder" else "C")),
            "Base64Binary": base64.b64encode(raw).decode(), "GZipBase64Binary": base64.b64encode(zlib.compress(raw)).decode()}[how]
    dims = " ".join(f'Dim{i}="{d}"' for i, d in enumerate(values.shape))
    return (f'<DataArray Intent="x" DataType="{kind}" ArrayIndexingOrder="{order}" Dimensionality="{values.ndim}" {dims} '
            f'Encoding="{how}" Endian="{endian}"><MetaData/><Data>{text}</Data></DataArray>')


def file_xml(arrays):
    return ("<?xml version='1.0'?>\n<GIFTI Version='1.0'><MetaData/>" + "".join(arrays) + "</GIFTI>").encode()


@pytest.mark.parametrize("how", ["ASCII", "Base64Binary", "GZipBase64Binary"])
@pytest.mark.parametrize("kind, endian", [("NIFTI_TYPE_FLOAT32", "LittleEndian"), ("NIFTI_TYPE_FLOAT64", "BigEndian"),
                                          ("NIFTI_TYPE_INT32", "BigEndian"), ("NIFTI_TYPE_UINT8", "LittleEndian")])
def test_every_encoding_is_decoded(how, kind, endian):
    x = np.arange(12).reshape(3, 4) * 3.0
    got = list(su.frames_of(io.BytesIO(file_xml([array_xml(f, how, kind, endian) for f in x]))))
    assert np.array_equal(got, x)
    for order in ("RowMajorOrder", "ColumnMajorOrder"):        # vertices x frames in one array
        whole = list(su.frames_of(io.BytesIO(file_xml([array_xml(x, how, kind, endian, order)]))))
        assert np.array_equal(whole, x.T)


def test_unknown_types_are_refused():
    with pytest.raises(ValueError):
        su.decode_array({"DataType": "NIFTI_TYPE_RGB24", "Dim0": "1"}, "")
    with pytest.raises(ValueError):
        su.decode_array({"DataType": "NIFTI_TYPE_UINT8", "Encoding": "ExternalFileBinary", "Dim0": "1"}, "")


def test_listing_is_pruned_before_files_are_opened(tmp_path, spark):
    x = np.arange(8.0).reshape(2, 4)
    for sub in ("001", "002"):
        os.makedirs(tmp_path / sub)
        for hemi in "LR":
            (tmp_path / sub / f"sub-{sub}_task-story_hemi-{hemi}.func.gii").write_bytes(
                file_xml([array_xml(f + int(sub)) for f in x]) if sub == "001" else b"broken")
    (tmp_path / "notes.txt").write_text("no surface")
    assert len(su.SurfaceReader({"path": str(tmp_path)}).partitions()) == 4
    assert [p.hemi for p in su.SurfaceReader({"path": str(tmp_path), "subject": "001,003", "hemi": "R"}).partitions()] == ["R"]
    got = su.read_surfaces(spark, str(tmp_path), subject="001")
    assert got.rdd.getNumPartitions() == 2
    cells = {(r["hemi"], r["tr"], r["voxel"]): r["value"] for r in got.collect()}
    assert cells == {(h, t, v): x[t, v] + 1 for h in "LR" for t in range(2) for v in range(4)}
    assert su.read_surfaces(spark, str(tmp_path), task="other").collect() == []


def test_files_written_by_tasks_are_read_back(tmp_path, spark):
    rows = [(s, "story", h, t, v, float(100 * t + v) if (t + v) % 3 else None)
            for s in ("1", "2") for h in "LR" for t in (0, 2, 3) for v in range(5) if v != 4 or t == 2]
    df = spark.createDataFrame(rows, su.SCHEMA).withColumn("extra", F.lit(1)).repartition(7)
    path = f"file://{tmp_path}/out"
    su.write_surfaces(df, path, 6)
    assert sorted(os.listdir(tmp_path / "out")) == [f"sub-{s}_task-story_hemi-{h}.func.gii" for s in "12" for h in "LR"]
    got = {tuple(r)[:5]: r["value"] for r in su.read_surfaces(spark, path).collect()}
    assert len(got) == 2 * 2 * 4 * 6
    want = {r[:5]: r[5] for r in rows if r[5] is not None}
    for key, v in got.items():
        assert v == want[key] if key in want else np.isnan(v)


def test_rows_that_are_not_together_are_refused(tmp_path):
    w = su.SurfaceWriter({"path": str(tmp_path), "vertices": "2"})
    row = lambda s, t: (s, "a", "L", t, 0, 1.0)
    with pytest.raises(ValueError):
        w.write(iter([row("1", 0), row("2", 0), row("1", 1)]))
    with pytest.raises(ValueError):
        w.write(iter([row("1", 1), row("1", 0)]))
    w.abort([])
    assert os.listdir(tmp_path) == []
