"""Response surface files (survey A3): a Spark data source that reads and writes them.

One file holds one hemisphere of one recording: XML with one data array per
frame, each a number per vertex as text, base64 or zlib-compressed base64.
Names say what a file holds: ``sub-<subject>_task-<task>_hemi-<L|R>.func.gii``,
in any folder below the path.

Reading: the listing is pruned by the ``subject``, ``task`` and ``hemi`` options
before any file is opened; every file is a partition, decoded in its task as a
stream, one frame at a time.  Writing: rows must arrive grouped by file and
ordered by frame (``write_surfaces`` sees to it); a task writes its files under a
name of its own attempt, and only committed tasks' files get their final names.
Paths are opened by pyarrow file systems (``file``, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "subject string, task string, hemi string, tr int, voxel int, value double"
NAME = re.compile(r"sub-(?P<subject>[^_/]+)_task-(?P<task>[^_/]+)_hemi-(?P<hemi>[^_./]+)\.func\.gii$")
#: Data types of the format (fixed values).
TYPES = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8"}
HEAD = ('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE GIFTI SYSTEM "http://www.nitrc.org/frs/download.php/115/gifti.dtd">\n'
        '<GIFTI Version="1.0" NumberOfDataArrays="{n}">\n')


def decode_array(attributes: dict, text: str) -> np.ndarray:
    """The numbers of one data array, as float64 (vertices, or vertices x frames)."""
    kind = TYPES.get(attributes.get("DataType", ""))
    if kind is None:
        raise ValueError(f"data type {attributes.get('DataType')!r} of a surface array")
    how = attributes.get("Encoding", "ASCII")
    if how == "ASCII":
        flat = np.array(text.split(), np.float64)
    elif how in ("Base64Binary", "GZipBase64Binary"):
        raw = base64.b64decode(text)
        raw = zlib.decompress(raw) if how.startswith("GZip") else raw
        flat = np.frombuffer(raw, (">" if attributes.get("Endian") == "BigEndian" else "<") + kind).astype(np.float64)
    else:
        raise ValueError(f"encoding {how!r} of a surface array")
    dims = [int(attributes[f"Dim{i}"]) for i in range(int(attributes.get("Dimensionality", "1")))]
    order = "F" if attributes.get("ArrayIndexingOrder") == "ColumnMajorOrder" else "C"
    return flat.reshape(dims, order=order)


def frames_of(stream):
    """The frames of a file, one array of vertices after the other; of the whole
    file one data array at a time is in memory."""
    from xml.etree import ElementTree
    root = None
    for event, node in ElementTree.iterparse(stream, events=("start", "end")):
        if root is None:
            root = node
        if event == "end" and node.tag == "DataArray":
            data = node.find("Data")
            got = decode_array(node.attrib, (data.text or "").strip() if data is not None else "")
            yield from (got.reshape(len(got), -1).T if got.ndim > 1 else [got])
            root.clear()


def encode_array(values: np.ndarray) -> str:
    """One frame as a compressed data array."""
    data = base64.b64encode(zlib.compress(np.ascontiguousarray(values, "<f8").tobytes(), 6)).decode()
    return ('<DataArray Intent="NIFTI_INTENT_TIME_SERIES" DataType="NIFTI_TYPE_FLOAT64" ArrayIndexingOrder="RowMajorOrder" '
            f'Dimensionality="1" Dim0="{len(values)}" Encoding="GZipBase64Binary" Endian="LittleEndian" ExternalFileName="" '
            f'ExternalFileOffset="">\n<Data>{data}</Data>\n</DataArray>\n')


def _open(path: str):
    from pyarrow import fs
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def _values(option: str | None):
    return None if option is None else set(option.split(","))


@dataclass
class SurfaceFile(InputPartition):
    path: str
    subject: str
    task: str
    hemi: str


class SurfaceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.want = {k: _values(options.get(k)) for k in ("subject", "task", "hemi")}

    def partitions(self):
        """One per file that the options ask for."""
        from pyarrow import fs
        system, path = _open(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        out = []
        for info in sorted(found, key=lambda f: f.path):
            name = NAME.search(info.path)
            if info.type == fs.FileType.File and name and "/_" not in info.path[len(path):] and all(
                    v is None or name[k] in v for k, v in self.want.items()):
                out.append(SurfaceFile(info.path, name["subject"], name["task"], name["hemi"]))
        return out

    def read(self, part):
        if part is None:                       # no file at all
            return
        system, _ = _open(self.root)
        with system.open_input_stream(part.path) as stream:
            for tr, values in enumerate(frames_of(stream)):
                n = len(values)
                names = [pa.array([v] * n, pa.string()) for v in (part.subject, part.task, part.hemi)]
                yield pa.RecordBatch.from_arrays(
                    names + [pa.array(np.full(n, tr, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(values)],
                    names=["subject", "task", "hemi", "tr", "voxel", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class SurfaceWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.vertices = options["path"].rstrip("/"), int(options["vertices"])
        self.job = uuid.uuid4().hex

    def write(self, rows):
        """Files of one task: every frame up to the last, vertices without a value as NaN."""
        from itertools import groupby
        system, path = _open(self.root)
        folder = f"{path}/_{self.job}/{uuid.uuid4().hex}"
        files = []
        for (subject, task, hemi), group in groupby(rows, key=lambda r: (r[0], r[1], r[2])):
            name = f"sub-{subject}_task-{task}_hemi-{hemi}.func.gii"
            if not NAME.search(name) or any(name == f[1] for f in files):
                raise ValueError(f"surface rows of {name} are not together, or it is no name of a file")
            system.create_dir(folder, recursive=True)
            body, n = f"{folder}/{name}", 0
            with system.open_output_stream(body) as out:
                out.write(HEAD.format(n="0" * 10).encode())
                for tr, frame in groupby(group, key=lambda r: r[3]):
                    if tr < n:
                        raise ValueError(f"frames of {name} are not in order")
                    for _ in range(n, tr):             # frames without any value
                        out.write(encode_array(np.full(self.vertices, np.nan)).encode())
                    values = np.full(self.vertices, np.nan)
                    for r in frame:
                        if r[5] is not None:
                            values[r[4]] = r[5]
                    out.write(encode_array(values).encode())
                    n = tr + 1
                out.write(b"</GIFTI>\n")
            files.append((body, name))
        return Written(files)

    def commit(self, messages):
        system, path = _open(self.root)
        for m in messages:
            for body, name in (m.files if m else []):
                system.move(body, f"{path}/{name}")
        self._clear(system, path)

    def abort(self, messages):
        self._clear(*_open(self.root))

    def _clear(self, system, path):
        from pyarrow import fs
        if system.get_file_info(f"{path}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_{self.job}")


class SurfaceDataSource(DataSource):
    """``spark.read.format("surface")`` and ``df.write.format("surface")``."""

    @classmethod
    def name(cls):
        return "surface"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SurfaceReader(dict(self.options))

    def writer(self, schema, overwrite):
        return SurfaceWriter(dict(self.options))


def read_surfaces(spark: SparkSession, path: str, subject=None, task=None, hemi=None) -> DataFrame:
    """(subject, task, hemi, tr, voxel, value) of the surface files below ``path``;
    ``tr`` is the place of a frame in its file.  Each argument is a value or a
    list; files that it leaves out are not opened."""
    spark.dataSource.register(SurfaceDataSource)
    r = spark.read.format("surface").option("path", path)
    for key, v in (("subject", subject), ("task", task), ("hemi", hemi)):
        if v is not None:
            r = r.option(key, ",".join(map(str, v)) if isinstance(v, (list, tuple, set)) else str(v))
    return r.load()


def write_surfaces(df: DataFrame, path: str, vertices: int) -> None:
    """Write (subject, task, hemi, tr, voxel, value) as surface files, one per
    subject, task and hemisphere, by tasks in parallel.  Cells without a row are
    NaN; ``vertices``: numbers a frame has."""
    df.sparkSession.dataSource.register(SurfaceDataSource)
    names = ["subject", "task", "hemi"]
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in names], F.col("tr").cast("int").alias("tr"),
                     F.col("voxel").cast("int").alias("voxel"), F.col("value").cast("double").alias("value"))
    (rows.repartition(*names).sortWithinPartitions(*names, "tr", "voxel").write.format("surface")
     .option("path", path).option("vertices", str(vertices)).mode("append").save())
