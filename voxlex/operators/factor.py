"""Tall-skinny QR as a tree of block QRs, and the thin SVD on top (survey G1).

A task folds its rows block by block into one triangular factor R (at most
``width`` rows) with ``R^T R = X^T X``; the factors of the tasks are stacked and
folded again, ``FAN`` at a time, until one per row set is left.  Factors travel
as ordinary rows of ``width`` values, so nothing wider than an input row and
nothing but R leaves a task.  Unlike cross products, R keeps the condition of X:
singular values down to 1e-12 of the largest are resolved.

Rows with a null vector are left out; an empty set has no factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlex.operators.ridge_moments import ROW_TOL
from voxlex.session import cut_lineage

#: Factors stacked in one step of the tree.
FAN = 16
#: Bytes of rows a task holds before it folds them.
FOLD_BYTES = 32 << 20


def fold_rows(stack: np.ndarray) -> np.ndarray:
    """R of the rows (the rows themselves while there are no more than columns)."""
    return np.linalg.qr(stack, mode="r") if len(stack) > stack.shape[1] else stack


class Folder:
    """Rows of several groups, folded whenever enough of one are held."""

    def __init__(self, width: int):
        self.width = width
        self.most = width + max(width, FOLD_BYTES // (8 * max(width, 1)))
        self.held: dict = {}

    def add(self, key, rows: np.ndarray) -> None:
        for a in range(0, len(rows), self.most):
            part = rows[a:a + self.most]
            old = self.held.get(key)
            stack = part if old is None else np.vstack([old, part])
            self.held[key] = fold_rows(stack) if len(stack) >= self.most else stack

    def factors(self):
        for key, stack in self.held.items():
            yield key, fold_rows(stack)


def _emit(folder: Folder, kind: pa.DataType):
    """(s, _g, x) rows of the factors, a bounded number a batch."""
    step = max(1, FOLD_BYTES // (8 * max(folder.width, 1)))
    for (s, g), r in folder.factors():
        for a in range(0, len(r), step):
            part = np.ascontiguousarray(r[a:a + step])
            offsets = pa.array(np.arange(0, part.size + 1, folder.width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(part), kind), pa.array(np.full(len(part), g, np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], names=["s", "_g", "x"])


def _fold_step(rows: DataFrame, width: int) -> DataFrame:
    """(s, _g, x) -> (s, _g, x): within each task, the rows of every group folded."""
    from pyspark.sql.pandas.types import to_arrow_type
    spec = T.StructType([rows.schema["s"], T.StructField("_g", T.LongType()),
                         T.StructField("x", T.ArrayType(T.DoubleType()))])
    kind = to_arrow_type(rows.schema["s"].dataType)

    def run(batches):
        folder = Folder(width)
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            keys = list(zip(b.column("s").to_pylist(), b.column("_g").to_pylist()))
            code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            at = np.array([code[k] for k in keys])
            for k, i in code.items():
                folder.add(k, x[at == i])
        yield from _emit(folder, kind)

    return rows.select("s", "_g", "x").mapInArrow(run, spec)


def triangles(rows: DataFrame, width: int | None = None, x_col: str = "x", fan: int = FAN) -> DataFrame:
    """(s, x): for every row set ``s`` at most ``width`` rows R with
    ``R^T R = X_s^T X_s``.  ``rows``: (s, x), one row per stimulus row."""
    rows = rows.where(F.col(x_col).isNotNull()).select("s", F.col(x_col).cast("array<double>").alias("x"))
    if width is None:
        width = rows.select(F.max(F.size("x"))).first()[0] or 0
    step = cut_lineage(_fold_step(rows.withColumn("_g", F.lit(0).cast("long")), width)
                       .withColumn("_g", F.spark_partition_id().cast("long")))
    left = step.groupBy("s").agg(F.countDistinct("_g").alias("n")).agg(F.max("n")).first()[0] or 0
    while left > 1:
        left = -(-left // fan)
        step = step.withColumn("_g", F.pmod(F.xxhash64("_g"), F.lit(left)))
        step = _fold_step(step.repartition("s", "_g"), width)
    return step.select("s", "x")


def thin_svd(r: DataFrame, width: int, cutoff: float = 0.0) -> DataFrame:
    """(s, k, sigma, v) of the factors, one task per set; values at most
    ``cutoff``, or ``ROW_TOL`` of the largest, are dropped."""
    from pyspark.sql.pandas.types import to_arrow_type
    spec = T.StructType([r.schema["s"], T.StructField("k", T.IntegerType()), T.StructField("sigma", T.DoubleType()),
                         T.StructField("v", T.ArrayType(T.DoubleType()))])
    kind = to_arrow_type(r.schema["s"].dataType)

    def run(batches):
        folder = Folder(width)
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            ids = b.column("s").to_pylist()
            for s in dict.fromkeys(ids):
                folder.add((s, 0), x[np.array([i == s for i in ids])])
        for (s, _), tri in folder.factors():
            _, sing, vt = np.linalg.svd(tri, full_matrices=False)
            n = int((sing > max(cutoff, ROW_TOL * sing[0])).sum()) if len(sing) else 0
            offsets = pa.array(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)[:n + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * n, kind), pa.array(np.arange(n, dtype=np.int32)), pa.array(sing[:n]),
                 pa.ListArray.from_arrays(offsets, pa.array(vt[:n].ravel()))], names=["s", "k", "sigma", "v"])

    return r.repartition("s").mapInArrow(run, spec)
