"""PCA of the stimulus (survey G13, G14, E9).

Two fits.  ``covariance`` is Spark ML's: a distributed covariance and one
eigendecomposition of features x features numbers.  ``randomised`` never forms
the covariance C: it starts from random directions and widens the space they
span by C times the newest block, one scan a round, until the leading
eigenpairs inside the space satisfy ``|C v - l v| <= tol * l_1`` (at the latest
when the space is everything, where it is exact).  A scan sends ``width x block``
numbers a task.

Both project the *uncentred* rows (``X @ components.T``), which is exactly the
projection the analysis uses.  Component signs are arbitrary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Features from which a fit is randomised by default.
WIDE = 768
#: Numbers of one row that a task sends, and bytes of the space kept on the driver.
CHUNK, MAX_SPACE_BYTES = 1 << 17, 1 << 30


@dataclass(frozen=True)
class PcaModel:
    """``components`` (k x features), their variances, all features' variance
    and the largest residual of an eigenpair relative to the first variance."""
    components: np.ndarray
    variances: np.ndarray
    total: float
    residual: float
    rounds: int

    @property
    def ratios(self) -> np.ndarray:
        return self.variances / self.total if self.total else np.zeros(len(self.variances))


def times_covariance(x_df: DataFrame, block: np.ndarray, x_col: str = "x") -> tuple:
    """(count, sums, sum of squares, ``X^T X block``) in one scan of the rows."""
    from pyspark.ml.stat import Summarizer
    width, l = block.shape
    bc = x_df.sparkSession.sparkContext.broadcast(block)
    step = max(1, CHUNK // max(l, 1))

    def run(batches):
        b = bc.value
        n, total, square, out = 0, np.zeros(width), 0.0, np.zeros((width, l))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                n += len(x)
                total += x.sum(0)
                square += float((x * x).sum())
                out += x.T @ (x @ b)
        if n:
            rows = [(-1, np.concatenate([[n, square], total]))]
            rows += [(i, out[i:i + step].ravel()) for i in range(0, width, step)]
            for i, v in rows:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))],
                                                 names=["i", "v"])

    part = x_df.select(F.col(x_col).cast("array<double>").alias("x")).mapInArrow(run, "i int, v array<double>")
    got = {r["i"]: np.asarray(r["v"]) for r in part.select("i", array_to_vector("v").alias("v")).groupBy("i").agg(
        Summarizer.sum(F.col("v")).alias("v")).select("i", vector_to_array("v").alias("v")).collect()}
    if not got:
        return 0, np.zeros(width), 0.0, np.zeros((width, l))
    head = got.pop(-1)
    return int(head[0]), head[2:], head[1], np.concatenate([got[i] for i in sorted(got)]).reshape(width, l)


def pca_fit_randomised(x_df: DataFrame, k: int, x_col: str = "x", oversample: int = 10, tol: float = 1e-9,
                       max_rounds: int = 100, seed: int = 42) -> PcaModel:
    """``k`` components (at most as many as features or rows) without a covariance."""
    width = x_df.select(F.max(F.size(x_col))).first()[0] or 0
    l = min(k + oversample, width)
    if 16 * width * min(width, 4 * l) > MAX_SPACE_BYTES:
        raise ValueError(f"a space of {l} directions over {width} features exceeds {MAX_SPACE_BYTES} bytes")
    rng = np.random.default_rng(seed)
    new, _ = np.linalg.qr(rng.normal(size=(width, l)))
    space, image = np.zeros((width, 0)), np.zeros((width, 0))      # orthonormal, and C times it
    for rounds in range(1, max_rounds + 1):
        n, total, square, got = times_covariance(x_df, new, x_col)
        if n == 0:
            return PcaModel(np.zeros((0, width)), np.zeros(0), 0.0, 0.0, rounds)
        mean, free = total / n, max(n - 1, 1)
        got = (got - n * np.outer(mean, mean @ new)) / free
        space, image = np.hstack([space, new]), np.hstack([image, got])
        small = space.T @ image
        lam, e = np.linalg.eigh((small + small.T) / 2)
        lam, e = np.clip(lam[::-1][:k], 0.0, None), e[:, ::-1][:, :k]
        rest = image @ e - (space @ e) * lam
        top = max(float(lam[0]) if len(lam) else 0.0, np.finfo(float).tiny)
        residual = float(np.sqrt((rest ** 2).sum(0)).max(initial=0.0)) / top
        if residual <= tol or space.shape[1] >= width or 16 * width * (space.shape[1] + l) > MAX_SPACE_BYTES:
            break
        # the newest images without what the space holds already, twice for rounding
        new = got
        for _ in range(2):
            new = new - space @ (space.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-12 * top][:, :width - space.shape[1]]
        if not new.shape[1]:
            break
    keep = min(k, max(n - 1, 1), width)
    comp = (space @ e)[:, :keep].T
    comp = comp * np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(1)])[:, None]
    return PcaModel(comp, lam[:keep], (square - n * float(mean @ mean)) / free, residual, rounds)


def pca_fit(x_df: DataFrame, k: int, x_col: str = "x", method: str = "auto"):
    """Fit PCA with ``k`` components on the rows of ``x_df`` by ``covariance`` or
    ``randomised``; ``auto`` takes the latter from ``WIDE`` features."""
    if method == "auto":
        method = "randomised" if (x_df.select(F.max(F.size(x_col))).first()[0] or 0) >= WIDE else "covariance"
    if method == "randomised":
        return pca_fit_randomised(x_df, k, x_col)
    v = x_df.select(array_to_vector(x_col).alias("_features"))
    return PCA(k=k, inputCol="_features", outputCol="_pc").fit(v)


def components(model) -> np.ndarray:
    """The components as rows."""
    return model.components if isinstance(model, PcaModel) else model.pc.toArray().T


def explained_ratio(model, spark) -> DataFrame:
    """(component, ratio) of a fitted model."""
    r = [float(v) for v in (model.ratios if isinstance(model, PcaModel) else model.explainedVariance.toArray())]
    return spark.createDataFrame([(i, v) for i, v in enumerate(r)], "component int, ratio double")


def pca_project(x_df: DataFrame, model, x_col: str = "x", out: str = "x", keep: int | None = None) -> DataFrame:
    """Uncentred projection onto the components; optionally only the first ``keep``."""
    cols = [c for c in x_df.columns if c != x_col]
    if isinstance(model, PcaModel):
        return _project(x_df, model.components[:keep], cols, x_col, out)
    t = model.transform(x_df.withColumn("_features", array_to_vector(x_col)))
    arr = vector_to_array("_pc")
    if keep is not None:
        arr = F.slice(arr, 1, keep)
    return t.select(*cols, arr.alias(out))


def _project(x_df: DataFrame, comp: np.ndarray, cols: list, x_col: str, out: str) -> DataFrame:
    from pyspark.sql import types as T
    from voxlex.operators.ridge import _list_array, _matrix
    bc = x_df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(comp.T))
    spec = T.StructType([x_df.schema[c] for c in cols] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] +
                                             [_list_array(_matrix(b, x_col, bc.value.shape[0]) @ bc.value)], names=cols + [out])

    return x_df.select(*cols, x_col).mapInArrow(run, spec)


def explained_curve(x_df: DataFrame, max_dim: int, step: int = 1, x_col: str = "x") -> DataFrame:
    """Cumulative explained variance for k = 1, 1+step, ... < max_dim.

    Components are nested, so one fit at the largest k gives every point of
    the curve (the original refits for each k).
    """
    ks = list(range(1, max_dim, step))
    model = pca_fit(x_df, ks[-1], x_col)
    spark = x_df.sparkSession
    ratios = explained_ratio(model, spark)
    cum = ratios.withColumn("explained", F.sum("ratio").over(
        Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = spark.createDataFrame([(k,) for k in ks], "dims int")
    return (wanted.join(cum, wanted["dims"] == cum["component"] + 1)
                  .select("dims", "explained"))
