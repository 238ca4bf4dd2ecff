"""Ridge without shipping the stimulus: additive statistics (survey section 7.2, plan A).

When the stimulus matrix is too large to broadcast (very long recordings),
everything the bootstrap needs is an additive statistic over frames:

* per row set ``s`` (each bootstrap's held-out rows, the whole training part,
  the test part): ``n_s``, ``sum x``, ``X_s^T X_s``;
* per fit set (the training part, and without each bootstrap's held-out rows): a
  triangular factor of its rows (``factor``), which keeps small singular values;
* per series and set: ``X_s^T y``, ``sum y``, ``sum y^2``.

Training statistics of a bootstrap are "training part minus its held-out
set".  The sets are assigned by Spark (ordered split, chunking, seeded
hold-out draw - no frame list on the driver); the Gram matrices (features x
features, independent of the frame count) are the only broadcast.  Per-series
statistics are grouped into one row per series; from there on the algebra is
that of the packed plan (``ridge_moments``).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlex.functions.scalar import nan_to_zero
from voxlex.operators.factor import triangles
from voxlex.operators.ridge import RidgeParams, Source, _list_array, solver_of
from voxlex.operators.ridge_moments import BLOCK_BYTES, SCRATCH_BYTES, TEST, TRAIN, RowMoments, SeriesMoments, Solver
from voxlex.operators.splits import (ordered_split, chunk_ids, holdout_chunks, holdout_rows,
                                     default_nchunks)
from voxlex.session import cut_lineage

def row_sets(x_df: DataFrame, y_df: DataFrame, p: RidgeParams, frame_col: str = "tr") -> DataFrame:
    """(tr, s): set membership of every aligned frame; s = boot id, -1 train, -2 test."""
    fr = x_df.select(frame_col).distinct().join(y_df.select(frame_col).distinct(), frame_col)
    split = cut_lineage(ordered_split(fr, frame_col, p.test_size))
    train = split.where(~F.col("is_test")).select(frame_col, F.lit(TRAIN).alias("s"))
    test = split.where(F.col("is_test")).select(frame_col, F.lit(TEST).alias("s"))
    sets = train.unionByName(test)
    if p.nboots > 0:
        chunks = chunk_ids(split, p.chunklen)
        n_train = split.where(~F.col("is_test")).count()
        nchunks = p.nchunks if p.nchunks is not None else default_nchunks(n_train, p.chunklen)
        held = holdout_rows(chunks, holdout_chunks(chunks, p.nboots, nchunks, p.seed, p.draw))
        sets = sets.unionByName(held.select(frame_col, F.col("boot").alias("s")))
    return sets


def _frame_blocks(x_df: DataFrame, sets: DataFrame, frame_col: str, x_col: str, fblock: int):
    """Stimulus rows with their set memberships, grouped into frame blocks (bounded size)."""
    fb = F.floor(F.col(frame_col) / F.lit(fblock)).cast("long").alias("_fb")
    member = sets.groupBy(frame_col).agg(F.collect_list("s").alias("_sets"))
    xb = (x_df.select(frame_col, x_col).join(member, frame_col)
              .groupBy(fb).agg(F.collect_list(F.struct(frame_col, x_col, "_sets")).alias("_xs")))
    return xb, member, fb


def _block_arrays(xs, frame_col: str, x_col: str, width: int):
    """(frames, X, memberships) of one frame block, ordered by frame."""
    tr = xs.field(frame_col).to_numpy(zero_copy_only=False)
    order = np.argsort(tr)
    xmat = xs.field(x_col).flatten().to_numpy(zero_copy_only=False).reshape(len(tr), width)[order]
    lists = xs.field("_sets")
    member = [lists[int(k)].as_py() for k in order]
    return tr[order], xmat, member


def _block_size(width: int) -> int:
    return max(1, (32 << 20) // (8 * max(width, 1)))


def cross_products(x_df: DataFrame, sets: DataFrame | None, frame_col: str = "tr", x_col: str = "x",
                   width: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(s, n, sx, g): count, sums and ``X^T X`` (row-major) of every row set.

    ``sets`` (frame, s) names the sets of each frame; None: ``x_df`` has the
    column itself.  Inside a task rows are multiplied in blocks and added up
    per set, so each task sends one matrix per set it met.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    if width is None:
        width = x_df.select(F.max(F.size(x_col))).first()[0] or 0
    rows = x_df.select(F.col("s"), x_col) if sets is None else x_df.join(sets, frame_col).select("s", x_col)
    kind = rows.schema["s"].dataType
    schema = T.StructType([T.StructField("s", kind), T.StructField("n", T.LongType()),
                           T.StructField("sx", T.ArrayType(T.DoubleType())),
                           T.StructField("g", T.ArrayType(T.DoubleType()))])
    step, most = block_rows or _block_size(width), max(1, (64 << 20) // (8 * max(1, width * width)))

    def run(batches):
        acc: dict = {}

        def flush():
            ids = list(acc)
            n, sx, g = (np.array([acc[i][j] for i in ids]) for j in range(3))
            acc.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, _arrow_type(kind)), pa.array(n, pa.int64()), _list_array(sx),
                 _list_array(g.reshape(len(ids), -1))], names=["s", "n", "sx", "g"])

        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                ids = part.column(0).to_pylist()
                code = {v: i for i, v in enumerate(dict.fromkeys(ids))}
                at = np.array([code[v] for v in ids])
                for v, i in code.items():
                    xs = x[at == i]
                    got = (len(xs), xs.sum(0), xs.T @ xs)
                    acc[v] = tuple(p + q for p, q in zip(acc[v], got)) if v in acc else got
                if len(acc) > most:
                    yield flush()
        if acc:
            yield flush()

    part = rows.mapInArrow(run, schema)
    g = (part.select("s", "n", array_to_vector("sx").alias("_sx"), array_to_vector("g").alias("_g"))
             .groupBy("s").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("_sx")).alias("_sx"),
                               Summarizer.sum(F.col("_g")).alias("_g")))
    return g.select("s", "n", vector_to_array("_sx").alias("sx"), vector_to_array("_g").alias("g"))


def set_moments(x_df: DataFrame, sets: DataFrame, frame_col: str = "tr", x_col: str = "x",
                max_bytes: int = 1 << 30) -> dict:
    """{s: RowMoments}; only (sets x features x features) numbers reach the
    driver, after their size is checked."""
    width = x_df.select(F.max(F.size(x_col))).first()[0] or 0
    n_sets = sets.select("s").distinct().count()
    if 2 * n_sets * width * width * 8 > max_bytes:       # with as many factors (fit_factors)
        raise ValueError(f"{n_sets} cross products of width {width} exceed the broadcast limit")
    return {int(r["s"]): RowMoments(int(r["n"]), np.asarray(r["sx"]), np.asarray(r["g"]).reshape(width, width))
            for r in cross_products(x_df, sets, frame_col, x_col, width).collect()}


def series_stats(x_df: DataFrame, y_df: DataFrame, sets: DataFrame, keys, frame_col: str = "tr",
                 x_col: str = "x", value: str = "value", width: int | None = None,
                 frame_block: int | None = None, series_buckets: int | None = None) -> DataFrame:
    """One row per series: per set, ``X_s^T y`` (N values), sum y, sum y^2.

    Blocked product: stimulus rows are grouped into frame blocks (at most
    ``frame_block`` frames, about 32 MB of features each), responses into
    (frame block, series bucket) blocks, and the two are joined on the
    frame block - the stimulus block is replicated once per series bucket,
    never once per series.  Each joined pair is one BLAS product per set
    inside an Arrow task; partial results are summed across frame blocks by
    a map-side-combined aggregate.  Frames a series lacks count as 0.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    keys = list(keys)
    spark = y_df.sparkSession
    if width is None:
        width = x_df.select(F.max(F.size(x_col))).first()[0] or 0
    fblock = frame_block or _block_size(width)
    if series_buckets is None:
        # cells of a (frame block, bucket) group and their products stay within SCRATCH_BYTES, or
        # twice the stimulus block that comes with them
        series, frames = y_df.agg(F.countDistinct(F.struct(*keys)), F.countDistinct(frame_col)).first()
        deep = min(frames, fblock)
        one = deep * 8 * (len(keys) + 4) + 3 * 8 * width
        most = min(BLOCK_BYTES, max(SCRATCH_BYTES, 2 * 8 * deep * width))
        series_buckets = max(spark.sparkContext.defaultParallelism, -(-series * one // most))
    buckets = series_buckets
    xb, member, fb = _frame_blocks(x_df, sets, frame_col, x_col, fblock)
    yb = (y_df.select(*keys, frame_col, nan_to_zero(value).alias("_y"))
              .join(member.select(frame_col), frame_col, "left_semi")
              .groupBy(fb, F.pmod(F.hash(*keys), F.lit(buckets)).alias("_sb"))
              .agg(F.collect_list(F.struct(*keys, frame_col, "_y")).alias("_ys")))
    pairs = yb.join(xb, "_fb").select("_ys", "_xs")
    key_fields = [y_df.schema[k] for k in keys]
    schema = T.StructType(key_fields + [T.StructField("s", T.IntegerType()),
                                        T.StructField("c", T.ArrayType(T.DoubleType())),
                                        T.StructField("sy", T.DoubleType()), T.StructField("syy", T.DoubleType())])

    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def run(batches):
        import pandas as pd
        for batch in batches:
            for i in range(batch.num_rows):
                tr_x, xmat, per_frame = _block_arrays(batch.column("_xs")[i].values, frame_col, x_col, width)
                ys = batch.column("_ys")[i].values
                kdf = pd.DataFrame({k: ys.field(k).to_numpy(zero_copy_only=False) for k in keys})
                sid = kdf.groupby(keys, sort=False).ngroup().to_numpy()
                uniq = kdf.drop_duplicates(keys).reset_index(drop=True)
                ymat = np.zeros((len(tr_x), len(uniq)))
                rows = np.searchsorted(tr_x, ys.field(frame_col).to_numpy(zero_copy_only=False))
                ymat[rows, sid] = ys.field("_y").to_numpy(zero_copy_only=False)
                all_sets = sorted({s for lst in per_frame for s in lst})
                for s_id in all_sets:
                    m = np.array([s_id in lst for lst in per_frame])
                    ysub = ymat[m]
                    c = xmat[m].T @ ysub
                    cols = [pa.array(uniq[k].to_numpy()) for k in keys]
                    cols += [pa.array(np.full(len(uniq), s_id, dtype=np.int32)),
                             _list_array(c.T), pa.array(ysub.sum(0)), pa.array((ysub * ysub).sum(0))]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    part = pairs.mapInArrow(run, schema)
    per = (part.select(*keys, "s", array_to_vector("c").alias("_c"), "sy", "syy")
               .groupBy(*keys, "s").agg(Summarizer.sum(F.col("_c")).alias("_c"), F.sum("sy").alias("sy"),
                                        F.sum("syy").alias("syy")))
    per = per.select(*keys, "s", vector_to_array("_c").alias("c"), "sy", "syy")
    return per.groupBy(*keys).agg(F.collect_list(F.struct("s", "c", "sy", "syy")).alias("stats"))


def _arrow_type(dt):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(dt)


class AdditiveReader:
    """Moments of series that were aggregated per row set."""

    columns = ["stats"]

    def __init__(self, bc, nboots: int, cutoff: float, keep_small: bool):
        self.bc, self.nboots, self.cutoff, self.keep_small = bc, nboots, cutoff, keep_small

    def open(self):
        v = self.bc.value
        sets = v["sets"]
        self.width = len(sets[TRAIN].total)
        self.solvers = [solver_of(v["token"], lambda: Solver(sets, self.nboots, self.cutoff, self.keep_small, v["fits"]))]
        self.block = max(1, SCRATCH_BYTES // (8 * self.width * (2 * self.nboots + 4)))
        return self

    def moments(self, batch):
        m, sets = batch.num_rows, [TRAIN, TEST, *range(self.nboots)]
        cross = {s: np.zeros((self.width, m)) for s in sets}
        total, square = ({s: np.zeros(m) for s in sets} for _ in range(2))
        stats = batch.column("stats")
        series = np.repeat(np.arange(m), np.diff(stats.offsets.to_numpy()))
        e = stats.flatten()
        which = e.field("s").to_numpy(zero_copy_only=False)
        c = e.field("c").flatten().to_numpy(zero_copy_only=False).reshape(len(which), self.width)
        sy, syy = (e.field(k).to_numpy(zero_copy_only=False) for k in ("sy", "syy"))
        for s in sets:
            at = which == s
            cross[s][:, series[at]] = c[at].T
            total[s][series[at]] = sy[at]
            square[s][series[at]] = syy[at]
        return [SeriesMoments(cross, total, square)]


def fit_factors(x_df: DataFrame, sets: DataFrame, nboots: int, width: int, frame_col: str = "tr",
                x_col: str = "x") -> dict:
    """{bootstrap or TRAIN: triangular factor of its fit set}; ``set_moments`` has
    checked the size of as many matrices."""
    train = sets.where(F.col("s") == TRAIN).select(frame_col)
    fits = train.select(frame_col, F.lit(TRAIN).alias("s"))
    if nboots:
        every = train.select(frame_col, F.explode(F.sequence(F.lit(0), F.lit(nboots - 1))).alias("s"))
        fits = fits.unionByName(every.join(sets.where("s >= 0"), [frame_col, "s"], "left_anti"))
    rows: dict = {}
    for r in triangles(x_df.join(fits, frame_col).select("s", F.col(x_col).alias("x")), width).collect():
        rows.setdefault(int(r["s"]), []).append(r["x"])
    return {s: np.array(v) for s, v in rows.items()}


def additive_source(x_df: DataFrame, y_df: DataFrame, keys, p: RidgeParams, frame_col: str = "tr",
                    x_col: str = "x", value: str = "value") -> Source:
    """The moments of every series without shipping the stimulus."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    sets = cut_lineage(row_sets(x_df, y_df, p, frame_col))
    moments = set_moments(x_df, sets, frame_col, x_col, p.max_broadcast_bytes)
    width = len(next(iter(moments.values())).total)
    stats = series_stats(x_df, y_df, sets, keys, frame_col, x_col, value, width=width)
    fits = fit_factors(x_df, sets, p.nboots, width, frame_col, x_col)
    bc = stats.sparkSession.sparkContext.broadcast({"sets": moments, "fits": fits, "token": uuid.uuid4().hex})
    return Source(stats, keys, AdditiveReader(bc, p.nboots, p.singcutoff, p.return_weights))
