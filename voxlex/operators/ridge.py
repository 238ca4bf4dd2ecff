"""Ridge regression for many response series at once (survey D15, G1-G12, F3).

Physical plan ("packed"):

* The stimulus ``X`` (frames x features) is small: its row count is the
  recording length.  It is collected once, after a byte-size check, and
  shipped as a broadcast together with the split and the hold-out indices.
* Responses are packed to one row per series, ``y ARRAY<DOUBLE>`` in frame
  order (one shuffle by series key).
* One ``mapInArrow`` pass over blocks of series turns them into moments
  (``ridge_moments``), scores every bootstrap x alpha, picks each series'
  alpha, refits on the whole training part and scores the test part.
  Nothing but ``(keys, alpha, score[, weights])`` leaves the task.

Beyond the broadcast limit, ``ridge_stats`` gets the same moments from
aggregates, and ``ridge_dual`` runs the packed plan on frames x frames numbers
where features outnumber frames; everything after the moments is shared.  The penalty is
``alpha**2`` on a model without intercept and without centring of X.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlex.functions.cache import worker_cache
from voxlex.functions.scalar import nan_to_zero
from voxlex.operators.ridge_moments import (SCRATCH_BYTES, TEST, TRAIN, RowMoments, SeriesMoments, Solver,
                                            pick_alpha)
from voxlex.operators.series import frame_list, MAX_FRAMES
from voxlex.operators.splits import design_indices
from voxlex.session import cut_lineage

# Largest stimulus matrix shipped to executors (bytes of float64).
MAX_BROADCAST_BYTES = 1 << 30


def alpha_grid(lo: float = 0.0, hi: float = 3.0, n: int = 20) -> list[float]:
    """Log-spaced penalties ``10**linspace(lo, hi, n)`` (1 ... 1000 by default)."""
    return [float(a) for a in np.logspace(lo, hi, n)]


def alpha_grid_df(spark, alphas) -> DataFrame:
    return spark.createDataFrame([(i, float(a)) for i, a in enumerate(alphas)],
                                 "alpha_idx int, alpha double")


@dataclass
class RidgeParams:
    alphas: list = field(default_factory=alpha_grid)
    nboots: int = 5
    chunklen: int = 10
    nchunks: int | None = None          # default int(0.2 * n_train / chunklen)
    seed: int = 42
    draw: str = "md5"                   # of the held-out chunks, or "shuffle" (splits)
    test_size: float = 0.2
    singcutoff: float = 1e-10
    normalpha: bool = False
    use_corr: bool = True
    single_alpha: bool = False
    return_weights: bool = True
    score_digits: int | None = 9        # rounding before the argmax over alphas
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES
    # Packed rows hold one value per frame and Arrow batches hold up to
    # spark.sql.execution.arrow.maxRecordsPerBatch rows; past this many frames
    # the additive plan is used instead.
    max_packed_frames: int = 20_000


# ---------------------------------------------------------------------------
# Design: split, hold-out draw and the broadcast stimulus
# ---------------------------------------------------------------------------

@dataclass
class Design:
    frames: list            # aligned frames, ascending (train part first)
    n_train: int
    held: list              # per bootstrap: positions inside the training part
    x: np.ndarray           # (len(frames), n_features)
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def payload(self) -> dict:
        """Plain-data form for broadcasting (broadcasts use plain pickle)."""
        return {"frames": list(self.frames), "n_train": int(self.n_train),
                "held": [np.asarray(h) for h in self.held], "x": self.x, "token": self.token}

    @property
    def x_train(self):
        return self.x[: self.n_train]

    @property
    def x_test(self):
        return self.x[self.n_train:]


def build_design(x_df: DataFrame, y_df: DataFrame, p: RidgeParams, frame_col: str = "tr",
                 x_col: str = "x", frames: list | None = None) -> Design:
    """Align frames, split, draw hold-outs and collect the (size-checked) stimulus.

    Two jobs touch the inputs: the aligned frame list and the stimulus rows,
    both bounded by the number of frames (checked).  The split and the
    seeded hold-out draw are computed from that list (``design_indices``,
    identical to the Spark operators), so no stages are spent on metadata.
    """
    if frames is None:
        fr = x_df.select(frame_col).distinct().join(y_df.select(frame_col).distinct(), frame_col)
        frames = frame_list(fr, frame_col)
    n = len(frames)
    if n == 0:
        raise ValueError("stimulus and responses share no frame")
    n_train, held = design_indices(frames, p.test_size, p.chunklen, p.nboots, p.nchunks, p.seed, p.draw)
    x = collect_x(x_df, frames, frame_col, x_col, p.max_broadcast_bytes)
    return Design(frames=frames, n_train=n_train, held=[np.array(h, dtype=int) for h in held], x=x)


def collect_x(x_df: DataFrame, frames: list, frame_col: str = "tr", x_col: str = "x",
              max_bytes: int = MAX_BROADCAST_BYTES) -> np.ndarray:
    """Stimulus rows at ``frames`` as a dense matrix (rows follow ``frames``).

    The frame list is a tiny broadcast semi-join side; the byte size of the
    result is checked before anything is shipped.  Every frame must be
    present exactly once.
    """
    spark = x_df.sparkSession
    small = spark.createDataFrame([(int(t),) for t in frames], f"{frame_col} int")
    rows = x_df.join(F.broadcast(small), frame_col).select(frame_col, x_col)
    width = _check_rows(rows, frame_col, x_col, max_bytes, len(frames))
    pos = {t: i for i, t in enumerate(frames)}
    x = np.zeros((len(frames), width))
    for r in rows.collect():
        x[pos[r[0]]] = np.asarray(r[1], dtype=float)
    return x


def _check_rows(rows: DataFrame, frame_col: str, x_col: str, max_bytes: int, frames: int | None = None) -> int:
    """The width of a stimulus that is one row per frame, of equal lengths
    and within ``max_bytes``; nothing is collected before this holds."""
    n, distinct, lo, hi = rows.agg(F.count("*"), F.countDistinct(frame_col), F.min(F.size(x_col)),
                                   F.max(F.size(x_col))).first()
    if n != distinct:
        raise ValueError("duplicate stimulus rows for a frame")
    if n and lo != hi:
        raise ValueError("stimulus rows differ in length")
    if frames is not None and n != frames:
        raise ValueError(f"stimulus lacks {frames - n} of the design frames")
    width = hi or 0
    if n * width * 8 > max_bytes:
        raise ValueError(f"stimulus {n}x{width} exceeds the broadcast limit of {max_bytes} bytes")
    return width


def solver_of(token: str, build):
    """The solver of one job and stimulus, built once per worker process.
    Solvers of the last jobs stay; those of one job are never dropped
    while it runs, however many stimuli it has."""
    cache = worker_cache("ridge")
    job = token.split(":")[0]
    if job not in cache:
        for old in list(cache)[:-2]:
            del cache[old]
        cache[job] = {}
    if token not in cache[job]:
        cache[job][token] = build()
    return cache[job][token]


def _matrix(batch: pa.RecordBatch, col: str, width: int) -> np.ndarray:
    arr = batch.column(col)
    vals = arr.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(vals, dtype=float).reshape(len(arr), width)


def _list_array(mat: np.ndarray) -> pa.Array:
    m, k = mat.shape
    offsets = pa.array(np.arange(0, m * k + 1, k, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.ravel(), type=pa.float64()))


def _nullable(v: np.ndarray) -> pa.Array:
    return pa.array(v, type=pa.float64(), from_pandas=True)


# ---------------------------------------------------------------------------
# DataFrame-level operators
# ---------------------------------------------------------------------------

def pack_responses(y_df: DataFrame, keys, design: Design, frame_col="tr", value="value") -> DataFrame:
    """One row per series: ``yi`` (positions in the design frame order) and ``yv`` (values).

    Sparse packing: frames map to positions through a small broadcast table
    (one row per design frame), each series collects only the cells it has
    (bounded by the frame count), and the dense block matrix is scattered
    inside the Arrow task, where missing cells, NULL and NaN become 0.
    """
    spark = y_df.sparkSession
    keys = list(keys)
    pos = spark.createDataFrame([(int(t), i) for i, t in enumerate(design.frames)], f"{frame_col} int, _i int")
    j = y_df.select(*keys, frame_col, value).join(F.broadcast(pos), frame_col)
    return (j.groupBy(*keys)
             .agg(F.collect_list("_i").alias("yi"), F.collect_list(nan_to_zero(value)).alias("yv")))


def _dense(batch: pa.RecordBatch, n_frames: int) -> np.ndarray:
    """(frames x series) matrix of a packed batch; absent cells are 0."""
    idx = batch.column("yi")
    vals = batch.column("yv")
    lengths = np.diff(idx.offsets.to_numpy())
    cols = np.repeat(np.arange(batch.num_rows), lengths)
    out = np.zeros((n_frames, batch.num_rows))
    out[idx.flatten().to_numpy(zero_copy_only=False), cols] = vals.flatten().to_numpy(zero_copy_only=False)
    return out


class PackedReader:
    """Moments of packed series against the broadcast stimuli of a design."""

    columns = ["yi", "yv"]

    def __init__(self, bc, p: RidgeParams):
        self.bc, self.p = bc, p

    def open(self):
        v = self.bc.value
        self.n_train, self.held, self.xs = v["n_train"], v["held"], v["xs"]
        self.sets = {TRAIN: slice(0, self.n_train), TEST: slice(self.n_train, None), **dict(enumerate(self.held))}
        self.solvers = [solver_of(f"{v['token']}:{i}", lambda x=x: self._solver(x)) for i, x in enumerate(self.xs)]
        self.frames = len(self.xs[0])
        # series a block may hold: dense responses, their copies per row set, the moments of
        # every stimulus and set, the scores of every bootstrap and penalty
        numbers = 4 * self.frames + (len(self.sets) + 4) * sum(x.shape[1] for x in self.xs) + 4 * len(self.held) * len(self.p.alphas)
        self.block = max(1, SCRATCH_BYTES // (8 * numbers))
        return self

    def _solver(self, x):
        train = x[:self.n_train]
        rows = {b: np.delete(train, h, axis=0) for b, h in enumerate(self.held)}
        rows[TRAIN] = train
        return Solver({s: RowMoments.of(x[i]) for s, i in self.sets.items()}, len(self.held),
                      self.p.singcutoff, self.p.return_weights, rows)

    def moments(self, batch):
        """One SeriesMoments per stimulus."""
        y = _dense(batch, self.frames)
        total = {s: y[i].sum(0) for s, i in self.sets.items()}
        square = {s: np.square(y[i]).sum(0) for s, i in self.sets.items()}
        return [SeriesMoments({s: x[i].T @ y[i] for s, i in self.sets.items()}, total, square) for x in self.xs]


@dataclass
class Source:
    """One row per series, and how a task turns a block of rows into moments."""
    df: DataFrame
    keys: list
    reader: object
    runs: list = field(default_factory=lambda: [""])
    finish: object = None      # fitted table -> the same with weights of the features (dual plan)

    def weights(self, fitted: DataFrame) -> DataFrame:
        return self.finish(fitted) if self.finish and "weights" in fitted.columns else fitted

    def job(self, fields: list, per_block, extra: DataFrame | None = None, extra_cols=()) -> DataFrame:
        """``per_block(run name, solver, moments, batch)`` -> arrays of ``fields``."""
        keys, reader, runs = self.keys, self.reader, self.runs
        rows = self.df.select(*keys, *reader.columns)
        if extra is not None:
            rows = rows.join(extra.select(*keys, *extra_cols), keys)
        schema = T.StructType([self.df.schema[k] for k in keys] + fields)
        names = schema.fieldNames()

        def run(batches):
            reader.open()
            for batch in batches:
                for a in range(0, batch.num_rows, reader.block):
                    part = batch.slice(a, reader.block)
                    for name, solver, m in zip(runs, reader.solvers, reader.moments(part)):
                        yield pa.RecordBatch.from_arrays(
                            [part.column(k) for k in keys] + per_block(name, solver, m, part), names=names)

        return rows.mapInArrow(run, schema)


def packed_source(y_df: DataFrame, keys, design: Design, p: RidgeParams, frame_col="tr", value="value",
                  xs: list | None = None, runs: list | None = None) -> Source:
    keys = [keys] if isinstance(keys, str) else list(keys)
    bc = y_df.sparkSession.sparkContext.broadcast(
        {"n_train": design.n_train, "held": [np.asarray(h) for h in design.held] if p.nboots else [],
         "xs": xs or [design.x], "token": design.token})
    return Source(pack_responses(y_df, keys, design, frame_col, value), keys, PackedReader(bc, p), runs or [""])


def source(x_df: DataFrame, y_df: DataFrame, keys, p: RidgeParams, frame_col="tr", x_col="x", value="value",
           design: Design | None = None, plan: str = "auto") -> Source:
    """The moments of every series, by either physical plan.

    ``packed`` broadcasts the stimulus (size-checked) and packs series;
    ``additive`` never ships the stimulus but features x features numbers;
    ``dual`` ships frames x frames numbers.  ``auto`` takes the packed plan
    while the stimulus fits the limits, then the smaller of the other two.
    All give the same columns and, up to rounding, the same values for every
    option.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    frames = None
    if design is None and plan == "auto":
        plan, frames = choose_plan(x_df, y_df, p, frame_col, x_col)
    if design is None and plan == "additive":
        from voxlex.operators.ridge_stats import additive_source
        return additive_source(x_df, y_df, keys, p, frame_col, x_col, value)
    if design is None and plan == "dual":
        from voxlex.operators.ridge_dual import dual_source
        frames = frames or aligned_frames(x_df, y_df, frame_col, p.max_packed_frames)
        if not frames:
            raise ValueError("stimulus and responses share no frame")
        width = x_df.select(F.max(F.size(x_col))).first()[0] or 0
        return dual_source(x_df, y_df, keys, p, frames, width, frame_col, x_col, value)
    design = design or build_design(x_df, y_df, p, frame_col, x_col, frames)
    return packed_source(y_df, keys, design, p, frame_col, value)


def ridge_cv(src: Source, p: RidgeParams, emit_boots: bool = False) -> DataFrame:
    """Held-out score of every alpha for every series (mean over bootstraps).

    Output: keys, ``cv ARRAY<DOUBLE>`` (one score per alpha), and with
    ``emit_boots`` ``boot_scores ARRAY<DOUBLE>`` (bootstrap-major).
    """
    array = T.ArrayType(T.DoubleType())
    fields = [T.StructField("cv", array)] + [T.StructField("boot_scores", array)] * emit_boots
    alphas = list(p.alphas)

    def block(_, solver, m, part):
        sc = solver.held_out(m, alphas, p.normalpha, p.use_corr)
        out = [_list_array(sc.mean(0).T)]
        if emit_boots:
            out.append(_list_array(sc.transpose(2, 0, 1).reshape(sc.shape[2], -1)))
        return out

    return src.job(fields, block)


def select_alpha(series: DataFrame, cv: DataFrame | None, keys, p: RidgeParams, groups: DataFrame | None = None,
                 group_col: str = "grp") -> DataFrame:
    """Alpha index per series from the cross-validation table.

    * default: argmax of each series' mean held-out score;
    * ``groups``: argmax of the mean over the group's members; a series in
      no group gets alpha 0.0 (``alpha_idx`` NULL); a series listed in
      several groups takes the last (largest) group id;
    * ``single_alpha``: one argmax over all series.

    ``series`` has one row per series; ``cv`` (None without bootstraps) is
    read once.
    """
    from voxlex.operators.stats import best_alpha
    keys = list(keys)
    spark = series.sparkSession
    if p.single_alpha and p.nboots == 0:
        if len(p.alphas) != 1:
            raise ValueError("at least one bootstrap is needed to choose among several alphas")
        return series.select(*keys).withColumn("alpha_idx", F.lit(0)).withColumn("alpha", F.lit(float(p.alphas[0])))
    if not p.single_alpha and p.nboots == 0:
        raise ValueError("at least one bootstrap is needed to assign per-series alphas")
    long = cv.select(*keys, F.posexplode("cv").alias("alpha_idx", "mean_corr"))
    grid = F.broadcast(alpha_grid_df(spark, p.alphas))
    if p.single_alpha:
        per = long.groupBy("alpha_idx").agg(F.avg("mean_corr").alias("mean_corr"))
        best = best_alpha(per, None, "mean_corr", p.score_digits, "alpha_idx").withColumn("_g", F.lit(0))
        out = series.select(*keys).withColumn("_g", F.lit(0)).join(F.broadcast(best), "_g").drop("_g")
        return out.join(grid, "alpha_idx")
    if groups is not None:
        g = groups.groupBy(*keys).agg(F.max(group_col).alias(group_col))
        per = (long.join(g, keys).groupBy(group_col, "alpha_idx")
                   .agg(F.avg("mean_corr").alias("mean_corr")))
        best = best_alpha(per, group_col, "mean_corr", p.score_digits, "alpha_idx")
        # Grouped series take their group's alpha; series in no group get 0.0.
        # (Split instead of a NULL-keyed outer join, which would send every
        # ungrouped series to one reducer.)
        member = series.select(*keys).join(g, keys, "left")
        grouped = member.where(F.col(group_col).isNotNull()).join(best, group_col).drop(group_col)
        grouped = grouped.join(grid, "alpha_idx")
        alone = member.where(F.col(group_col).isNull()).select(
            *keys, F.lit(None).cast("int").alias("alpha_idx"), F.lit(0.0).alias("alpha"))
        return grouped.select(*keys, "alpha_idx", "alpha").unionByName(alone)
    best = best_alpha(long, keys, "mean_corr", p.score_digits, "alpha_idx")
    return best.join(grid, "alpha_idx")


def fit_score(src: Source, p: RidgeParams, alphas: DataFrame | None = None, run_col: str | None = None) -> DataFrame:
    """Final fit and test score with one alpha per series.

    ``alphas`` (keys, alpha) comes from ``select_alpha``; without it the
    selection by bootstrap happens inside the same task (per-series mode),
    so cross-validation, selection and refit are one pass over the data.
    Output: keys, alpha, corr[, weights], with ``run_col`` also the stimulus.
    """
    grid = np.asarray(p.alphas, dtype=float)
    fields = [T.StructField(run_col, T.StringType())] if run_col else []
    fields += [T.StructField("alpha", T.DoubleType()), T.StructField("corr", T.DoubleType())]
    if p.return_weights and not run_col:
        fields.append(T.StructField("weights", T.ArrayType(T.DoubleType())))

    def block(name, solver, m, part):
        if alphas is None:
            cv = solver.held_out(m, grid, p.normalpha, p.use_corr).mean(0)
            a = grid[pick_alpha(cv, p.score_digits)]
        else:
            a = part.column("alpha").to_numpy(zero_copy_only=False).astype(float)
        corr, w = solver.fit(m, a, p.normalpha, p.use_corr, p.return_weights)
        out = [pa.array([name] * len(a), pa.string())] if run_col else []
        out += [pa.array(a, pa.float64()), _nullable(corr)]
        return out + ([_list_array(w)] if p.return_weights and not run_col else [])

    # only a flag crosses into the task, not the DataFrame
    if alphas is None:
        return src.job(fields, block)
    frame, alphas = alphas, True
    return src.job(fields, block, frame, ["alpha"])


def aligned_frames(x_df: DataFrame, y_df: DataFrame, frame_col: str, limit: int) -> list:
    """Frames of both tables; ValueError beyond ``limit``."""
    fr = x_df.select(frame_col).distinct().join(y_df.select(frame_col).distinct(), frame_col)
    return frame_list(fr, frame_col, limit=min(limit, MAX_FRAMES))


def choose_plan(x_df: DataFrame, y_df: DataFrame, p: RidgeParams, frame_col: str = "tr",
                x_col: str = "x"):
    """(plan, frames or None): "packed" when the aligned stimulus fits the
    broadcast limit and the frame count fits a packed row; else "dual" when
    features outnumber frames and frames x frames numbers fit; else "additive".

    The frame list is collected only up to its checked bound; past it neither
    the packed nor the dual plan is used.
    """
    width = x_df.select(F.max(F.size(x_col))).first()[0] or 0
    most = p.max_broadcast_bytes // 8
    try:
        frames = aligned_frames(x_df, y_df, frame_col, min(p.max_packed_frames, max(1, most // max(width, 1), int(most ** 0.5))))
    except ValueError:
        return "additive", None
    if len(frames) * width <= most:
        return "packed", frames
    if width > len(frames) and len(frames) ** 2 <= most:
        return "dual", frames
    return "additive", None


def bootstrap_ridge(x_df: DataFrame, y_df: DataFrame, keys, p: RidgeParams | None = None,
                    groups: DataFrame | None = None, frame_col: str = "tr", x_col: str = "x",
                    value: str = "value", design: Design | None = None, plan: str = "auto") -> DataFrame:
    """Bootstrap-selected ridge for every series of ``y_df`` against ``x_df``.

    ``x_df``: (tr, x ARRAY<DOUBLE>) one row per frame.  ``y_df``: long
    (keys..., tr, value).  Returns keys, alpha, corr[, weights].

    ``plan``: see ``source``; every option works the same in either plan.
    """
    p = p or RidgeParams()
    src = source(x_df, y_df, keys, p, frame_col, x_col, value, design, plan)
    if groups is None and not p.single_alpha:
        if p.nboots == 0:
            raise ValueError("at least one bootstrap is needed to assign per-series alphas")
        return src.weights(fit_score(src, p))
    src.df = cut_lineage(src.df)        # one row per series, read by the scores, the choice and the fit
    cv = ridge_cv(src, p) if p.nboots else None
    return src.weights(fit_score(src, p, select_alpha(src.df, cv, src.keys, p, groups)))


def bootstrap_tables(x_df: DataFrame, y_df: DataFrame, keys, p: RidgeParams | None = None, frame_col: str = "tr",
                     x_col: str = "x", value: str = "value") -> dict:
    """Fit, bootstrap scores and held-out rows of the same draw:
    ``fit`` (keys, alpha, corr[, weights]), ``boot_scores`` (keys, boot,
    alpha_idx, corr) and ``held`` (boot, frame)."""
    p = p or RidgeParams()
    design = build_design(x_df, y_df, p, frame_col, x_col)
    rows = [(b, int(design.frames[i])) for b, h in enumerate(design.held) for i in h]
    return {"fit": bootstrap_ridge(x_df, y_df, keys, p, None, frame_col, x_col, value, design),
            "boot_scores": boot_scores_long(x_df, y_df, keys, p, frame_col, x_col, value, design),
            "held": x_df.sparkSession.createDataFrame(rows, f"boot int, {frame_col} int")}


def fit_runs(x_dfs: dict, y_df: DataFrame, keys, p: RidgeParams | None = None, frame_col: str = "tr",
             x_col: str = "x", value: str = "value", run_col: str = "run") -> DataFrame:
    """Per-series bootstrap ridge of one response table against several stimuli, in one pass.

    The stimuli must cover the same frames (one transcript embedded with
    different window sizes, PCA sizes, poolings or tactics), so the split,
    the hold-out draw and the packed responses are built once; each block
    of series is fitted against every stimulus inside the same task.  Stimuli
    that together exceed the broadcast limit are fitted one after the other,
    each by its own plan.  Output: (run STRING, keys..., alpha, corr).
    """
    p = p or RidgeParams()
    if p.single_alpha or p.nboots == 0:
        raise ValueError("fit_runs selects one alpha per series; use bootstrap_ridge otherwise")
    keys = [keys] if isinstance(keys, str) else list(keys)
    xs_in = {str(r): x for r, x in x_dfs.items()}
    first = next(iter(xs_in.values()))
    plan, frames = choose_plan(first, y_df, p, frame_col, x_col)
    if plan == "packed":
        widths = [x.select(F.max(F.size(x_col))).first()[0] or 0 for x in xs_in.values()]
        if 8 * len(frames) * sum(widths) > p.max_broadcast_bytes:
            plan = "auto"
    if plan != "packed":
        out = None
        for name, x in xs_in.items():
            one = fit_score(source(x, y_df, keys, p, frame_col, x_col, value, None, plan), p).select(
                F.lit(name).alias(run_col), *keys, "alpha", "corr")
            out = one if out is None else out.unionByName(one)
        return out
    base = build_design(first, y_df, p, frame_col, x_col, frames)
    mats = [base.x] + [collect_x(x, base.frames, frame_col, x_col, p.max_broadcast_bytes)
                       for x in list(xs_in.values())[1:]]
    src = packed_source(y_df, keys, base, p, frame_col, value, mats, list(xs_in))
    return fit_score(src, p, run_col=run_col).select(run_col, *keys, "alpha", "corr")


def boot_scores_long(x_df, y_df, keys, p: RidgeParams | None = None, frame_col="tr", x_col="x", value="value",
                     design: Design | None = None, plan: str = "auto") -> DataFrame:
    """(keys, boot, alpha_idx, corr): every held-out score of the bootstrap."""
    p = p or RidgeParams()
    src = source(x_df, y_df, keys, p, frame_col, x_col, value, design, plan)
    a = len(p.alphas)
    e = ridge_cv(src, p, emit_boots=True).select(*src.keys, F.posexplode("boot_scores").alias("_k", "corr"))
    return e.select(*src.keys, (F.col("_k") / a).cast("int").alias("boot"),
                    (F.col("_k") % a).cast("int").alias("alpha_idx"), "corr")


def ridge_grid(x_df, y_df, keys, p: RidgeParams | None = None, frame_col="tr", x_col="x", value="value",
               plan: str = "auto") -> DataFrame:
    """Score every alpha x series on the test part without forming weights,
    trained on the whole training part.  Output (keys, alpha_idx, corr)."""
    p = p or RidgeParams()
    p = RidgeParams(**{**p.__dict__, "nboots": 0})
    src = source(x_df, y_df, keys, p, frame_col, x_col, value, None, plan)
    alphas = list(p.alphas)

    def block(_, solver, m, part):
        return [_list_array(solver.on_test(m, alphas, p.normalpha, p.use_corr).T)]

    grid = src.job([T.StructField("g", T.ArrayType(T.DoubleType()))], block)
    return grid.select(*src.keys, F.posexplode("g").alias("alpha_idx", "corr"))


def ridge_weights(x_df, y_df, keys, alpha, frame_col="tr", x_col="x", value="value", normalpha: bool = False,
                  plan: str = "auto") -> DataFrame:
    """Weights on all rows given, without split or bootstrap: (keys, alpha, weights).

    ``alpha``: one number, or a DataFrame (keys, alpha) with one per series.
    """
    p = RidgeParams(nboots=0, test_size=0.0, normalpha=normalpha)
    src = source(x_df, y_df, keys, p, frame_col, x_col, value, None, plan)
    per = alpha if isinstance(alpha, DataFrame) else src.df.select(*src.keys).withColumn("alpha", F.lit(float(alpha)))
    return src.weights(fit_score(src, p, per)).select(*src.keys, "alpha", "weights")


def factorize(x_df: DataFrame, cutoff: float = 1e-10, frame_col: str = "tr", x_col: str = "x",
              max_bytes: int = MAX_BROADCAST_BYTES):
    """Thin SVD of the stimulus: (``factors`` (k, sigma, v), ``left`` (frame, u)).

    The rows are folded by a tree of block QRs (``factor``) into one triangular
    factor, which one task decomposes; singular values down to 1e-12 of the
    largest are resolved, those at most ``cutoff`` are dropped.  The right
    vectors (features x features at most, size-checked) are then sent to a
    distributed projection that gives the left ones.
    """
    from voxlex.operators.factor import thin_svd, triangles
    width = x_df.select(F.max(F.size(x_col))).first()[0] or 0
    if width * width * 8 > max_bytes:
        raise ValueError(f"right vectors of width {width} exceed the broadcast limit of {max_bytes} bytes")
    r = triangles(x_df.select(F.lit(0).alias("s"), F.col(x_col).alias("x")), width)
    factors = cut_lineage(thin_svd(r, width, cutoff).select("k", "sigma", "v"))
    got = factors.orderBy("k").collect()
    to_u = np.array([np.asarray(f["v"]) / f["sigma"] for f in got]).reshape(len(got), width).T

    def project(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _list_array(_matrix(b, x_col, width) @ to_u)],
                                             names=[frame_col, "u"])

    kind = x_df.schema[frame_col].dataType.simpleString()
    return factors, x_df.select(frame_col, x_col).mapInArrow(project, f"{frame_col} {kind}, u array<double>")


def predict(x_df: DataFrame, weights: DataFrame, keys, frame_col: str = "tr", x_col: str = "x",
            w_col: str = "weights", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Predictions ``x . w`` for every frame of ``x_df`` and every weight row.

    The stimulus is broadcast (size-checked); work is partitioned by series.
    Output long (keys, tr, pred).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = x_df.sparkSession
    rows = x_df.select(frame_col, x_col)
    _check_rows(rows, frame_col, x_col, max_bytes)
    got = sorted(rows.collect(), key=lambda r: r[0])
    frames = [r[0] for r in got]
    x = np.array([r[1] for r in got], dtype=float).reshape(len(got), -1)
    bc = spark.sparkContext.broadcast((np.asarray(frames, dtype=np.int32), x))
    schema = T.StructType([weights.schema[k] for k in keys] +
                          [T.StructField(frame_col, T.IntegerType()), T.StructField("pred", T.DoubleType())])

    def run(batches):
        fr, xm = bc.value
        step = max(1, (SCRATCH_BYTES // 32) // max(1, len(fr)))    # result rows a block
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                m = part.num_rows
                pred = xm @ _matrix(part, w_col, xm.shape[1]).T    # frames x series
                idx = np.repeat(np.arange(m), len(fr))
                cols = [part.column(k).take(pa.array(idx)) for k in keys]
                cols += [pa.array(np.tile(fr, m)), pa.array(pred.T.ravel())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return weights.select(*keys, w_col).mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# Cross-product statistics and diagonal scaling (distributed aggregates)
# ---------------------------------------------------------------------------

def gram(x_df: DataFrame, x_col: str = "x", by=None, frame_col: str = "tr") -> DataFrame:
    """``X^T X`` as a long table (i, j, value), one blocked product per block
    of rows, summed by Spark; ``by``: one matrix per value of that column."""
    from voxlex.operators.ridge_stats import cross_products
    width = x_df.select(F.max(F.size(x_col))).first()[0] or 0
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    if len(keys) > 1:
        raise ValueError("one grouping column at most")
    rows = x_df.withColumn("s", F.col(keys[0]) if keys else F.lit(TRAIN))
    s = cross_products(rows, None, frame_col, x_col, width)
    e = s.select(*[F.col("s").alias(k) for k in keys], F.posexplode("g").alias("_k", "value"))
    return e.select(*keys, (F.col("_k") / width).cast("int").alias("i"), (F.col("_k") % width).cast("int").alias("j"),
                    "value")


def xty(x_df: DataFrame, y_df: DataFrame, keys, frame_col: str = "tr", x_col: str = "x",
        value: str = "value") -> DataFrame:
    """``X^T y`` per series as (keys, j, value), by blocked products."""
    from voxlex.operators.ridge_stats import series_stats
    keys = [keys] if isinstance(keys, str) else list(keys)
    sets = x_df.select(frame_col, F.lit(TRAIN).alias("s"))
    stats = series_stats(x_df, y_df, sets, keys, frame_col, x_col, value)
    return stats.select(*keys, F.posexplode(F.col("stats")[0]["c"]).alias("j", value))


def feature_spectrum(x_df: DataFrame, x_col: str = "x", frame_col: str = "tr") -> DataFrame:
    """Singular values of X (descending), from the triangular factor of its
    rows, which one task decomposes; dropped directions count as 0."""
    from voxlex.operators.factor import thin_svd, triangles
    width = x_df.select(F.max(F.size(x_col))).first()[0] or 0
    got = thin_svd(triangles(x_df.select(F.lit(0).alias("s"), F.col(x_col).alias("x")), width), width)
    every = x_df.sparkSession.range(width).select(F.col("id").cast("int").alias("k"))
    return every.join(got.select("k", "sigma"), "k", "left").select("k", F.coalesce("sigma", F.lit(0.0)).alias("sigma"))


def scale_rows(df: DataFrame, d: DataFrame, key: str = "tr", x_col: str = "x", d_col: str = "d") -> DataFrame:
    """Row i times d_i (left multiplication by a diagonal): a join on the row key."""
    return df.join(d.select(key, d_col), key).withColumn(
        x_col, F.transform(x_col, lambda v: v * F.col(d_col))).drop(d_col)


def scale_cols(df: DataFrame, d, x_col: str = "x") -> DataFrame:
    """Column j times d_j (right multiplication by a diagonal): element-wise product."""
    dv = F.array(*[F.lit(float(v)) for v in d]) if isinstance(d, (list, tuple, np.ndarray)) else d
    return df.withColumn(x_col, F.zip_with(x_col, dv, lambda a, b: a * b))
