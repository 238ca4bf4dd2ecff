"""Response-series operators (survey B9-B15, C2-C5, D1, E5, E6, S1-S3).

Responses are long tables keyed by ``(subject?, tr, voxel)``; a dense
subject x frame x vertex cube is never materialised.  Per-series arrays
(``pack_series``) exist only as the input of the ridge block jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlex.functions.scalar import nan_to_null, masked_value
from voxlex.operators.frames import renumber

# Frame lists are collected only after this bound is checked; the number of
# frames is set by the recording length, not by the data volume.
MAX_FRAMES = 1_000_000


def frame_list(df: DataFrame, frame_col: str = "tr", limit: int = MAX_FRAMES) -> list:
    """Sorted distinct frames as a Python list, size-checked before collecting."""
    d = df.select(frame_col).distinct()
    rows = d.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct frames; refusing to collect")
    return sorted(r[0] for r in rows)


def frame_positions(spark, frames, frame_col: str = "tr") -> DataFrame:
    """(tr, _i): position of each frame in a (checked, bounded) frame list; broadcast-sized."""
    return F.broadcast(spark.createDataFrame([(int(t), i) for i, t in enumerate(frames)], f"{frame_col} int, _i int"))


def mean_over_subjects(resp: DataFrame, keys=("tr", "voxel"), value: str = "value") -> DataFrame:
    """NaN-skipping mean over subjects per (frame, series).

    NaN is mapped to NULL before ``avg`` (a plain avg would return NaN); a
    cell that is NaN for every subject becomes NULL.  Partial aggregation
    happens map-side, so a hot key never ships its raw rows.
    """
    return resp.groupBy(*keys).agg(F.avg(nan_to_null(value)).alias(value))


def densify(df: DataFrame, keys, frame_col: str = "tr", value: str = "value",
            frames=None, fill: float = 0.0) -> DataFrame:
    """Give every key every frame; missing or NULL cells take ``fill``.

    One shuffle by key: each series folds its cells into a position->value
    map (at most one entry per frame) and is expanded over the position
    range; positions map back to frames through a small broadcast table.
    """
    keys = list(keys)
    spark = df.sparkSession
    frames = frame_list(df, frame_col) if frames is None else list(frames)
    pos = frame_positions(spark, frames, frame_col)
    g = (df.join(pos, frame_col).groupBy(*keys)
           .agg(F.map_from_entries(F.collect_list(F.struct("_i", value))).alias("_m")))
    e = g.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(len(frames) - 1))).alias("_i"))
    e = e.join(pos, "_i")
    return e.select(frame_col, *keys, F.coalesce(F.try_element_at("_m", F.col("_i")), F.lit(fill)).alias(value))


def live_series(df: DataFrame, key="voxel", value: str = "value") -> DataFrame:
    """Keep only series with at least one non-zero value (NULL is not live).

    One window pass partitioned by series: a series holds one row per
    frame, so each window group is bounded by the recording length, and the
    input is consumed once (a filter-by-aggregate self-join would plan the
    whole upstream twice).
    """
    keys = [key] if isinstance(key, str) else list(key)
    flag = F.max(F.when(F.col(value) != 0, F.lit(1)).otherwise(F.lit(0))).over(Window.partitionBy(*keys))
    return df.withColumn("_live", flag).where(F.col("_live") == 1).drop("_live")


def dense_index(df: DataFrame, key: str = "voxel", out: str = "dense_idx") -> DataFrame:
    """Dense 0-based index over the distinct series, in key order."""
    return renumber(df.select(key).distinct(), [], key, out)


def split_hemi(df: DataFrame, n: int, col: str = "voxel") -> DataFrame:
    """Grid index -> (hemi, vertex): the first ``n`` are left, the rest right."""
    v = F.col(col)
    return (df.withColumn("hemi", F.when(v < n, F.lit("L")).otherwise(F.lit("R")))
              .withColumn("vertex", F.when(v < n, v).otherwise(v - F.lit(n)).cast("int")))


def stack_hemis(left: DataFrame, right: DataFrame, n: int, col: str = "voxel") -> DataFrame:
    """Stack hemispheres on one grid: right-hemisphere vertices follow the left."""
    return left.unionByName(right.withColumn(col, (F.col(col) + F.lit(n)).cast("int")))


def pack_series(df: DataFrame, keys, frame_col: str = "tr", value: str = "value",
                frames=None, fill: float = 0.0, out: str = "y") -> DataFrame:
    """Long (keys, tr, value) -> (keys, y ARRAY<DOUBLE>) ordered by frame.

    With ``frames`` the array follows that list and holes take ``fill``
    (positions come from a small broadcast table); without, it holds the
    series' own frames in ascending order.  One shuffle by key; each group
    holds at most one value per frame.
    """
    keys = list(keys)
    if frames is None:
        g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(frame_col, value))).alias("_s"))
        return g.select(*keys, F.transform("_s", lambda s: s[value]).alias(out))
    pos = frame_positions(df.sparkSession, frames, frame_col)
    # sorted cells and the gaps between them: linear in the number of frames
    g = (df.join(pos, frame_col).groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("_v")))).alias("_c")))
    n, f = len(frames), f"cast({fill!r} AS double)"
    before = f"IF(k = 0, c._i, c._i - _c[greatest(k, 1) - 1]._i - 1)"
    cells = f"flatten(transform(_c, (c, k) -> concat(array_repeat({f}, {before}), array(coalesce(cast(c._v AS double), {f})))))"
    tail = f"array_repeat({f}, {n - 1} - _c[size(_c) - 1]._i)"
    return g.select(*keys, F.expr(f"concat({cells}, {tail})").alias(out))


def unpack_series(packed: DataFrame, keys, frames, col: str = "y",
                  frame_col: str = "tr", value: str = "value") -> DataFrame:
    """Inverse of ``pack_series`` for a known frame list."""
    keys = list(keys)
    pos = frame_positions(packed.sparkSession, frames, frame_col)
    e = packed.select(*keys, F.posexplode(col).alias("_i", value))
    return e.join(pos, "_i").select(*keys, frame_col, value)


def zscore_within(df: DataFrame, by, value: str = "value", out: str | None = None) -> DataFrame:
    """z-score ``value`` inside each ``by`` group with the population std.

    ``by='tr'`` standardises across series within a frame (what the response
    preparation does); ``by='voxel'`` standardises each series over time.
    Mean and std come from a partial aggregate (one small row per group)
    that is joined back, so no group is gathered in a task.  A zero std gives
    NULL instead of raising; rows without a key stay, with NULL.
    """
    keys = [by] if isinstance(by, str) else list(by)
    out = out or value
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return (df.join(stats, keys, "left")
            .withColumn(out, F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd"))


def align(x: DataFrame, y: DataFrame, frame_col: str = "tr") -> DataFrame:
    """Stimulus rows next to response rows, joined on the frame (not position)."""
    return y.join(x, frame_col)


def score_diff(a: DataFrame, b: DataFrame, key="voxel", col: str = "corr", out: str = "diff") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return (a.select(*keys, F.col(col).alias("_a"))
             .join(b.select(*keys, F.col(col).alias("_b")), keys)
             .select(*keys, "_a", "_b", (F.col("_a") - F.col("_b")).alias(out)))


def masked_diff(a: DataFrame, b: DataFrame, threshold: float = 0.2, key="voxel",
                col: str = "corr", out: str = "diff") -> DataFrame:
    """``(a - b) * (|b| > threshold)``: differences only where the baseline is strong."""
    d = score_diff(a, b, key, col, "_d")
    return d.select(*([key] if isinstance(key, str) else key),
                    masked_value(F.col("_d"), F.col("_b"), threshold).alias(out))


def scatter_to_grid(scores: DataFrame, n: int, key: str = "voxel", col: str = "corr", runs=None,
                    run_col: str = "run") -> DataFrame:
    """Scores on the full grid ``0..n-1``; series without a score get 0.0.  With
    ``runs`` (the values of ``run_col``), one grid per run."""
    grid = scores.sparkSession.range(n).select(F.col("id").cast("int").alias(key))
    keys = [key]
    if runs is not None:
        keys = [run_col, key]
        grid = grid.select(F.explode(F.array(*[F.lit(str(r)) for r in runs])).alias(run_col), key)
    return (grid.join(scores.select(*keys, col), keys, "left")
                .select(*keys, F.coalesce(F.col(col), F.lit(0.0)).alias(col)))


def apply_mask(stat: DataFrame, mask: DataFrame, key: str = "voxel", col: str = "corr",
               mask_col: str = "mask") -> DataFrame:
    """Scores times mask on the whole grid; a place the mask lacks is outside (0)."""
    others = [c for c in stat.columns if c != col]
    return (stat.join(mask.select(key, mask_col), key, "left")
                .select(*others, (F.col(col) * F.coalesce(F.col(mask_col), F.lit(0.0))).alias(col)))


def threshold_map(stat: DataFrame, threshold: float, vmax: float | None = None,
                  col: str = "corr") -> DataFrame:
    """Entries with ``|v| >= threshold``, clipped to ``[-vmax, vmax]`` for display."""
    c = F.col(col)
    kept = stat.where(F.abs(c) >= F.lit(threshold))
    if vmax is not None:
        kept = kept.withColumn(col, F.greatest(F.lit(-vmax), F.least(F.lit(vmax), c)))
    return kept


def union_runs(runs: dict, run_col: str = "run") -> DataFrame:
    """Stack score tables of several runs with a ``run`` label column."""
    out = None
    for name, df in runs.items():
        d = df.withColumn(run_col, F.lit(str(name)))
        out = d if out is None else out.unionByName(d)
    return out


def pivot_runs(df: DataFrame, runs, key: str = "voxel", run_col: str = "run", col: str = "corr") -> DataFrame:
    """Runs side by side, one column per run (values listed: no discovery pass)."""
    return df.groupBy(key).pivot(run_col, [str(r) for r in runs]).agg(F.first(col))
