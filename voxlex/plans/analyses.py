"""End-to-end analyses built from the operators (survey I1-I9).

Loops of the original over subjects or window sizes become keys or unions:
subjects are a key column of one ridge job; different stimuli (window
sizes, tactics) share one packed response table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlex.operators import frames as fr
from voxlex.operators import series as se
from voxlex.operators import stats as st
from voxlex.operators.context import with_continuation, with_summary
from voxlex.operators.crossed import sign_flips
from voxlex.operators.embed import HashEmbedder, embed, frame_contexts, frame_embedding, frame_means
from voxlex.operators.pca import pca_fit, pca_project
from voxlex.operators.ridge import RidgeParams, bootstrap_ridge, build_design, fit_runs
from voxlex.session import cut_lineage


def select_subjects(resp: DataFrame, participants: DataFrame, task: str, exclude_ids=(),
                    sep: str = "-") -> DataFrame:
    """Response rows of the participants in ``task`` (substring) minus the excluded ids."""
    p = fr.with_subject(fr.filter_task(participants, task), sep)
    p = fr.exclude(p, exclude_ids, "subject")
    subs = p.select(F.col("subject").cast("int").alias("subject")).where(F.col("subject").isNotNull())
    return resp.join(subs, "subject", "left_semi")


def prepare_responses(resp: DataFrame, participants: DataFrame, frames_df: DataFrame, task: str,
                      exclude_ids=(), sep: str = "-", frame_col: str = "tr") -> DataFrame:
    """Responses ready for fitting: (tr, voxel, value).

    participants in task (substring) -> subject codes -> exclusions ->
    responses of those subjects at the transcript's frames -> NaN-skipping
    mean over subjects -> live series only -> z-score across series within
    each frame (population std).
    """
    r = select_subjects(resp, participants, task, exclude_ids, sep)
    r = fr.gather_frames(r, frames_df, frame_col)
    m = se.mean_over_subjects(r, (frame_col, "voxel"))
    m = se.live_series(m, "voxel")
    return se.zscore_within(m, frame_col, "value").select(frame_col, "voxel", "value")


@dataclass
class Cohort:
    """Raw responses plus the participant selection that prepares them.

    Passing a cohort instead of prepared responses lets an analysis prepare
    the responses at the frames of its (small, already computed) stimulus,
    so the token table is not expanded a second time just to list frames.
    """
    resp: DataFrame
    participants: DataFrame
    task: str
    exclude_ids: tuple = ()
    sep: str = "-"

    def prepare(self, frames_df: DataFrame, frame_col: str = "tr") -> DataFrame:
        return prepare_responses(self.resp, self.participants, frames_df.select(frame_col), self.task,
                                 self.exclude_ids, self.sep, frame_col)


def _responses(y, x: DataFrame, frame_col: str = "tr") -> DataFrame:
    return y.prepare(x, frame_col) if isinstance(y, Cohort) else y


def stimulus(tok: DataFrame, ws: int, model, pool: str = "mean", frame_col: str = "tr",
             text: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Per-frame stimulus rows (tr, x): context -> embedding -> frame mean.

    Contexts are built, embedded and averaged inside one pass over the words
    (``frame_contexts``); precomputed texts are embedded in batches.  Only a
    model that declares itself additive (``fused``, as ``HashEmbedder`` does)
    takes the fused form, window sums of word vectors.
    """
    if text is None and getattr(model, "fused", False):
        return frame_means(tok, [ws], model, pool, frame_col).select(frame_col, F.col(f"x_{ws}").alias("x"))
    if text is None:
        return frame_contexts(tok, [ws], model, pool, frame_col).select(frame_col, F.col(f"x_{ws}").alias("x"))
    emb = embed(text, text_col, model, pool)
    return frame_embedding(emb.select(frame_col, "x"), frame_col, "x", dim=getattr(model, "dim", None))


def stimuli(tok: DataFrame, sizes, model, pool: str = "mean", frame_col: str = "tr") -> dict:
    """Per-frame stimuli for several window sizes: {ws: DataFrame(tr, x)}.

    Contexts of all sizes are built, embedded and averaged per frame in one
    pass over the words (``frame_contexts``); the small per-frame table is
    written to the checkpoint folder and sliced.  ``fused`` models skip the
    context texts (see ``stimulus``).
    """
    sizes = [int(s) for s in sizes]
    if getattr(model, "fused", False):
        frames_x = frame_means(tok, sizes, model, pool, frame_col)
    else:
        frames_x = frame_contexts(tok, sizes, model, pool, frame_col)
    frames_x = cut_lineage(frames_x)       # one row per frame
    return {ws: frames_x.select(frame_col, F.col(f"x_{ws}").alias("x")) for ws in sizes}


def encode(tok: DataFrame, y: DataFrame, ws: int = 16, model=None, pool: str = "mean",
           params: RidgeParams | None = None, keys=("voxel",), text: DataFrame | None = None) -> DataFrame:
    """Baseline encoding model: (voxel, alpha, corr[, weights])."""
    model = model or HashEmbedder(8)
    x = cut_lineage(stimulus(tok, ws, model, pool, text=text))
    return bootstrap_ridge(x, _responses(y, x), list(keys), params or RidgeParams())


def compare_windows(tok: DataFrame, y: DataFrame, sizes=(0, 4, 8, 16, 32, 64, 128), model=None,
                    pool: str = "mean", params: RidgeParams | None = None) -> DataFrame:
    """Scores per window size: (ws, voxel, alpha, corr).

    All window sizes are embedded in one pass and fitted against the packed
    responses in one block job (shared split and hold-out draw).
    """
    model = model or HashEmbedder(8)
    p = params or RidgeParams(return_weights=False)
    xs = stimuli(tok, sizes, model, pool)
    y = _responses(y, next(iter(xs.values())))
    r = fit_runs({str(ws): x for ws, x in xs.items()}, y, ["voxel"], p, run_col="ws")
    return r.select(F.col("ws").cast("int").alias("ws"), "voxel", "alpha", "corr")


def compare_tactic(tok: DataFrame, y: DataFrame, tactic_text, ws: int = 16, model=None,
                   pool: str = "mean", baseline_pool: str = "mean", params: RidgeParams | None = None,
                   mask_threshold: float | None = None) -> DataFrame:
    """Tactic scores vs the baseline: (voxel, corr, base_corr, diff).

    Both stimuli are fitted in one block job with a shared hold-out draw (the
    original draws different random hold-outs for the two models).  ``tactic_text``: texts, or a function
    (tokens, ws, frames) such as ``continuation_text``: one pass over the words then embeds its
    texts and the baseline's contexts where they are made.
    ``mask_threshold`` keeps the difference only where the baseline score is
    stronger than the threshold in absolute value.
    """
    model = model or HashEmbedder(8)
    p = params or RidgeParams()
    if isinstance(tactic_text, DataFrame):
        tac = cut_lineage(stimulus(tok, ws, model, pool, text=tactic_text))
        base = cut_lineage(stimulus(tok, ws, model, baseline_pool))
    else:
        both = cut_lineage(tactic_text(tok.select("seq", "pos", "word", "tr"), ws, frames=("tr", model, pool, baseline_pool, ws)))
        tac, base = (both.where(F.col("_of") == k).select("tr", F.col("x_0").alias("x")) for k in (0, 1))
    r = fit_runs({"tactic": tac, "base": base}, _responses(y, base), ["voxel"], p)
    # both runs of a series side by side by one aggregate: the fit is planned once
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("corr")))
    d = r.groupBy("voxel").agg(of("tactic").alias("corr"), of("base").alias("base_corr"))
    d = d.withColumn("diff", F.col("corr") - F.col("base_corr"))
    if mask_threshold is not None:
        d = d.withColumn("diff", F.when(F.abs("base_corr") > F.lit(mask_threshold), F.col("diff"))
                         .otherwise(F.lit(0.0)))
    return d


def continuation_text(tok, ws=16, generator=None, every=10, frames=None):
    from voxlex.operators.context import identity_generator
    return with_continuation(tok, ws, generator or identity_generator, every, frames=frames)


def summary_text(tok, ws=16, summarizer=None, start=20, every=30, hold=False, frames=None):
    from voxlex.operators.context import digest_text
    return with_summary(tok, ws, summarizer or digest_text, start, every, hold, frames=frames)


def cumulative_text(tok, ws=16, summarizer=None, start=20, every=30):
    from voxlex.operators.context import digest_text, with_cumulative_summary
    return with_cumulative_summary(tok, ws, summarizer or digest_text, start, every)


def compare_significance(y: DataFrame, x_a: DataFrame, x_b: DataFrame, by, chunk: str, actual: str = "value", pred: str = "x",
                         nperm: int = 999, seed: int = 42, family=None) -> DataFrame:
    """(by, diff, hits, p, q): do two models' predictions score differently?

    ``y`` (keys, chunk, frame, actual); ``x_a`` and ``x_b`` hold the predictions
    and join ``y`` on the columns they share with it.  Block sign flips over the chunks,
    false discovery rate over all groups of a ``family``.  Predictions of one
    shape are tested by blocks of series (``crossed.sign_flips``).
    """
    tests = sign_flips(y, x_a, x_b, by, chunk, actual, pred, nperm, seed)
    if tests is not None:
        return st.false_discovery(cut_lineage(tests), family)        # read for the counts and for the result
    parts = [st.score_parts(y.join(x, [c for c in x.columns if c != pred and c in y.columns]), by, chunk, actual, pred)
             for x in (x_a, x_b)]
    return st.false_discovery(st.sign_flip_test(*parts, by, chunk, nperm=nperm, seed=seed), family)


def pca_sweep(x: DataFrame, y: DataFrame, sizes=(16, 32, 64, 128, 256, 512, 768),
              params: RidgeParams | None = None, t: float = 0.3, fit_on: str = "all") -> DataFrame:
    """Score summary per PCA size: describe() columns plus the count above ``t``.

    One PCA fit at the largest size; smaller sizes take prefixes of the
    projection (components are nested).  ``fit_on='train'`` fits on the
    training frames only (the original fits on all frames).
    """
    p = params or RidgeParams()
    width = x.select(F.max(F.size("x"))).first()[0]
    if max(sizes) > width:
        raise ValueError(f"{max(sizes)} components asked of a stimulus of width {width}")
    fit_rows = x
    if fit_on == "train":
        d = build_design(x, y, p)
        train = x.sparkSession.createDataFrame([(int(t),) for t in d.frames[: d.n_train]], "tr int")
        fit_rows = x.join(F.broadcast(train), "tr", "left_semi")
    model = pca_fit(fit_rows, max(sizes))
    proj = cut_lineage(pca_project(x, model))
    runs = {str(k): proj.select("tr", F.slice("x", 1, k).alias("x")) for k in sizes}
    # Scores feed three aggregates (moments, sorted quantiles, count above t): fit once.
    out = fit_runs(runs, y, ["voxel"], p, run_col="n_components").select(
        F.col("n_components").cast("int").alias("n_components"), "corr")
    out = cut_lineage(out)
    desc = st.describe_scores(out, "n_components", "corr")
    above = st.above_threshold(out, "n_components", "corr", t).select("n_components", "n_above")
    return desc.join(above, "n_components")


def intersubject(x: DataFrame, resp: DataFrame, avg: DataFrame, params: RidgeParams | None = None,
                 include_avg: bool = True, frame_col: str = "tr") -> DataFrame:
    """One fit per subject plus the subject average, as one ridge job.

    ``resp``: (subject, tr, voxel, value); ``avg``: prepared average (tr,
    voxel, value).  Each subject uses the *average's* live series (as the
    original does) and is z-scored across series per frame.  ``subject`` is
    a key of the block job, not a driver loop.  Output (subject, voxel,
    alpha, corr).
    """
    p = params or RidgeParams(return_weights=False)
    avg = cut_lineage(avg)  # read for the live list, the frame list and the union
    live = avg.select("voxel").distinct()
    frames_df = avg.select(frame_col).distinct()
    r = resp.join(live, "voxel", "left_semi").join(frames_df, frame_col, "left_semi")
    r = r.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    z = se.zscore_within(r, ["subject", frame_col], "value").select(
        F.col("subject").cast("string").alias("subject"), frame_col, "voxel", "value")
    if include_avg:
        z = z.unionByName(avg.select(F.lit("Avg").alias("subject"), frame_col, "voxel", "value"))
    return bootstrap_ridge(x, z, ["subject", "voxel"], p).select("subject", "voxel", "alpha", "corr")


def stat_map(scores: DataFrame, n: int, mask: DataFrame, threshold: float, vmax: float | None = None,
             hemi_size: int | None = None, runs=None) -> DataFrame:
    """Display table of a score map: grid -> mask -> threshold -> hemisphere split;
    with ``runs``, one map per run."""
    g = se.scatter_to_grid(scores, n, runs=runs)
    g = se.apply_mask(g, mask)
    g = se.threshold_map(g, threshold, vmax)
    return se.split_hemi(g, hemi_size or n // 2)


def compare_pooling(tok: DataFrame, y: DataFrame, ws: int = 16, model=None,
                    params: RidgeParams | None = None) -> DataFrame:
    """describe() of scores for mean vs last-token pooling (one block job)."""
    model = model or HashEmbedder(8)
    p = params or RidgeParams()
    if getattr(model, "fused", False):        # the last word's vector is the window of that word alone
        xs = stimuli(tok, (ws, 0), model)
        runs = {"mean": xs[int(ws)], "last": xs[0]}
    else:
        runs = {pool: cut_lineage(stimulus(tok, ws, model, pool)) for pool in ("mean", "last")}
    out = cut_lineage(fit_runs(runs, _responses(y, runs["mean"]), ["voxel"], p, run_col="pool").select("pool", "corr"))
    return st.describe_scores(out, "pool", "corr")
