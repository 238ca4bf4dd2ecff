"""Ridge block jobs against an independent numpy brute force (normal equations)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from voxlex.operators import ridge as rg
from voxlex.operators import ridge_moments as rm
from voxlex.operators.embed import HashEmbedder
from voxlex.plans import analyses as an
from voxlex.sources import fixtures as fx


def _pearson(a, b):
    a = a - a.mean()
    b = b - b.mean()
    d = np.sqrt((a * a).mean() * (b * b).mean())
    return float((a * b).mean() / d) if d > 0 else float("nan")


def brute(x, y, alphas, n_train, held, digits=9):
    xtr, ytr, xte, yte = x[:n_train], y[:n_train], x[n_train:], y[n_train:]
    nb, na, nv = len(held), len(alphas), y.shape[1]
    cv = np.zeros((nb, na, nv))
    for b, h in enumerate(held):
        r = np.setdiff1d(np.arange(n_train), h)
        g = xtr[r].T @ xtr[r]
        for i, a in enumerate(alphas):
            w = np.linalg.solve(g + a * a * np.eye(g.shape[0]), xtr[r].T @ ytr[r])
            p = xtr[h] @ w
            for v in range(nv):
                c = _pearson(ytr[h, v], p[:, v])
                cv[b, i, v] = 0.0 if np.isnan(c) else c
    best = np.argmax(np.round(cv.mean(0), digits), axis=0)
    va = np.asarray(alphas)[best]
    corr = np.zeros(nv)
    g = xtr.T @ xtr
    for v in range(nv):
        w = np.linalg.solve(g + va[v] ** 2 * np.eye(g.shape[0]), xtr.T @ ytr[:, v])
        c = _pearson(yte[:, v], xte @ w)
        corr[v] = 0.0 if np.isnan(c) else c
    return va, corr, cv


@pytest.fixture(scope="module")
def problem(spark):
    tok = fx.tok(spark, SF_SMALL)
    x = an.stimulus(tok, 16, HashEmbedder(8)).persist()
    y = an.Cohort(fx.resp(spark, SF_SMALL), fx.part(spark, SF_SMALL), fx.TASK, fx.EXCLUDED_IDS, "#").prepare(x)
    return x, y.persist()


def test_bootstrap_ridge_matches_brute_force(spark, problem):
    x_df, y_df = problem
    p = rg.RidgeParams(chunklen=5, nboots=3)
    d = rg.build_design(x_df, y_df, p)
    res = {r["voxel"]: (r["alpha"], r["corr"]) for r in rg.bootstrap_ridge(x_df, y_df, "voxel", p, design=d).collect()}
    ylong = {(r["voxel"], r["tr"]): r["value"] for r in y_df.collect()}
    vox = sorted({v for v, _ in ylong})
    pos = {t: i for i, t in enumerate(d.frames)}
    y = np.zeros((len(d.frames), len(vox)))
    for (v, t), val in ylong.items():
        if t in pos and val is not None:
            y[pos[t], vox.index(v)] = val
    va, corr, _ = brute(d.x, y, p.alphas, d.n_train, d.held)
    for j, v in enumerate(vox):
        assert res[v][0] == pytest.approx(va[j])
        assert res[v][1] == pytest.approx(corr[j], abs=1e-9)


def split_fit(x, y, n_train, held, weights=True, cutoff=1e-10, rows=True):
    """(Solver, SeriesMoments) of in-memory matrices; ``rows``: as the packed
    plan has them, else as the additive plan does."""
    sets = {rm.TRAIN: np.arange(n_train), rm.TEST: np.arange(n_train, len(x)), **dict(enumerate(held))}
    by = {b: np.delete(x[:n_train], h, axis=0) for b, h in enumerate(held)}
    by[rm.TRAIN] = x[:n_train]
    solver = rm.Solver({s: rm.RowMoments.of(x[i]) for s, i in sets.items()}, len(held), cutoff, weights,
                       by if rows else None)
    return solver, rm.SeriesMoments({s: x[i].T @ y[i] for s, i in sets.items()}, {s: y[i].sum(0) for s, i in sets.items()},
                                    {s: (y[i] ** 2).sum(0) for s, i in sets.items()})


def r2_root(y, p, blended):
    v = 1 - (y - p).var(0) / ((1 + y.var(0)) / 2 if blended else y.var(0))
    return np.sqrt(np.abs(v)) * np.sign(v)


def test_weight_free_equals_weights_path_on_finite_data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = x @ rng.normal(size=(5, 7)) + rng.normal(size=(60, 7))
    va = np.full(7, 3.0)
    c1, w = (lambda s, m: s.fit(m, va, False, True, True))(*split_fit(x, y, 48, []))
    c2, _ = (lambda s, m: s.fit(m, va, False, True, False))(*split_fit(x, y, 48, [], weights=False))
    assert np.allclose(c1, c2, atol=1e-12)
    g = x[:48].T @ x[:48]
    assert np.allclose(w.T, np.linalg.solve(g + 9.0 * np.eye(5), x[:48].T @ y[:48]), atol=1e-10)


def test_weights_shrink_to_zero_as_alpha_grows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    y = rng.normal(size=(40, 3))
    s, m = split_fit(x, y, 30, [])
    norms = [np.abs(s.fit(m, np.full(3, a), False, True, True)[1]).max() for a in (1.0, 10.0, 100.0, 1e4)]
    assert all(a > b for a, b in zip(norms, norms[1:]))
    assert norms[-1] < 1e-6


def test_correlation_invariant_to_response_scale_and_shift():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    y = rng.normal(size=(50, 4))
    held = [np.arange(0, 10), np.arange(20, 30)]
    a, b = (s.held_out(m, [1.0, 10.0], False, True)
            for s, m in (split_fit(x, y, 40, held), split_fit(x, 3.0 * y, 40, held)))
    assert np.allclose(a, b)


def test_more_features_than_frames():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 50))
    y = rng.normal(size=(30, 2))
    s, m = split_fit(x, y, 24, [])
    _, w = s.fit(m, np.array([2.0, 5.0]), False, True, True)
    g = x[:24].T @ x[:24]
    for j, a in enumerate((2.0, 5.0)):
        ref = np.linalg.solve(g + a * a * np.eye(50), x[:24].T @ y[:24, j])
        assert np.allclose(w[j], ref, atol=1e-8)


@pytest.mark.parametrize("rows", [True, False])
def test_scores_equal_direct_predictions(rows):
    """Every score kind, from moments and from predictions of normal equations."""
    rng = np.random.default_rng(4)
    x, held = rng.normal(size=(60, 6)), [np.arange(5, 15), np.arange(30, 42)]
    y = x @ rng.normal(size=(6, 5)) + rng.normal(size=(60, 5)) + 2.0
    y[:, 4] = 1.0                                        # a response that does not vary
    alphas = np.array([0.5, 3.0, 40.0])

    def pred(fit, score, a, v):
        g = x[fit].T @ x[fit]
        return x[score] @ np.linalg.solve(g + a * a * np.eye(6), x[fit].T @ y[fit, v])

    for use_corr in (True, False):
        s, m = split_fit(x, y, 48, held, weights=False, rows=rows)
        cv, grid = s.held_out(m, alphas, False, use_corr), s.on_test(m, alphas, False, use_corr)
        for v in range(5):
            for i, a in enumerate(alphas):
                for got, fit, score in ([(cv[b, i, v], np.setdiff1d(np.arange(48), h), h) for b, h in enumerate(held)]
                                        + [(grid[i, v], np.arange(48), np.arange(48, 60))]):
                    p = pred(fit, score, a, v)
                    want = _pearson(y[score, v], p) if use_corr else r2_root(y[score, v], p, True)
                    assert got == pytest.approx(0.0 if v == 4 and use_corr else want, abs=1e-9)
        for weights in (True, False):
            s, m = split_fit(x, y, 48, held, weights=weights, rows=rows)
            got, _ = s.fit(m, np.full(5, 3.0), False, use_corr, weights)
            for v in range(4):
                p = pred(np.arange(48), np.arange(48, 60), 3.0, v)
                want = _pearson(y[48:, v], p) if use_corr else r2_root(y[48:, v], p, not weights)
                assert got[v] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("rows", [True, False])
def test_alpha_zero_is_the_pseudo_inverse_on_deficient_stimuli(rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 6))
    y = rng.normal(size=(50, 4))
    s, m = split_fit(x, y, 40, [np.arange(0, 8)], rows=rows)
    score, w = s.fit(m, np.zeros(4), False, True, True)
    ref = np.linalg.pinv(x[:40]) @ y[:40]
    assert np.allclose(w.T, ref, atol=1e-8)
    assert np.allclose(score, [_pearson(y[40:, v], x[40:] @ ref[:, v]) for v in range(4)], atol=1e-8)
    cut, _ = (lambda s, m: s.fit(m, np.zeros(4), False, True, False))(
        *split_fit(x, y, 40, [], weights=False, cutoff=np.linalg.svd(x[:40])[1][1], rows=rows))
    u, sv, vt = np.linalg.svd(x[:40], full_matrices=False)
    one = vt[:1].T @ (u[:, :1].T @ y[:40]) / sv[0]
    assert np.allclose(cut, [_pearson(y[40:, v], x[40:] @ one[:, v]) for v in range(4)], atol=1e-8)


def test_equal_scores_pick_first_alpha():
    cv = np.array([[0.5, 0.1], [0.5, 0.3], [0.2, 0.3]])
    assert list(rg.pick_alpha(cv, 9)) == [0, 1]


def test_zero_boots_rules(spark, problem):
    x_df, y_df = problem
    with pytest.raises(ValueError):
        rg.bootstrap_ridge(x_df, y_df, "voxel", rg.RidgeParams(nboots=0, chunklen=5))
    with pytest.raises(ValueError):
        rg.bootstrap_ridge(x_df, y_df, "voxel", rg.RidgeParams(nboots=0, chunklen=5, single_alpha=True))
    r = rg.bootstrap_ridge(x_df, y_df, "voxel", rg.RidgeParams(nboots=0, chunklen=5, single_alpha=True,
                                                                alphas=[7.0])).collect()
    assert {row["alpha"] for row in r} == {7.0}


def test_groups_share_alpha_and_ungrouped_get_zero(spark, problem):
    x_df, y_df = problem
    vox = sorted(r[0] for r in y_df.select("voxel").distinct().collect())
    # first half in groups 0/1 (voxel listed twice: later (larger) group wins), rest ungrouped
    rows = [(v, v % 2) for v in vox[: len(vox) // 2]] + [(vox[0], 1)]
    groups = spark.createDataFrame(rows, "voxel int, grp int")
    r = rg.bootstrap_ridge(x_df, y_df, "voxel", rg.RidgeParams(chunklen=5, nboots=2), groups=groups).collect()
    alpha = {row["voxel"]: row["alpha"] for row in r}
    for v in vox[len(vox) // 2:]:
        if v != vox[0]:
            assert alpha[v] == 0.0
    g1 = {alpha[v] for v in vox[: len(vox) // 2] if v % 2 == 1 or v == vox[0]}
    assert len(g1) == 1


def test_fit_runs_equals_separate_fits(spark, problem):
    x_df, y_df = problem
    p = rg.RidgeParams(chunklen=5, nboots=2)
    x2 = x_df.select("tr", F.slice("x", 1, 3).alias("x"))
    multi = {(r["run"], r["voxel"]): (r["alpha"], r["corr"])
             for r in rg.fit_runs({"a": x_df, "b": x2}, y_df, "voxel", p).collect()}
    for name, xx in (("a", x_df), ("b", x2)):
        for r in rg.bootstrap_ridge(xx, y_df, "voxel", p).collect():
            a, c = multi[(name, r["voxel"])]
            assert a == r["alpha"] and c == pytest.approx(r["corr"], abs=1e-12)


def test_broadcast_limit_is_enforced(spark, problem):
    x_df, y_df = problem
    with pytest.raises(ValueError):
        rg.build_design(x_df, y_df, rg.RidgeParams(chunklen=5, max_broadcast_bytes=100))


@pytest.mark.parametrize("kw", [dict(), dict(return_weights=False), dict(use_corr=False), dict(normalpha=True),
                                dict(single_alpha=True), dict(alphas=[0.0, 1.0]), dict(singcutoff=2.0, return_weights=False),
                                dict(nboots=0, single_alpha=True, alphas=[7.0]), dict(groups=True)])
def test_additive_plan_equals_packed_plan(spark, problem, kw):
    """Same columns and values for every option; the stimulus has a repeated
    feature, so it is rank-deficient."""
    x_df, y_df = problem
    x_df = x_df.withColumn("x", F.concat("x", F.slice("x", 1, 2)))
    kw = dict(kw)
    groups = None
    if kw.pop("groups", False):
        groups = y_df.where("voxel % 3 > 0").select("voxel", (F.col("voxel") % 3).alias("grp")).distinct()
    p = rg.RidgeParams(**{"chunklen": 5, "nboots": 3, **kw})
    one, two = (rg.bootstrap_ridge(x_df, y_df, "voxel", p, groups, plan=plan) for plan in ("packed", "additive"))
    assert one.columns == two.columns
    a, b = ({r["voxel"]: r for r in t.collect()} for t in (one, two))
    assert set(a) == set(b)
    for v in a:
        assert a[v]["alpha"] == b[v]["alpha"]
        if a[v]["corr"] is None or math.isnan(a[v]["corr"]):
            assert b[v]["corr"] is None or math.isnan(b[v]["corr"])
        else:
            assert a[v]["corr"] == pytest.approx(b[v]["corr"], abs=1e-6)
        if p.return_weights:
            assert np.allclose(a[v]["weights"], b[v]["weights"], atol=1e-5)


def test_grid_boot_scores_weights_and_runs_in_both_plans(spark, problem):
    x_df, y_df = problem
    p = rg.RidgeParams(chunklen=5, nboots=2)
    small = rg.RidgeParams(chunklen=5, nboots=2, max_broadcast_bytes=10_000)
    for call in (lambda plan: rg.ridge_grid(x_df, y_df, "voxel", p, plan=plan),
                 lambda plan: rg.boot_scores_long(x_df, y_df, "voxel", p, plan=plan),
                 lambda plan: rg.ridge_weights(x_df, y_df, "voxel", 3.0, plan=plan).select("voxel", F.posexplode("weights")),
                 lambda plan: rg.fit_runs({"a": x_df}, y_df, "voxel", p if plan == "packed" else small).drop("run")):
        a, b = ({tuple(r[:-1]): r[-1] for r in call(plan).collect()} for plan in ("packed", "additive"))
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k], abs=1e-7) for k in a)


def test_weights_on_all_rows_and_factors(spark, problem):
    x_df, y_df = problem
    rows = sorted(x_df.collect(), key=lambda r: r["tr"])
    x = np.array([r["x"] for r in rows])
    ys = {(r["voxel"], r["tr"]): r["value"] or 0.0 for r in y_df.collect()}
    frames = sorted({r["tr"] for r in rows} & {t for _, t in ys})
    keep = [i for i, r in enumerate(rows) if r["tr"] in frames]
    g = x[keep].T @ x[keep]
    for r in rg.ridge_weights(x_df, y_df, "voxel", 2.0).collect():
        y = np.array([ys.get((r["voxel"], t), 0.0) for t in frames])
        assert np.allclose(r["weights"], np.linalg.solve(g + 4.0 * np.eye(x.shape[1]), x[keep].T @ y), atol=1e-8)
    factors, left = rg.factorize(x_df)
    f = sorted(factors.collect())
    u = np.array([r["u"] for r in sorted(left.collect(), key=lambda r: r["tr"])])
    s, v = np.array([r["sigma"] for r in f]), np.array([r["v"] for r in f])
    assert np.allclose((u * s) @ v, x, atol=1e-6) and np.allclose(u.T @ u, np.eye(len(s)), atol=1e-6)
    assert np.allclose(s, np.linalg.svd(x)[1][:len(s)])


def test_bootstrap_tables_share_the_draw(spark, problem):
    x_df, y_df = problem
    t = rg.bootstrap_tables(x_df, y_df, "voxel", rg.RidgeParams(chunklen=5, nboots=2))
    assert {r["boot"] for r in t["held"].collect()} == {0, 1} == {r["boot"] for r in t["boot_scores"].collect()}
    assert t["fit"].count() == y_df.select("voxel").distinct().count()


def test_group_mode_reads_the_bootstrap_once(spark, problem):
    x_df, y_df = problem
    groups = y_df.select("voxel", F.lit(1).alias("grp")).distinct()
    plan = rg.bootstrap_ridge(x_df, y_df, "voxel", rg.RidgeParams(chunklen=5, nboots=2), groups)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 2


def test_auto_plan_switches_beyond_broadcast_limit(spark, problem):
    x_df, y_df = problem
    small = rg.RidgeParams(chunklen=5, nboots=2, max_broadcast_bytes=10_000)
    big = rg.RidgeParams(chunklen=5, nboots=2)
    a = {r["voxel"]: r["corr"] for r in rg.bootstrap_ridge(x_df, y_df, "voxel", small).collect()}
    b = {r["voxel"]: r["corr"] for r in rg.bootstrap_ridge(x_df, y_df, "voxel", big).collect()}
    assert a.keys() == b.keys() and all(a[v] == pytest.approx(b[v], abs=1e-7) for v in a)


@pytest.mark.parametrize("n,chunk,boots,seed", [(83, 5, 5, 42), (40, 3, 4, 7), (23, 5, 2, 1)])
def test_design_indices_equal_spark_split_and_draw(spark, n, chunk, boots, seed):
    from voxlex.operators import splits as sp
    frames = list(range(10, 10 + 2 * n, 2))
    df = spark.createDataFrame([(t,) for t in frames], "tr int")
    s = sp.ordered_split(df, "tr", 0.2)
    c = sp.chunk_ids(s, chunk)
    n_train_spark = c.count()
    k = sp.default_nchunks(n_train_spark, chunk)
    held_spark = {}
    for r in sp.holdout_rows(c, sp.holdout_chunks(c, boots, k, seed)).collect():
        held_spark.setdefault(r["boot"], []).append(r["train_idx"])
    n_train, held = sp.design_indices(frames, 0.2, chunk, boots, None, seed)
    assert n_train == n_train_spark
    assert [sorted(held_spark.get(b, [])) for b in range(boots)] == held


def test_pca_sweep_matches_numpy(spark):
    from voxlex.operators import splits as sp
    x_df = fx.stim_frames(spark, SF_SMALL)
    y_df = fx.resp_dense(spark, SF_SMALL)
    p = rg.RidgeParams(chunklen=5, nboots=3)
    got = {r["n_components"]: r for r in an.pca_sweep(x_df, y_df, (4, 8), p).collect()}
    xs = {r["tr"]: np.asarray(r["x"]) for r in x_df.collect()}
    ys = {}
    for r in y_df.collect():
        ys.setdefault(r["voxel"], {})[r["tr"]] = r["value"]
    frames = sorted(set(xs) & {t for v in ys.values() for t in v})
    vox = sorted(ys)
    x = np.vstack([xs[t] for t in frames])
    y = np.array([[ys[v].get(t, 0.0) for v in vox] for t in frames])
    n_train, held = sp.design_indices(frames, 0.2, 5, 3, None, 42)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for k in (4, 8):
        _, corr, _ = brute(x @ vt[:k].T, y, p.alphas, n_train, [np.array(h) for h in held])
        r = got[k]
        assert r["count"] == len(vox)
        assert r["mean"] == pytest.approx(corr.mean(), abs=1e-9)
        assert r["q50"] == pytest.approx(np.quantile(corr, 0.5), abs=1e-9)
        assert r["n_above"] == int((corr > 0.3).sum())


def test_long_recordings_take_the_additive_plan(spark, problem):
    x_df, y_df = problem
    plan, frames = rg.choose_plan(x_df, y_df, rg.RidgeParams(chunklen=5, max_packed_frames=10))
    assert plan == "additive" and frames is None
    plan, frames = rg.choose_plan(x_df, y_df, rg.RidgeParams(chunklen=5))
    assert plan == "packed" and len(frames) > 10


def test_blocked_series_stats_match_numpy(spark, problem):
    from voxlex.operators import ridge_stats as rs
    x_df, y_df = problem
    p = rg.RidgeParams(chunklen=5, nboots=2)
    sets = rs.row_sets(x_df, y_df, p)
    got = {}
    for r in rs.series_stats(x_df, y_df, sets, ["voxel"], frame_block=7, series_buckets=3).collect():
        for e in r["stats"]:
            got[(r["voxel"], e["s"])] = (np.asarray(e["c"]), e["sy"], e["syy"])
    xs = {r["tr"]: np.asarray(r["x"]) for r in x_df.collect()}
    members = {}
    for r in sets.collect():
        members.setdefault(r["s"], set()).add(r["tr"])
    ys = {(r["voxel"], r["tr"]): (r["value"] or 0.0) for r in y_df.collect()}
    for (v, s_id), (c, sy, syy) in got.items():
        cells = [(t, ys[(v, t)]) for t in members[s_id] if (v, t) in ys]
        assert np.allclose(c, sum(xs[t] * val for t, val in cells), atol=1e-9)
        assert sy == pytest.approx(sum(val for _, val in cells))
        assert syy == pytest.approx(sum(val * val for _, val in cells))
    assert len(got) == len({(v, s_id) for (v, t) in ys for s_id, fr_ in members.items() if t in fr_})
