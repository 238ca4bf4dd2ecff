"""The QR tree (G1) and the dual ridge plan (G2-G8) against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlex.operators import factor as fa
from voxlex.operators import ridge as rg
from voxlex.operators import ridge_dual as rd


def stimulus(spark, x, parts=7):
    rows = [(t, [float(v) for v in r]) for t, r in enumerate(x)]
    return spark.createDataFrame(rows, "tr int, x array<double>").repartition(parts)


def responses(spark, y):
    return spark.createDataFrame([(v, t, float(y[t, v])) for t in range(y.shape[0]) for v in range(y.shape[1])],
                                 "voxel int, tr int, value double")


def test_small_singular_values_survive_the_tree(spark):
    """Values 1 to 1e-9, one direction empty: all nine decades are recovered."""
    rng = np.random.default_rng(0)
    u, _ = np.linalg.qr(rng.normal(size=(300, 11)))
    v, _ = np.linalg.qr(rng.normal(size=(11, 11)))
    sing = np.concatenate([10.0 ** -np.arange(10), [0.0]])
    x = (u * sing) @ v.T
    factors, left = rg.factorize(stimulus(spark, x, 40), cutoff=1e-10)
    f = sorted(factors.collect())
    assert np.allclose([r["sigma"] for r in f], sing[:10], rtol=1e-5, atol=0)
    got = np.array([r["u"] for r in sorted(left.collect(), key=lambda r: r["tr"])])
    assert np.allclose(np.abs((got * u[:, :10]).sum(0)), 1.0, atol=1e-5)
    # a higher cut-off drops by absolute size
    assert rg.factorize(stimulus(spark, x), cutoff=1e-4 * 1.5)[0].count() == 4
    spectrum = [r["sigma"] for r in rg.feature_spectrum(stimulus(spark, x)).orderBy("k").collect()]
    assert np.allclose(spectrum[:10], sing[:10], rtol=1e-5, atol=0) and spectrum[10] == 0.0


@pytest.mark.parametrize("shape", [(0, 3), (1, 4), (3, 9), (200, 5)])
def test_triangles_keep_the_gram_matrix(spark, shape):
    x = np.random.default_rng(1).normal(size=shape)
    rows = spark.createDataFrame([(i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "s int, x array<double>")
    got: dict = {}
    for r in fa.triangles(rows.repartition(30), shape[1], fan=3).collect():
        got.setdefault(r["s"], []).append(r["x"])
    for s in {i % 2 for i in range(len(x))}:
        r = np.array(got[s])
        assert len(r) <= max(1, min(shape))
        assert np.allclose(r.T @ r, x[s::2].T @ x[s::2], atol=1e-10)


def test_rotated_frames_have_the_same_products(spark):
    rng = np.random.default_rng(2)
    for n, width, features in ((12, 40, 7), (12, 5, 2), (1, 3, 3)):
        x = rng.normal(size=(n, width))
        z = rd.rotate(stimulus(spark, x), list(range(n)), width, features=features).orderBy("tr").collect()
        z = np.array([r["x"] for r in z])
        assert z.shape[1] <= n and np.allclose(z @ z.T, x @ x.T, atol=1e-10)


def test_feature_weights_are_a_blocked_product(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(9, 31)), rng.normal(size=(23, 9))
    coef = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "voxel int, _c array<double>")
    got = rd.feature_weights(coef, ["voxel"], stimulus(spark, x), list(range(9)), 31, features=4, buckets=3)
    got = {r["voxel"]: r["weights"] for r in got.collect()}
    assert np.allclose([got[i] for i in range(23)], c @ x, atol=1e-12)


@pytest.fixture(scope="module")
def wide(spark):
    """More features than frames, two of them equal to others."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 90))
    x[:, 88:] = x[:, :2]
    x[7] = x[3]                                    # rank below the number of frames as well
    y = x @ rng.normal(size=(90, 6)) * 0.2 + rng.normal(size=(40, 6))
    y[:, 5] = 2.0                                  # a series that does not vary
    return stimulus(spark, x).persist(), responses(spark, y).persist(), x, y


@pytest.mark.parametrize("kw", [{}, {"normalpha": True}, {"single_alpha": True}, {"return_weights": False},
                                {"use_corr": False}, {"alphas": [1e-6, 0.5, 20.0]}])
def test_three_plans_agree_with_more_features_than_frames(spark, wide, kw):
    x_df, y_df, *_ = wide
    p = rg.RidgeParams(**{"chunklen": 4, "nboots": 3, **kw})
    out = {}
    for plan in ("packed", "additive", "dual"):
        r = rg.bootstrap_ridge(x_df, y_df, "voxel", p, plan=plan)
        assert r.columns == ["voxel", "alpha", "corr"] + ["weights"] * p.return_weights
        out[plan] = {r["voxel"]: r for r in r.collect()}
    for plan in ("additive", "dual"):
        assert out[plan].keys() == out["packed"].keys()
        for v, a in out["packed"].items():
            b = out[plan][v]
            assert a["alpha"] == pytest.approx(b["alpha"])
            assert (a["corr"] is None) == (b["corr"] is None)
            assert a["corr"] is None or a["corr"] == pytest.approx(b["corr"], abs=1e-6)
            if p.return_weights:
                assert np.allclose(a["weights"], b["weights"], atol=1e-6)


def test_dual_weights_solve_the_normal_equations(spark, wide):
    x_df, y_df, x, y = wide
    got = {r["voxel"]: r["weights"] for r in rg.ridge_weights(x_df, y_df, "voxel", 1.5, plan="dual").collect()}
    ref = np.linalg.solve(x.T @ x + 2.25 * np.eye(90), x.T @ y)
    assert np.allclose([got[v] for v in range(6)], ref.T, atol=1e-9)


def test_groups_grid_and_runs_in_the_dual(spark, wide):
    x_df, y_df, *_ = wide
    p = rg.RidgeParams(chunklen=4, nboots=2)
    groups = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (2, 3)], "voxel int, grp int")
    small = rg.RidgeParams(chunklen=4, nboots=2, max_broadcast_bytes=8 * 40 * 41)
    for call in (lambda q, plan: rg.bootstrap_ridge(x_df, y_df, "voxel", q, groups, plan=plan).drop("weights"),
                 lambda q, plan: rg.ridge_grid(x_df, y_df, "voxel", q, plan=plan),
                 lambda q, plan: rg.boot_scores_long(x_df, y_df, "voxel", q, plan=plan),
                 lambda q, plan: rg.fit_runs({"a": x_df}, y_df, "voxel", q).drop("run")):
        a, b = ({tuple(r[:-1]): r[-1] for r in call(q, plan).collect()} for q, plan in ((p, "packed"), (small, "dual")))
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_auto_takes_the_smaller_side(spark, wide):
    x_df, y_df, *_ = wide
    at = lambda limit: rg.choose_plan(x_df, y_df, rg.RidgeParams(max_broadcast_bytes=limit))[0]
    assert at(8 * 40 * 90) == "packed" and at(8 * 40 * 40) == "dual" and at(8 * 40 * 39) == "additive"
    with pytest.raises(ValueError, match="dual exceed"):
        rg.bootstrap_ridge(x_df, y_df, "voxel", rg.RidgeParams(max_broadcast_bytes=8 * 40 * 39), plan="dual")
    narrow = x_df.withColumn("x", F.slice("x", 1, 30))
    assert rg.choose_plan(narrow, y_df, rg.RidgeParams(max_broadcast_bytes=8 * 30 * 30))[0] == "additive"
