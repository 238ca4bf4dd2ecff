"""Hand-made edge cases (FIXTURES.md part 4) on inline rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlex.functions import to_frame, subject_code
from voxlex.operators import context as cx
from voxlex.operators import frames as fr
from voxlex.operators import series as se
from voxlex.operators import splits as sp
from voxlex.operators import stats as st
from voxlex.operators.embed import HashEmbedder, embed, embed_context_windows


def _tok(spark, n, seq=1):
    return spark.createDataFrame([(seq, i, f"w{i}") for i in range(n)], "seq long, pos int, word string")


def test_constant_series_correlation_is_null(spark):
    df = spark.createDataFrame([(1, t, 5.0, float(t)) for t in range(6)], "voxel int, tr int, a double, b double")
    assert st.series_corr(df, "voxel", "a", "b").first()["corr"] is None


def test_all_nan_cell_becomes_null_and_nan_only_series_is_dead(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0, 1, nan), (2, 0, 1, nan), (1, 1, 1, 2.0), (1, 0, 2, nan), (2, 0, 2, nan)],
                               "subject int, tr int, voxel int, value double")
    m = {(r["tr"], r["voxel"]): r["value"] for r in se.mean_over_subjects(df).collect()}
    assert m[(0, 1)] is None and m[(1, 1)] == 2.0
    live = {r["voxel"] for r in se.live_series(se.mean_over_subjects(df)).collect()}
    assert live == {1}


def test_sequence_shorter_than_window_and_ws_zero(spark):
    t = _tok(spark, 3)
    got = {r["pos"]: r["context"] for r in cx.context_window(t, 10).collect()}
    assert got == {0: "w0", 1: "w0 w1", 2: "w0 w1 w2"}
    got0 = {r["pos"]: r["context"] for r in cx.context_window(t, 0).collect()}
    assert got0 == {0: "w0", 1: "w1", 2: "w2"}


def test_halo_blocks_match_plain_window(spark):
    t = _tok(spark, 200).unionByName(_tok(spark, 37, seq=2))
    a = {(r["seq"], r["pos"]): r["context"] for r in cx.context_window(t, 5, block=8).collect()}
    b = {(r["seq"], r["pos"]): r["context"] for r in cx.context_window(t, 5, block=1 << 20).collect()}
    assert a == b and len(a) == 237
    assert a[(1, 9)] == "w4 w5 w6 w7 w8 w9"


def test_trailing_text_at_anchors_matches_window(spark):
    t = _tok(spark, 300)
    anchors = t.where(F.col("pos") % 30 == 0).select("seq", "pos")
    a = {r["pos"]: r["text"] for r in cx.trailing_text_at(t, anchors, 45, chunk=8).collect()}
    b = {r["pos"]: r["context"] for r in cx.context_window(t, 45).where(F.col("pos") % 30 == 0).collect()}
    assert a == b


def test_embedding_paths_agree(spark):
    t = _tok(spark, 50)
    ctx = cx.context_window(t, 4, out="text")
    m = HashEmbedder(3)
    jvm = {r["pos"]: r["x"] for r in embed(ctx, "text", m, "mean", jvm=True).collect()}
    bat = {r["pos"]: r["x"] for r in embed(ctx, "text", m, "mean").collect()}
    fused = {r["pos"]: r["x"] for r in embed_context_windows(t, 4, m, "mean", block=16).collect()}
    for k in jvm:
        assert np.allclose(jvm[k], bat[k]) and np.allclose(jvm[k], fused[k])


def test_frame_index_floors_negative_times(spark):
    df = spark.createDataFrame([(-0.4,), (0.0,), (1.49,), (1.5,)], "t double")
    got = [r[0] for r in df.select(to_frame("t", 0.0, 1.5)).collect()]
    assert got == [-1, 0, 0, 1]


def test_participant_without_separator_gives_null(spark):
    df = spark.createDataFrame([("sub-004",), ("nobody",)], "p string")
    assert [r[0] for r in df.select(subject_code("p")).collect()] == ["004", None]


def test_tail_chunk_is_never_held_out(spark):
    frames = spark.createDataFrame([(t,) for t in range(23)], "tr int")
    s = sp.ordered_split(frames, "tr", 0.2)          # 5 test frames, 18 train
    c = sp.chunk_ids(s, 5)                           # 3 full chunks + tail of 3
    rows = {r["train_idx"]: r["chunk"] for r in c.collect()}
    assert len(rows) == 18 and rows[15] is None and rows[14] == 2
    held = sp.holdout_chunks(c, 4, 2, 7).collect()
    assert all(r["chunk"] is not None for r in held) and len(held) == 8


def test_refresh_anchor_rules(spark):
    t = _tok(spark, 70)
    r = {x["pos"]: (x["is_refresh"], x["anchor"]) for x in cx.refresh(t, 30, 20).collect()}
    assert r[19] == (False, None) and r[20] == (True, 20) and r[29] == (False, 20)
    assert r[30] == (True, 30) and r[59] == (False, 30) and r[60] == (True, 60)


def test_summary_hold_and_reset(spark):
    t = _tok(spark, 70)
    reset = {r["pos"]: r["text"] for r in cx.with_summary(t, 2, cx.digest_text, hold=False).collect()}
    hold = {r["pos"]: r["text"] for r in cx.with_summary(t, 2, cx.digest_text, hold=True).collect()}
    assert reset[10] == hold[10] == "w8 w9 w10"
    assert reset[25] == cx.HEADER_SUMMARY + " : w23 w24 w25"
    assert hold[25].split(" : ")[0] == hold[20].split(" : ")[0] != cx.HEADER_SUMMARY
    assert hold[25] == hold[20].replace("w18 w19 w20", "w23 w24 w25")


def test_exclude_strict_raises_on_missing_id(spark):
    df = spark.createDataFrame([("001",), ("002",)], "subject string")
    with pytest.raises(ValueError):
        fr.exclude(df, ["009"], strict=True)
    assert [r[0] for r in fr.exclude(df, ["002"]).collect()] == ["001"]


def test_renumber_is_dense_with_tiny_blocks(spark):
    df = spark.createDataFrame([(1, p) for p in (3, 9, 10, 40, 41, 77)] + [(2, 5)], "seq int, o int")
    got = sorted((r["seq"], r["o"], r["pos"]) for r in fr.renumber(df, ["seq"], "o", "pos", block=4).collect())
    assert got == [(1, 3, 0), (1, 9, 1), (1, 10, 2), (1, 40, 3), (1, 41, 4), (1, 77, 5), (2, 5, 0)]


def test_kde_integrates_to_one(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=300)], "corr double")
    k = sorted((r["x"], r["density"]) for r in st.kde(df, None, "corr", grid=400).collect())
    xs, ds = np.array([a for a, _ in k]), np.array([b for _, b in k])
    assert math.isclose(np.trapezoid(ds, xs), 1.0, rel_tol=1e-3)


def test_exact_quantiles_match_numpy_with_ties_and_skew(spark):
    rng = np.random.default_rng(5)
    big = np.round(rng.normal(size=3000), 2)          # one hot group with many ties
    rows = [("hot", float(v)) for v in big] + [("one", 4.0), ("two", 1.0), ("two", 3.0)]
    rows += [("nul", None)]
    df = spark.createDataFrame(rows, "g string, corr double")
    d = {r["g"]: r for r in st.describe_scores(df, "g", "corr").collect()}
    for g, vals in (("hot", big), ("one", np.array([4.0])), ("two", np.array([1.0, 3.0]))):
        q = np.quantile(vals, [0.25, 0.5, 0.75])
        assert [d[g]["q25"], d[g]["q50"], d[g]["q75"]] == pytest.approx(list(q))
        assert d[g]["count"] == len(vals)
    assert d["nul"]["count"] == 0 and d["nul"]["q50"] is None


def test_gather_frames_reports_missing_frames(spark):
    resp = spark.createDataFrame([(0, 1, 1.0), (1, 1, 2.0), (2, 1, 3.0)], "tr int, voxel int, value double")
    frames = spark.createDataFrame([(1,), (2,), (9,), (-1,)], "tr int")
    assert sorted(r["tr"] for r in fr.gather_frames(resp, frames).collect()) == [1, 2]
    assert sorted(r["tr"] for r in fr.missing_frames(resp, frames).collect()) == [-1, 9]


def test_generic_model_protocol_and_column_text_fn(spark):
    class _LengthModel:
        """A tiny custom model: token vector = (len(token), 1.0); loaded once per task.

        Defined locally so it travels to the workers by value (a model in its
        own module would be shipped with --py-files).
        """

        def load(self):
            return self

        def encode(self, texts):
            return [np.array([[float(len(t)), 1.0] for t in text.split(" ")]) for text in texts]

    df = spark.createDataFrame([(1, "aa bbbb c"), (2, "dddddd")], "id int, text string")
    got = {r["id"]: r["x"] for r in embed(df, "text", _LengthModel(), "mean").collect()}
    assert np.allclose(got[1], [7 / 3, 1.0]) and np.allclose(got[2], [6.0, 1.0])
    last = {r["id"]: r["x"] for r in embed(df, "text", _LengthModel(), "last").collect()}
    assert np.allclose(last[1], [1.0, 1.0])
    upper = cx.ColumnTextFn(lambda c: F.upper(c))
    assert [r["u"] for r in cx.apply_text_fn(df, "text", upper, "u").orderBy("id").collect()] == ["AA BBBB C", "DDDDDD"]
    words = cx.apply_text_fn(df, "text", lambda t: t.str.split().str[:2].str.join(" "), "w").orderBy("id").collect()
    assert [r["w"] for r in words] == ["aa bbbb", "dddddd"]
