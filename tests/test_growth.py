"""Work that grew faster than the input: texts embedded more than once, scores from one
row per element, blocks whose scratch arrays grew with the rows at hand."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from voxlex.operators import stats as st
from voxlex.operators.crossed import series_corr_wide, sign_flips
from voxlex.operators.embed import HashEmbedder, TextHashEmbedder, frame_contexts, frame_means


def test_windows_that_reach_the_start_are_embedded_once(spark, tmp_path):
    class Noted:
        """A model of the generic protocol that notes the texts it is given."""
        dim = 1

        def __init__(self, path):
            self.path = path

        def encode(self, texts):
            with open(self.path, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [np.array([[float(len(w))] for w in t.split(" ")]) for t in texts]

    words = [f"w{i}" for i in range(12)]
    tok = spark.createDataFrame([(1, i, w, i // 5) for i, w in enumerate(words)], "seq long, pos int, word string, tr int")
    sizes = [8, 0, 3, 64, 128]
    got = {r["tr"]: r for r in frame_contexts(tok, sizes, Noted(str(tmp_path / "texts")), "last").collect()}
    texts = (tmp_path / "texts").read_text().splitlines()
    assert sorted(texts) == sorted(" ".join(words[a:i + 1]) for i in range(12) for a in {max(0, i - ws) for ws in sizes})
    for ws in sizes:
        assert got[0][f"x_{ws}"] == [2.0] and got[2][f"x_{ws}"] == [3.0]


@pytest.mark.parametrize("texts", [
    ["a", "a b", "a b c", "b c d", "c d e f", "x", "", "a a", "a a a", "a a"],
    ["a b", "b c", " b c", "b  c", "b\tc d", "c d", "c d "]])
def test_overlapping_texts_have_the_vectors_of_each_alone(texts):
    for model in (HashEmbedder(3), TextHashEmbedder(3)):
        for got, t in zip(model.encode(texts), texts):
            assert np.array_equal(got, model.encode([t])[0])
    plain = [[HashEmbedder(3).vectors([w])[0] for w in re.split(r"[ \t]+", t.strip(" "))] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(HashEmbedder(3).encode(texts), plain))


def _odd_rows(spark):
    """Stimulus rows, responses and their chunks: whole series, one with gaps, NULL, a repeated frame, one constant, one of NULL."""
    rng = np.random.default_rng(3)
    x = [(t, [float(v) for v in rng.normal(size=3)] + [1.5]) for t in range(12)]
    y = [(s, t, float(v)) for s in range(4) for t, v in enumerate(rng.normal(size=14))]
    y += [(4, t, float(v)) for t, v in enumerate(rng.normal(size=9)) if t != 3] + [(4, 10, None), (4, 5, 0.25)]
    y += [(5, t, 0.1) for t in range(12)] + [(6, t, None) for t in range(12)] + [(None, t, float(t * t)) for t in range(12)]
    return (spark.createDataFrame(x, "tr int, x array<double>"),
            spark.createDataFrame([(*r, r[1] // 5) for r in y], "voxel int, tr int, value double, chunk int"))


def test_wide_correlations_are_those_of_the_joined_rows(spark):
    x, y = _odd_rows(spark)
    plain = lambda df: {(r["j"], r["voxel"]): r["corr"] for r in df.collect()}
    got, want = (plain(series_corr_wide(y, x, ["voxel"], max_bytes=m)) for m in (None, 0))
    assert got.keys() == want.keys() and len(got) == 4 * 8
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items() if v is not None)


@pytest.mark.parametrize("whole", [True, False])
def test_crossed_sign_flips_are_those_of_the_parts(spark, whole):
    x, y = _odd_rows(spark)
    y = y.where("voxel < 4 OR voxel = 5") if whole else y
    long = x.select("tr", F.posexplode("x").alias("run", "x")).select("tr", "run", "x")
    other = long.withColumn("run", (F.col("run") + 1) % 4)
    got = sign_flips(y, long, other, ["run", "voxel"], "chunk", nperm=49)
    parts = [st.score_parts(y.join(t, "tr"), ["run", "voxel"], "chunk", "value", "x") for t in (long, other)]
    want = st.sign_flip_test(*parts, ["run", "voxel"], "chunk", nperm=49)
    rows = lambda df: {(r["run"], r["voxel"]): (r["diff"], r["hits"], r["p"]) for r in df.collect()}
    got, want = rows(got), rows(want)
    assert got.keys() == want.keys() and len(got) >= 16
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert sign_flips(y, long, other, ["run", "voxel"], "chunk", nperm=49, max_cells=10) is None
    assert sign_flips(y, long.where("tr > 0 OR run > 0"), other, ["run", "voxel"], "chunk") is None


@pytest.mark.parametrize("name", ["subject_summary_64", "score_significance_64"])
def test_no_row_per_frame_and_element(spark, name, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("joined rows of every element")
    monkeypatch.setattr(st, "series_corr", refuse)
    monkeypatch.setattr(st, "score_parts", refuse)
    entry.queries()[name](spark, SF_SMALL)


def test_scratch_of_a_block_of_series_is_bounded_with_its_moments():
    from types import SimpleNamespace

    from voxlex.operators.ridge import PackedReader, RidgeParams
    from voxlex.operators.ridge_moments import SCRATCH_BYTES
    p, rng = RidgeParams(alphas=[1.0] * 10, nboots=5), np.random.default_rng(0)
    xs = [rng.normal(size=(48, k)) for k in (16, 32, 64)]
    reader = PackedReader(SimpleNamespace(value={"n_train": 40, "held": [np.arange(5)] * 5, "xs": xs, "token": "scratch"}), p).open()
    moments = 8 * reader.block * sum(x.shape[1] for x in xs) * len(reader.sets)
    assert 1 <= reader.block and moments <= SCRATCH_BYTES


def test_buckets_of_series_grow_with_their_products(spark, monkeypatch):
    """Cells alone would fit one bucket; their products with a wide stimulus do not."""
    from voxlex.operators import ridge_stats as rs
    monkeypatch.setattr(rs, "SCRATCH_BYTES", 4 << 10)
    monkeypatch.setattr(rs, "BLOCK_BYTES", 1 << 20)
    made = []
    hashed = F.pmod
    monkeypatch.setattr(rs.F, "pmod", lambda a, b: made.append(b) or hashed(a, b))
    x = spark.createDataFrame([(t, [float(t + j) for j in range(40)]) for t in range(2)], "tr int, x array<double>")
    y = spark.range(200).select(F.col("id").cast("int").alias("voxel"), F.lit(1).alias("tr"), F.lit(1.0).alias("value"))
    sets = x.select("tr", F.lit(-1).alias("s"))
    got = {r["voxel"]: r["stats"][0]["c"] for r in rs.series_stats(x, y, sets, ["voxel"]).collect()}
    assert len(got) == 200 and got[7] == [float(1 + j) for j in range(40)]
    assert "200" not in str(made[0]) and int(re.findall(r"\d+", str(made[0]))[0]) > 8


def test_frame_means_read_the_words_once(spark):
    rows = [(s, i, w, i // 3) for s in range(3) for i, w in enumerate(["a", "b", None, "c d", "", "e"] * 4)]
    tok = spark.createDataFrame(rows, "seq long, pos int, word string, tr int")
    model = HashEmbedder(2)
    got = {r["tr"]: r for r in frame_means(tok, [4, 0, 7], model, block=8).collect()}
    v = model.vectors([r[2] or "" for r in rows[:24]])
    for ws in (4, 0, 7):
        mean = np.array([v[max(0, i - ws):i + 1].sum(0) / (min(ws, i) + 1) for i in range(24)])
        for t in range(8):
            assert got[t][f"x_{ws}"] == pytest.approx(mean[3 * t:3 * t + 3].mean(0).tolist(), abs=1e-12)
    plan = frame_means(tok, [4], model)._jdf.queryExecution().toString()
    assert "Window" not in plan and "ArrowEvalPython" not in plan
