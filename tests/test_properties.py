"""Property tests for the skew-safe operators (random shapes, small blocks)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from voxlex.operators import context as cx
from voxlex.operators import frames as fr
from voxlex.operators import splits as sp

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(lengths=st_.lists(st_.integers(1, 60), min_size=1, max_size=4), ws=st_.integers(0, 12),
       block=st_.integers(13, 40))
def test_halo_window_equals_python_slices(spark, lengths, ws, block):
    rows = [(s, i, f"s{s}w{i}") for s, n in enumerate(lengths) for i in range(n)]
    tok = spark.createDataFrame(rows, "seq long, pos int, word string")
    got = {(r["seq"], r["pos"]): r["context"] for r in cx.context_window(tok, ws, block=block).collect()}
    for s, n in enumerate(lengths):
        words = [f"s{s}w{i}" for i in range(n)]
        for i in range(n):
            assert got[(s, i)] == " ".join(words[max(0, i - ws): i + 1])


@SETTINGS
@given(orders=st_.lists(st_.sets(st_.integers(-50, 500), min_size=1, max_size=40), min_size=1, max_size=3),
       block=st_.integers(1, 64))
def test_renumber_is_rank_within_sequence(spark, orders, block):
    rows = [(s, o) for s, os in enumerate(orders) for o in os]
    df = spark.createDataFrame(rows, "seq int, o int")
    got = {(r["seq"], r["o"]): r["pos"] for r in fr.renumber(df, ["seq"], "o", "pos", block=block).collect()}
    for s, os in enumerate(orders):
        for rank, o in enumerate(sorted(os)):
            assert got[(s, o)] == rank


@SETTINGS
@given(n=st_.integers(12, 60), chunk=st_.integers(2, 6), boots=st_.integers(1, 4), seed=st_.integers(0, 99))
def test_holdout_and_train_partition_the_training_rows(spark, n, chunk, boots, seed):
    frames = spark.createDataFrame([(t,) for t in range(n)], "tr int")
    c = sp.chunk_ids(sp.ordered_split(frames, "tr", 0.2), chunk)
    n_train = c.count()
    held = sp.holdout_chunks(c, boots, max(1, sp.default_nchunks(n_train, chunk)), seed)
    h = {(r["boot"], r["tr"]) for r in sp.holdout_rows(c, held).collect()}
    t = {(r["boot"], r["tr"]) for r in sp.train_rows(c, held, boots).collect()}
    assert not (h & t)
    assert h | t == {(b, tr) for b in range(boots) for tr in range(n_train)}


@SETTINGS
@given(n=st_.integers(40, 200), ws=st_.integers(3, 60), every=st_.integers(5, 40), chunk=st_.integers(4, 32))
def test_anchor_text_equals_window_text(spark, n, ws, every, chunk):
    tok = spark.createDataFrame([(7, i, f"w{i}") for i in range(n)], "seq long, pos int, word string")
    anchors = tok.where(F.col("pos") % every == 0).select("seq", "pos")
    got = {r["pos"]: r["text"] for r in cx.trailing_text_at(tok, anchors, ws, chunk=chunk).collect()}
    words = [f"w{i}" for i in range(n)]
    assert got == {i: " ".join(words[max(0, i - ws): i + 1]) for i in range(0, n, every)}


@SETTINGS
@given(groups=st_.lists(st_.lists(st_.integers(-5, 5), min_size=1, max_size=30), min_size=1, max_size=3))
def test_exact_quantiles_equal_numpy(spark, groups):
    import numpy as np
    from voxlex.operators import stats as stx
    rows = [(g, float(v) / 4.0) for g, vals in enumerate(groups) for v in vals]
    df = spark.createDataFrame(rows, "g int, corr double")
    got = {r["g"]: r for r in stx.describe_scores(df, "g", "corr").collect()}
    for g, vals in enumerate(groups):
        ref = np.quantile(np.array(vals, dtype=float) / 4.0, [0.25, 0.5, 0.75])
        assert [got[g]["q25"], got[g]["q50"], got[g]["q75"]] == [float(x) for x in ref] or \
            np.allclose([got[g]["q25"], got[g]["q50"], got[g]["q75"]], ref, atol=1e-12)
