"""Sign flips, false discovery rate, the shuffled draw, cumulative summaries."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlex.operators import context as cx
from voxlex.operators import ridge as rg
from voxlex.operators import splits as sp
from voxlex.operators import stats as st


def test_score_parts_sum_to_the_correlation(spark):
    rng = np.random.default_rng(0)
    y, x = rng.normal(size=(3, 30)), rng.normal(size=(3, 30))
    y[2] = 4.0                                             # does not vary
    df = spark.createDataFrame([(v, t, t // 7, float(y[v, t]), float(x[v, t])) for v in range(3) for t in range(30)],
                               "voxel int, tr int, chunk int, y double, x double")
    got: dict = {}
    for r in st.score_parts(df, "voxel", "chunk", "y", "x").collect():
        got.setdefault(r["voxel"], []).append(r["part"])
    assert set(got) == {0, 1} and all(len(v) == 5 for v in got.values())
    for v in (0, 1):
        assert sum(got[v]) == pytest.approx(np.corrcoef(y[v], x[v])[0, 1])


def brute_flips(d, chunks, nperm, seed):
    """hits per row of differences (series x chunks), by loops."""
    signs = [[1 if int(hashlib.md5(f"{seed}|{p}|{c}".encode()).hexdigest()[:8], 16) % 2 == 0 else -1 for c in chunks] for p in range(nperm)]
    return [sum(abs(sum(s * x for s, x in zip(sg, row))) >= abs(sum(row)) - 1e-9 for sg in signs) for row in d]


def brute_q(p):
    order = sorted(range(len(p)), key=lambda i: p[i], reverse=True)
    out, least = [0.0] * len(p), 1.0
    for k, i in enumerate(order):
        least = min(least, p[i] * len(p) / (len(p) - k))
        out[i] = least
    return out


def test_sign_flips_and_q_values_equal_loops(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 12)), rng.normal(size=(40, 12))
    a[:8] += 4.0                                           # better by far
    a[9] = b[9]                                            # no difference at all
    parts = lambda m: spark.createDataFrame([(f"r{v % 2}", v, c, float(m[v, c])) for v in range(40) for c in range(12)],
                                            "run string, voxel int, chunk int, part double")
    tests = st.false_discovery(st.sign_flip_test(parts(a), parts(b), ["run", "voxel"], "chunk", nperm=199, seed=5), "run")
    got = {r["voxel"]: r for r in tests.collect()}
    hits = brute_flips(a - b, range(12), 199, 5)
    for v in range(40):
        assert got[v]["hits"] == hits[v] and got[v]["p"] == pytest.approx((hits[v] + 1) / 200)
        assert got[v]["diff"] == pytest.approx((a[v] - b[v]).sum())
    for run in (0, 1):
        own = [v for v in range(40) if v % 2 == run]
        assert np.allclose([got[v]["q"] for v in own], brute_q([got[v]["p"] for v in own]))
    assert all(got[v]["q"] < 0.05 for v in range(8)) and got[9]["p"] == 1.0
    # a series without some chunks: they differ by nothing
    some = st.sign_flip_test(parts(a).where("chunk < 3"), parts(b).where("chunk < 3"), ["run", "voxel"], "chunk", nperm=50, seed=5)
    assert {r["voxel"]: r["hits"] for r in some.collect()} == dict(enumerate(brute_flips((a - b)[:, :3], range(3), 50, 5)))
    assert st.sign_flip_test(parts(a).limit(0), parts(b).limit(0), ["run", "voxel"], "chunk").collect() == []


def test_shuffled_draw_is_the_seeded_generator(spark):
    rng = random.Random(42)
    want = []
    for _ in range(4):
        order = list(range(13))
        rng.shuffle(order)
        want.append(sorted(order[:2]))
    frames = list(range(83))
    n_train, held = sp.design_indices(frames, 0.2, 5, 4, 2, 42, "shuffle")
    assert n_train == 66 and [sorted({i // 5 for i in h}) for h in held] == want
    df = spark.createDataFrame([(t,) for t in frames], "tr int")
    chunks = sp.chunk_ids(sp.ordered_split(df, "tr", 0.2), 5)
    got: dict = {}
    for r in sp.holdout_chunks(chunks, 4, 2, 42, "shuffle").collect():
        got.setdefault(r["boot"], []).append(r["chunk"])
    assert [sorted(got[b]) for b in range(4)] == want
    with pytest.raises(ValueError):
        sp.holdout_chunks(chunks, 4, 2, 42, "other")
    assert sp.holdout_chunks(chunks.limit(0), 4, 2, 42, "shuffle").collect() == []


def test_all_plans_share_the_shuffled_draw(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(40, 4))
    x_df = spark.createDataFrame([(t, [float(v) for v in r]) for t, r in enumerate(x)], "tr int, x array<double>")
    y_df = spark.createDataFrame([(v, t, float(y[t, v])) for t in range(40) for v in range(4)], "voxel int, tr int, value double")
    out = []
    for draw in ("shuffle", "md5"):
        p = rg.RidgeParams(chunklen=4, nboots=3, draw=draw)
        for plan in ("packed", "additive", "dual"):
            b = rg.boot_scores_long(x_df, y_df, "voxel", p, plan=plan).collect()
            out.append({(r["voxel"], r["boot"], r["alpha_idx"]): r["corr"] for r in b})
    for k in (0, 3):
        assert all(out[k][i] == pytest.approx(out[k + d][i], abs=1e-7) for i in out[k] for d in (1, 2))
    assert any(abs(out[0][i] - out[3][i]) > 1e-6 for i in out[0])


def test_cumulative_summaries_equal_a_loop(spark):
    """Sequences of different lengths, segments that end inside one, sequences side by side."""
    lengths = {1: 130, 2: 20, 3: 21, 4: 64, 5: 5, 6: 91}
    word = lambda s, i: f"w{s}.{i * 7 % 13}"
    tok = spark.createDataFrame([(s, i, word(s, i)) for s, n in lengths.items() for i in range(n)], "seq bigint, pos int, word string")
    want = {}
    for s, n in lengths.items():
        state, done = "", -1
        for a in range(n):
            if a >= 20 and (a % 30 == 0 or a == 20):
                text = cx.HEADER_SUMMARY + state + cx.SUMMARY_PROMPT_JOIN + " ".join(word(s, i) for i in range(done + 1, a + 1))
                state = want[s, a] = hashlib.md5(text.encode()).hexdigest()
                done = a
    for kw in ({}, {"segment": 1}, {"segment": 2, "together": 2}):
        got = {(r["seq"], r["anchor"]): r["summary"] for r in cx.cumulative_summaries(tok, cx.digest_text, **kw).collect()}
        assert got == want
    texts = {(r["seq"], r["pos"]): r["text"] for r in cx.with_cumulative_summary(tok, 2, cx.digest_text).collect()}
    assert len(texts) == sum(lengths.values())
    assert texts[1, 19] == " ".join(word(1, i) for i in (17, 18, 19))
    assert texts[1, 95] == cx.HEADER_SUMMARY + want[1, 90] + " : " + " ".join(word(1, i) for i in (93, 94, 95))
    assert cx.cumulative_summaries(tok.limit(0), cx.digest_text).collect() == []
    # a word far back still counts in every later summary
    other = tok.withColumn("word", F.when((F.col("seq") == 1) & (F.col("pos") == 3), "changed").otherwise(F.col("word")))
    new = {(r["seq"], r["anchor"]): r["summary"] for r in cx.cumulative_summaries(other, cx.digest_text).collect()}
    assert {k for k in want if new[k] != want[k]} == {k for k in want if k[0] == 1}
