"""Texts cut from folded blocks: same values as plain Python, words shuffled about once."""

from pyspark.sql import functions as F

from voxlex.operators import context as cx


def _tok(spark, docs):
    rows = [(s, i, w, float(i)) for s, ws in docs.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "seq long, pos int, word string, onset double")


DOCS = {1: [f"w{i}" for i in range(9000)], 2: ["one"], 3: ["a\nb", "c", None, "d e", ""] * 20}


def _text(ws, a, n):
    return " ".join(w for w in ws[max(0, a - n):a + 1] if w is not None)


def test_trailing_texts_over_blocks_and_odd_words(spark):
    tok = _tok(spark, DOCS)
    at = tok.where(F.col("pos") % 30 == 0).select("seq", "pos")
    got = {(r.seq, r.pos): r.text for r in cx.trailing_text_at(tok, at, 499).collect()}
    assert got == {(s, a): _text(ws, a, 499) for s, ws in DOCS.items() for a in range(0, len(ws), 30)}


def test_summaries_over_blocks(spark):
    head = cx.HEADER_SUMMARY
    for hold in (False, True):
        got = {(r.seq, r.pos): r.text for r in cx.with_summary(_tok(spark, DOCS), 3, lambda s: s.str[-7:], 50, 30, hold, 99).collect()}
        for s, ws in DOCS.items():
            for i in range(len(ws)):
                a = max(i // 30 * 30, 50)
                summary = _text(ws, a, 99)[-7:] if hold or a == i else ""
                want = _text(ws, i, 3) if i < 50 else head + summary + " : " + _text(ws, i, 3)
                assert got[s, i] == want


def test_continuations_keep_other_columns_and_jvm_functions(spark):
    tok = _tok(spark, DOCS)
    for fn in (cx.identity_generator, cx.ColumnTextFn(lambda c: c)):
        t = cx.with_continuation(tok, 3, fn, 10, 29)
        got = {(r.seq, r.pos): (r.text, r.onset) for r in t.collect()}
        assert got == {(s, i): (_text(ws, i // 10 * 10, 29) + cx.CONTINUATION_JOIN + _text(ws, i, 3), float(i))
                       for s, ws in DOCS.items() for i in range(len(ws))}


def test_words_leave_a_task_folded(spark):
    """No shuffle carries a row per word or a context, and none follows for the summaries."""
    for df in (cx.trailing_text_at(_tok(spark, DOCS), _tok(spark, DOCS).select("seq", "pos"), 29),
               cx.with_summary(_tok(spark, DOCS), 3, cx.digest_text), cx.with_continuation(_tok(spark, DOCS), 3, cx.identity_generator)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
        assert "MapInArrow" in plan.split("Exchange hashpartitioning")[1]


def test_contexts_embedded_in_one_pass(spark):
    from voxlex.operators import embed as em
    tok = _tok(spark, {k: v for k, v in DOCS.items() if None not in v} | {3: ["é", "ß x", "", " "] * 5})
    for model, pool in ((em.HashEmbedder(2), "mean"), (em.HashEmbedder(2), "last"), (em.TextHashEmbedder(2), "last")):
        two = em.embed(cx.context_window(tok, 4, out="text"), "text", model, pool)
        got = {(r.seq, r.pos): r.x for r in em.embed_contexts(tok, 4, model, pool).collect()}
        assert got == {(r.seq, r.pos): r.x for r in two.collect()}


def test_table_of_words_is_bounded():
    from voxlex.operators.embed import HashEmbedder
    m, free = HashEmbedder(2, max_vocab=100), HashEmbedder(2)
    words = [f"v{i}" for i in range(1000)]
    for i in range(0, 1000, 50):
        part = words[i:i + 50]
        assert (m.vectors(part) == free.vectors(part)).all()
    assert HashEmbedder(2).max_vocab <= 100_000


def test_pooling_by_element_is_hashed(spark):
    from voxlex.operators.embed import pool_tokens
    rows = [(s, i // 4, i, [float(s * i), float(i % 3)]) for s in range(3) for i in range(10)]
    df = spark.createDataFrame(rows, "seq long, tr int, pos int, x array<double>")
    for how in ("mean", "last"):
        got = pool_tokens(df, ["seq", "tr"], "pos", "x", how, dim=2)
        assert sorted(got.collect()) == sorted(pool_tokens(df, ["seq", "tr"], "pos", "x", how).collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
