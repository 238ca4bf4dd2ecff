"""Findings of round 4: whole prompts, packed transcripts, texts embedded where they are made, folded summaries."""

import glob
import hashlib
from functools import partial

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxlex import session
from voxlex.operators import context as cx
from voxlex.operators import frames as fr
from voxlex.operators.embed import HashEmbedder, TextHashEmbedder
from voxlex.plans import analyses as an
from voxlex.sources import files


def _documents(spark, path, texts):
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_every_word_has_its_prompt(spark, tmp_path):
    texts = {1: " ".join(f"a{i}" for i in range(47)), 2: "one two", 3: "alone"}
    d = _documents(spark, tmp_path, texts)
    got = {(r["seq"], r["pos"]): r["prompt"] for r in entry.queries()["prompt_30"](spark, d).collect()}
    words = {s: t.split(" ") for s, t in texts.items()}
    assert got == {(s, i): " ".join(w[max(0, i - 29):i + 1]) for s, w in words.items() for i in range(len(w))}


ODD = ['say "hi"', "a, b", "NA", "None", "", None, "\x01x", "#c", "ü\u00a0", "'q'", "back\\slash", "null"]


def test_many_transcripts_in_few_files(spark, tmp_path):
    """A file holds many sequences, not one; odd words, missing numbers and repeated rows come back, numbered as they lie."""
    rows = [(s, i, w, w, None if i % 4 == 1 else i * 0.5, i + 0.25) for s in (*range(200), None) for i, w in enumerate(ODD)]
    rows += [r for r in rows if r[0] == 7]
    df = spark.createDataFrame(rows, "seq bigint, pos int, word_orig string, word string, onset double, offset double")
    path = str(tmp_path / "t")
    files.write_transcripts(df.repartition(3, "seq").sortWithinPartitions("seq", "pos"), path)
    assert len(glob.glob(f"{path}/*.csv.gz")) <= 3
    got = files.read_transcript(spark, path, seq_type="bigint")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in got.collect():
        by.setdefault(r["seq"], []).append((r["pos"], r["word_orig"], r["word"], r["onset"], r["offset"]))
    clean = lambda w: None if w in files.PANDAS_NA_TOKENS else w
    assert len(by) == 201
    for s, lines in by.items():
        many = 2 if s == 7 else 1
        want = [(clean(w), clean(w), None if i % 4 == 1 else i * 0.5, i + 0.25) for i, w in enumerate(ODD) for _ in range(many)]
        assert sorted(lines, key=lambda x: x[0]) == [(i, *x) for i, x in enumerate(want)]


def test_rows_in_order_are_numbered_where_they_lie(spark):
    """Groups that come back, rows dropped before, a filter behind that must not pass the numbering."""
    rows = [(s, i, None if i % 5 == 2 else "w", i) for s in (3, None, 1, 3) for i in range(40)]
    df = spark.createDataFrame(rows, "seq int, pos int, word string, n int").coalesce(1)
    kept = fr.drop_incomplete(df, ["word"], in_order=True)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    want, seen = [], {}
    for s, _, w, n in rows:
        if w:
            want.append((s, seen.get(s, 0), n))
            seen[s] = seen.get(s, 0) + 1
    assert [(r["seq"], r["pos"], r["n"]) for r in kept.collect()] == want
    assert [(r["seq"], r["pos"], r["n"]) for r in kept.where(F.col("n") > 30).collect()] == [x for x in want if x[2] > 30]


def test_load_task_of_packed_files(spark, tmp_path):
    (tmp_path / "people.tsv").write_text("participant_id\ttask\n" + "".join(f"sub-00{i}\tforest\n" for i in (1, 2, 4, 5)))
    (tmp_path / "events.tsv").write_text("sub\tonset\n005\t5.0\n004\t4.0\n005\t9.0\n001\t1.0\n")
    (tmp_path / "text.csv").write_text("7,A,a,0.0,0.4\n7,<unk>,<unk>,0.4,0.8\n7,B,,0.8,1.0\n7,C,c,1.0,1.7\n9,D,d,0.0,0.1\n")
    tok, _ = files.load_task(spark, *(str(tmp_path / n) for n in ("text.csv", "people.tsv", "events.tsv")), "forest", ["004"],
                             seq_type="bigint", events_of_all=True)
    rows = sorted((r["seq"], r["pos"], r["word"], r["tr"], r["tr_offset"]) for r in tok.collect())
    assert rows == [(7, 0, "a", 3, 3), (7, 1, "<|endoftext|>", 3, 3), (7, 2, "c", 4, 4), (9, 0, "d", 3, 3)]


def test_texts_embedded_where_they_are_made(spark):
    """The stimulus of generated texts and that of the contexts equal those of stored ones: both poolings, additive
    and other models, odd and missing words, rows before the first summary, texts that are not generated."""
    docs = {1: [f"w{i % 37}" for i in range(700)], 2: ["one"], 3: ["a\tb", "c", None, "d e", "", "f"] * 12, None: ["n"] * 45}
    tok = spark.createDataFrame([(s, i, w, i // 4) for s, ws in docs.items() for i, w in enumerate(ws)],
                                "seq bigint, pos int, word string, tr int")
    short = lambda s: s.where(s.str.len() < 300, None).str[-9:]
    for make in (partial(an.continuation_text, generator=cx.identity_generator, every=10),
                 partial(an.continuation_text, generator=lambda s: s.where(s.str.len() % 2 == 0, None), every=7),
                 partial(an.summary_text, summarizer=cx.digest_text), partial(an.summary_text, summarizer=short, hold=True)):
        for model in (HashEmbedder(2), HashEmbedder(2, fused=False), TextHashEmbedder(3)):
            for pool, other in (("mean", "last"), ("last", "mean")):
                both = make(tok, 5, frames=("tr", model, pool, other, 5)).collect()
                for of, want in enumerate((an.stimulus(tok, 5, model, pool, text=make(tok, 5)), an.stimulus(tok, 5, model, other))):
                    want = {r["tr"]: r["x"] for r in want.collect()}
                    got = {r["tr"]: r["x_0"] for r in both if r["_of"] == of}
                    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_no_text_leaves_the_task_that_embeds_it(spark):
    tok = spark.createDataFrame([(1, 0, "a", 0)], "seq bigint, pos int, word string, tr int")
    x = an.summary_text(tok, 5, frames=("tr", TextHashEmbedder(2), "last", "mean", 5))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning(seq") == 1


def test_pooled_text_vectors_equal_the_means_of_tokens():
    texts = [" ".join(f"w{j}" for j in range(max(0, i - 6), i + 1)) for i in range(40)] + ["a\tb  c", "", "x "]
    for model in (TextHashEmbedder(1), TextHashEmbedder(3)):
        mats = model.encode(texts)
        assert np.allclose(model.encode_pooled(texts, "mean"), [a.mean(axis=0) for a in mats])
        assert np.allclose(model.encode_pooled(texts, "last"), [a[-1] for a in mats])


def test_words_of_first_segments_are_not_written(spark, monkeypatch):
    """Summaries by a loop, sequences that end in the first segment or go on; the stage of pieces has only later words."""
    lengths = {1: 200, 2: 61, 3: 20, None: 95}
    tok = spark.createDataFrame([(s, i, f"w{i % 7}") for s, n in lengths.items() for i in range(n)], "seq bigint, pos int, word string")
    want = {}
    for s, n in lengths.items():
        state, done = "", -1
        for a in (a for a in range(n) if a == 20 or a > 20 and a % 30 == 0):
            text = cx.HEADER_SUMMARY + state + cx.SUMMARY_PROMPT_JOIN + " ".join(f"w{i % 7}" for i in range(done + 1, a + 1))
            state = want[s, a] = hashlib.md5(text.encode()).hexdigest()
            done = a
    folders = []
    made = session.stage_folder
    monkeypatch.setattr(session, "stage_folder", lambda *a: folders.append(made(*a)) or folders[-1])
    monkeypatch.setattr(session, "cut_lineage", None)
    got = cx.cumulative_summaries(tok, cx.digest_text, segment=2)
    wanted = {k: v for k, v in want.items() if k[0] is not None}
    assert {(r["seq"], r["anchor"]): r["summary"] for r in got.where("seq is not null").collect()} == wanted
    stage = spark.read.parquet(folders[0] + "/table").where("words is not null")
    assert stage.agg(F.min("anchor")).first()[0] == 60 and len(folders) == 4
    assert len(cx.cumulative_summaries(tok, cx.digest_text).collect()) == len(want) and len(folders) == 5
    assert spark.read.parquet(folders[4] + "/table").where("words is not null").count() == 0
