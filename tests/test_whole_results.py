"""Nothing is cut, capped or left behind: halos, masks, histograms, summaries,
quoted transcripts, caches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from voxlex import session
from voxlex.operators import context as cx
from voxlex.operators import series as se
from voxlex.operators import stats as st
from voxlex.operators.embed import HashEmbedder, TextHashEmbedder, embed, frame_embedding
from voxlex.plans import analyses as an
from voxlex.sources import files


def words(spark, n):
    return spark.createDataFrame([(1, i, f"w{i}", i // 3) for i in range(n)], "seq int, pos int, word string, tr int")


@pytest.mark.parametrize("block", [2, 5, 7])
def test_halo_reaches_over_several_blocks(spark, block):
    got = {r["pos"]: r["c"] for r in cx.context_windows(words(spark, 40), {"c": 12}, block=block).collect()}
    assert got == {i: " ".join(f"w{j}" for j in range(max(0, i - 12), i + 1)) for i in range(40)}


def test_mask_keeps_every_place(spark):
    stat = spark.createDataFrame([(0, 0.5), (1, 0.25)], "voxel int, corr double")
    mask = spark.createDataFrame([(0, 1.0)], "voxel int, mask double")
    assert {r["voxel"]: r["corr"] for r in se.apply_mask(stat, mask).collect()} == {0: 0.5, 1: 0.0}


def test_histogram_covers_all_values(spark):
    df = spark.createDataFrame([(-3.0,), (0.5,), (0.9,), (2.0,), (None,)], "corr double")
    rows = st.histogram(df, None, "corr", 10).collect()
    assert sum(r["n"] for r in rows) == 4 and sum(r["prob"] for r in rows) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        st.histogram(df, None, "corr", 10, -1.0, 1.0)
    flat = spark.createDataFrame([(0.5,), (0.5,)], "corr double")
    assert [r["n"] for r in st.histogram(flat, None, "corr", 4).collect()] == [2]
    assert st.histogram(flat.limit(0), None, "corr", 4).collect() == []


def test_pca_sizes_beyond_the_stimulus_are_refused(spark):
    x = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "tr int, x array<double>")
    with pytest.raises(ValueError):
        an.pca_sweep(x, spark.createDataFrame([(0, 0, 1.0)], "voxel int, tr int, value double"), (2, 16))


def test_packed_series_fill_every_gap(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 7, None), ("b", 9, 2.0)], "voxel string, tr int, value double")
    got = {r["voxel"]: r["y"] for r in se.pack_series(df, ["voxel"], frames=[1, 2, 5, 7, 9], fill=-1.0).collect()}
    assert got == {"a": [-1.0, 1.0, -1.0, -1.0, -1.0], "b": [-1.0, -1.0, -1.0, -1.0, 2.0]}


def test_every_word_of_the_summarised_text_counts(spark):
    """Changing word 400 changes the summary at 450, and with it the stimulus."""
    tok = words(spark, 520)
    other = tok.withColumn("word", F.when(F.col("pos") == 400, F.lit("changed")).otherwise(F.col("word")))
    a, b = ({r["pos"]: r["text"] for r in an.summary_text(t, 4).collect()} for t in (tok, other))
    assert a[450] != b[450] and a[390] == b[390] and a[455] == b[455]
    xs = []
    for t in (tok, other):
        e = embed(an.summary_text(t, 4).join(tok.select("seq", "pos"), ["seq", "pos"]), "text", TextHashEmbedder(2), "last")
        xs.append({r["tr"]: r["x"] for r in frame_embedding(e.select("tr", "x"), "tr", "x", 2).collect()})
    changed = {t for t in xs[0] if not np.allclose(xs[0][t], xs[1][t])}
    assert 150 in changed and changed <= {133, 134, 140, 150, 160, 170}


def test_text_path_equals_the_fused_path(spark):
    tok = words(spark, 60)
    fused = {r["tr"]: r["x"] for r in an.stimulus(tok, 5, HashEmbedder(3)).collect()}
    text = {r["tr"]: r["x"] for r in an.stimulus(tok, 5, HashEmbedder(3, fused=False)).collect()}
    assert fused.keys() == text.keys() and all(np.allclose(fused[k], text[k]) for k in fused)
    many = an.stimuli(tok, (0, 5), HashEmbedder(3, fused=False))
    assert all(np.allclose(r["x"], text[r["tr"]]) for r in many[5].collect())


def test_streamed_contexts_equal_stored_ones(spark):
    """Blocks, halos, gaps, missing words, batches that end inside a block, both poolings."""
    from voxlex.operators.context import context_windows
    from voxlex.operators.embed import frame_contexts, frame_embeddings
    tok = words(spark, 75).unionByName(words(spark, 33).withColumn("seq", F.col("seq") + 1))
    tok = tok.withColumn("word", F.when(F.col("pos") % 11 == 4, F.lit(None)).when(F.col("pos") == 9, "odd\tword").otherwise(F.col("word")))
    for pool in ("mean", "last"):
        model, sizes = TextHashEmbedder(3), (0, 2, 7)
        got = {r["tr"]: r for r in frame_contexts(tok, sizes, model, pool, block=16, batch=5).collect()}
        t = context_windows(tok, {f"c_{ws}": ws for ws in sizes})
        for ws in sizes:
            t = embed(t, f"c_{ws}", model, pool, out=f"x_{ws}")
        for r in frame_embeddings(t, "tr", [f"x_{ws}" for ws in sizes]).collect():
            for ws in sizes:
                assert np.allclose(r[f"x_{ws}"], got[r["tr"]][f"x_{ws}"]), (pool, ws, r["tr"])
    assert frame_contexts(tok.limit(0), (1,), TextHashEmbedder(2)).collect() == []


def test_transcript_quotes_and_missing_markers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"say ""hi""","say ""hi""",0.1,0.2\n"a, b",None,0.3,0.4\nx,NA,0.5,0.6\n')
    got = files.read_transcript(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["word_orig"], r["word"]) for r in got] == [('say "hi"', 'say "hi"'), ("a, b", "None"), ("x", None)]


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Fake:
        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getConf = staticmethod(lambda: Conf)

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)
        conf = Conf

    Fake.sparkContext._jsc.sc = staticmethod(lambda: Fake.sparkContext._jsc)
    Fake.sparkContext._jsc.getCheckpointDir = staticmethod(
        lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))
    with pytest.raises(ValueError):
        session.checkpoint_dir(Fake)


@pytest.mark.parametrize("name", ["encode_baseline_k2", "compare_windows_k2", "summary_vs_baseline", "pca_sweep",
                                  "intersubject_k2", "pooling_compare", "alpha_per_group_k2"])
def test_no_query_leaves_a_cache(spark, name):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    entry.queries()[name](spark, SF_SMALL).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_full_width_queries_read_every_stimulus_element(spark):
    from voxlex.plans.queries import QUERIES
    for name in ("xty_64", "scale_rows_64", "scale_cols_64"):
        assert {r.j for r in QUERIES[name](spark, SF_SMALL).select("j").distinct().collect()} == set(range(64))
    runs = {f"f{j:02d}" for j in range(64)}
    for name in ("series_corr_64", "score_diff_64", "describe_scores_64", "over_under_64"):
        assert {r.run for r in QUERIES[name](spark, SF_SMALL).select("run").distinct().collect()} == runs
    assert {f"x{j}" for j in range(64)} < set(QUERIES["align_frames_64"](spark, SF_SMALL).columns)
