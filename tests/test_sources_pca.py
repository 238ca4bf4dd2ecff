"""File sources/sinks and the PCA operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlex.operators import pca as pc
from voxlex.sources import files


def test_read_transcript_drops_pandas_na_words_and_numbers_lines(spark, tmp_path):
    p = tmp_path / "align.csv"
    p.write_text("Hello,hello,0.0,0.3\nnull,null,0.3,0.5\nnone,none,0.5,0.7\nNA,NA,0.7,0.9\nx,x,,1.0\nend,end,1.0,1.2\n")
    df = files.read_transcript(spark, str(p), block=2)
    rows = sorted((r["pos"], r["word"], r["onset"]) for r in df.collect())
    assert [r[0] for r in rows] == list(range(6))
    kept = files.read_transcript(spark, str(p)).na.drop("any", subset=["word", "onset"])
    assert sorted(r["word"] for r in kept.collect()) == ["end", "hello", "none"]


def test_read_tsv_with_header(spark, tmp_path):
    p = tmp_path / "participants.tsv"
    p.write_text("participant_id\ttask\nsub-001\triver,forest\nsub-002\tcity\n")
    schema = T.StructType([T.StructField("participant_id", T.StringType()), T.StructField("task", T.StringType())])
    df = files.read_tsv(spark, str(p), schema)
    assert [r[0] for r in df.where(F.col("task").contains("forest")).collect()] == ["sub-001"]


def test_partitioned_responses_are_pruned(spark, tmp_path):
    rows = [(s, h, v, t, float(s * 100 + v + t)) for s in (1, 2) for h in ("L", "R") for v in range(3) for t in range(4)]
    df = spark.createDataFrame(rows, "subject int, hemi string, voxel int, tr int, value double")
    path = str(tmp_path / "resp")
    files.save_stage(df, path, partition_by=["subject", "hemi"])
    r = files.read_responses(spark, path, subject=2, hemi="L")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "subject" in plan
    assert r.count() == 12 and {x["subject"] for x in r.collect()} == {2}
    assert files.load_stage(spark, path).count() == len(rows)


def test_mask_reader(spark, tmp_path):
    path = str(tmp_path / "mask")
    spark.createDataFrame([(0, 1.0), (1, 0.0)], "voxel long, mask float").write.parquet(path)
    assert [tuple(r) for r in files.read_mask(spark, path).orderBy("voxel").collect()] == [(0, 1.0), (1, 0.0)]


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + 5.0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "tr int, x array<double>")
    m = pc.pca_fit(df, 3)
    xc = x - x.mean(0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    ratio = s ** 2 / (s ** 2).sum()
    got = [r["ratio"] for r in pc.explained_ratio(m, spark).orderBy("component").collect()]
    assert np.allclose(got, ratio[:3])
    proj = {r["tr"]: r["x"] for r in pc.pca_project(df, m).collect()}
    ref = x @ vt[:3].T                                   # uncentred projection
    for i in range(60):
        assert np.allclose(np.abs(proj[i]), np.abs(ref[i]))
    curve = {r["dims"]: r["explained"] for r in pc.explained_curve(df, 5, 1).collect()}
    assert np.allclose([curve[k] for k in (1, 2, 3, 4)], np.cumsum(ratio)[:4])


def test_load_task_composes_the_task_inputs(spark, tmp_path):
    (tmp_path / "participants.tsv").write_text(
        "participant_id\ttask\nsub-001\triver,forest\nsub-002\tforest\nsub-003\tcity\nsub-004\tforest\n"
        "sub-005\tforestx\nsub-006\tforest\n")
    for sub in ("001", "002", "004", "005", "006"):
        (tmp_path / f"sub-{sub}_task-forest_events.tsv").write_text(f"onset\tduration\n{int(sub) * 1.0}\t1\n9\t1\n")
    (tmp_path / "align.csv").write_text("A,a,0.0,0.4\n<unk>,<unk>,0.4,0.8\nB,,0.8,1.0\nC,c,1.0,1.7\n")
    tok, subs = files.load_task(spark, str(tmp_path / "align.csv"), str(tmp_path / "participants.tsv"),
                                str(tmp_path / "sub-{sub}_task-{task}_events.tsv"), "forest", exclude_ids=["004"])
    assert sorted(r[0] for r in subs.select("subject").collect()) == ["001", "002", "005", "006"]
    rows = sorted((r["pos"], r["word"], r["tr"], r["tr_offset"]) for r in tok.collect())
    # picked subject: third in id order -> 005, first onset 5.0 s; frames floor((5 + t) / 1.5)
    assert rows == [(0, "a", 3, 3), (1, "<|endoftext|>", 3, 3), (2, "c", 4, 4)]


def stim_of(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "tr int, x array<double>").repartition(parts)


@pytest.mark.parametrize("shape", [(300, 60), (25, 90)])
def test_randomised_pca_equals_svd(spark, shape):
    rng = np.random.default_rng(7)
    n, width = shape
    x = rng.normal(size=(n, width)) * (0.8 ** np.arange(width)) @ np.linalg.qr(rng.normal(size=(width, width)))[0] + 3.0
    m = pc.pca_fit(stim_of(spark, x), 12, method="randomised")
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert m.residual <= 1e-9 and m.components.shape == (12, width)
    assert np.allclose(m.variances, s[:12] ** 2 / (n - 1), rtol=1e-8)
    assert m.total == pytest.approx(c.var(0, ddof=1).sum())
    assert np.allclose(np.abs((m.components * vt[:12]).sum(1)), 1.0, atol=1e-7)
    got = {r["tr"]: r["x"] for r in pc.pca_project(stim_of(spark, x), m, keep=5).collect()}
    assert np.allclose([got[i] for i in range(n)], x @ m.components[:5].T)
    ratios = [r["ratio"] for r in pc.explained_ratio(m, spark).orderBy("component").collect()]
    assert np.allclose(ratios, m.variances / m.total)


def test_randomised_pca_edges(spark):
    flat = pc.pca_fit(stim_of(spark, np.ones((5, 4))), 2, method="randomised")
    assert np.allclose(flat.variances, 0.0) and flat.total == pytest.approx(0.0)
    one = pc.pca_fit(stim_of(spark, np.array([[1.0, 2.0, 3.0]])), 3, method="randomised")
    assert len(one.components) == 1 and np.allclose(one.variances, 0.0)
    # flat spectrum: the space grows until it is everything
    x = np.random.default_rng(8).normal(size=(200, 40))
    m = pc.pca_fit_randomised(stim_of(spark, x), 3, oversample=2)
    assert np.allclose(m.variances, np.linalg.eigvalsh(np.cov(x.T))[::-1][:3], rtol=1e-8)


def test_wide_fits_are_randomised(spark, monkeypatch):
    monkeypatch.setattr(pc, "WIDE", 6)
    x = np.random.default_rng(9).normal(size=(20, 6))
    assert isinstance(pc.pca_fit(stim_of(spark, x), 2), pc.PcaModel)
    assert not isinstance(pc.pca_fit(stim_of(spark, x[:, :5]), 2), pc.PcaModel)
