"""Rank search, data-driven bins and binned densities against numpy."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlex.operators import stats as st


def table(spark, data):
    return spark.createDataFrame([(g, None if v is None else float(v)) for g, v in data], "run string, corr double").repartition(5)


def test_ordered_bits_keep_order_and_value(spark):
    rng = np.random.default_rng(0)
    v = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, 5e-324, -5e-324, 2.0 ** -1022, np.nextafter(2.0 ** -1022, 0),
         1.7976931348623157e308, np.nextafter(1.0, 0), np.nextafter(1.0, 2)]
    v += [struct.unpack("d", struct.pack("q", int(x)))[0] for x in rng.integers(-2**63, 2**63 - 1, 3000)]
    v += [s * m * 2.0 ** e for e in range(-1074, 1024, 7) for s in (1, -1) for m in (1.0, np.nextafter(1, 2))]
    v += [np.nextafter(2.0 ** e, 0) for e in range(-1000, 1023, 11)]
    v = [float(x) for x in v if not math.isnan(x)]
    rows = (spark.createDataFrame([(x,) for x in v], "v double").select("v", st.ordered_bits(F.col("v")).alias("b"))
            .select("v", "b", st.double_of(F.col("b")).alias("w")).collect())
    for r in rows:
        assert r["w"] == r["v"]
        assert abs(r["b"]) == struct.unpack("q", struct.pack("d", abs(r["v"])))[0]
    assert [r["v"] for r in sorted(rows, key=lambda r: r["b"])] == sorted(v)


@pytest.mark.parametrize("few, choices", [(4096, 20_000), (3, 20_000), (1, 2)])
def test_quantiles_equal_numpy(spark, monkeypatch, few, choices):
    monkeypatch.setattr(st, "FEW", few)
    monkeypatch.setattr(st, "MAX_CHOICES", choices)
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=501), "ties": np.repeat([0.0, 1.5], [400, 3]), "one": np.array([2.0]),
              "two": np.array([1.0, 4.0]), "close": 1.0 + rng.integers(0, 40, 300) * 2.0 ** -50,
              "signs": np.concatenate([-(10.0 ** rng.uniform(-300, 300, 100)), 10.0 ** rng.uniform(-300, 300, 101)])}
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("normal", None), ("ties", math.nan), (None, 3.0)]
    qs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {r["run"]: [r[f"q{i}"] for i in range(len(qs))] for r in st.exact_quantiles(table(spark, data), "run", "corr", qs).collect()}
    assert got.keys() == groups.keys() | {None}
    assert got[None] == [3.0] * len(qs)
    for g, v in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(v, qs)), rel=1e-12), g
    whole = st.exact_quantiles(table(spark, data).where("run = 'normal'"), None, "corr", (0.5,)).first()
    assert whole["q0"] == pytest.approx(np.median(groups["normal"]))
    assert st.exact_quantiles(table(spark, data).limit(0), "run", "corr", (0.5,)).collect() == []


def test_describe_has_no_sort_of_rows(spark, capsys):
    """Rows are counted, never sorted or dealt out by value."""
    df = table(spark, [("a", i % 3) for i in range(50)])
    st.describe_scores(df, "run").explain("formatted")
    plan = capsys.readouterr().out
    assert "rangepartitioning" not in plan.lower() and "Sort" not in plan


def test_bins_follow_the_data(spark):
    rng = np.random.default_rng(2)
    for v in (rng.normal(size=400), rng.exponential(size=37), np.repeat([0.0, 0.0, 0.0, 5.0], 10), np.array([1.0, 2.0]),
              np.full(6, 3.0)):
        edges = np.histogram_bin_edges(v, "auto")
        lo, hi, n = st.histogram_bins(table(spark, [("a", x) for x in v]))
        assert (lo, hi) == (v.min(), v.max()) and n == len(edges) - 1
    v = rng.normal(size=300)
    counts, _ = np.histogram(v, "auto")
    got = {r["bin"]: r["n"] for r in st.histogram_auto(table(spark, [("a", x) for x in v]), "run").collect()}
    assert [got.get(i, 0) for i in range(len(counts))] == counts.tolist()
    assert st.histogram_bins(table(spark, [("a", None)])) == (0.0, 1.0, 1)


def test_binned_density_is_within_its_bound(spark):
    rng = np.random.default_rng(3)
    data = [("a", x) for x in rng.normal(size=300)] + [("b", x) for x in np.concatenate([rng.normal(size=50), [40.0]])]
    data += [("flat", 1.0)] * 5 + [("a", None)]
    df = table(spark, data)
    key = lambda d: {(r["run"], r["k"]): (r["x"], r["density"]) for r in d.collect()}
    fast, slow = key(st.kde(df, "run", grid=60)), key(st.kde(df, "run", grid=60, exact=True))
    assert fast.keys() == slow.keys() and {g for g, _ in fast} == {"a", "b"}
    for g in ("a", "b"):
        v = np.array([x for r, x in data if r == g and x is not None])
        h = v.std(ddof=1) * len(v) ** -0.2
        for k in range(60):
            (x, a), (y, b) = fast[g, k], slow[g, k]
            assert x == y and abs(a - b) <= (st.kde_error() + 1e-14) / h
            assert b == pytest.approx(np.exp(-0.5 * ((x - v) / h) ** 2).mean() / (h * math.sqrt(2 * math.pi)), abs=1e-12)
    assert 0 < st.kde_error() < 1e-14
