"""Every registered query against its DuckDB oracle on the smallest tables.

Mirrors the driver's gate: same rows, same column names, same
order-insensitive value hash (floats at 6 digits).
"""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def test_every_query_is_registered_with_an_oracle_or_documented():
    assert set(ORACLES) <= set(QUERIES)
    own = {k for k in QUERIES if not k.startswith("op") and k != "pipeline"}
    assert own - set(ORACLES) == {"pca_sweep", "holdout_chunks_shuffle"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


def test_entry_flagship_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["voxel", "alpha", "corr"]
    assert len(rows) > 0
