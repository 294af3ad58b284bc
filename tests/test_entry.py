"""Driver contract: entry(), queries() and the DuckDB oracle for every query."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from cvframe.plans.fixtures import TABLES

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert df.columns[:3] == ["rank", "approach", "mean_f1"]
    assert [r["rank"] for r in rows] == [1, 2, 3]


def test_oracle_keys_subset():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 60


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf_small, name):
    sdf = QUERIES[name](spark, sf_small)
    srows = [r.asDict() for r in sdf.collect()]
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    drows = [dict(zip(cols, r)) for r in res.fetchall()]
    assert sorted(sdf.columns) == sorted(cols)
    c = sorted(cols)
    assert _rows(srows, c) == _rows(drows, c)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    rows = df.collect()
    assert rows
    if "prediction" in df.columns:
        assert {r["prediction"] for r in rows} <= {0, 1}
