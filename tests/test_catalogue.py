"""Every query with SQL against DuckDB on the smallest driver tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from tidewheel.plans.catalogue import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame):
    import pandas as pd

    plain = lambda v: None if pd.isna(v) else f"{v + 0.0:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got) == sorted(want)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(p == q or math.isclose(float(p), float(q), rel_tol=1e-6, abs_tol=2e-6) for p, q in zip(x, y) if p != q), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_type", "hour", "value", "residual", "others"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
