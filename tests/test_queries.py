"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import math

import duckdb
import pytest

from fairlead.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    names = sorted(frame.columns)
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(clean(getattr(v, "item", lambda v=v: v)()) for v in r) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    mine, other = QUERIES[name](spark, data).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
