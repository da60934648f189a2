"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from loomspan.plans import registry  # entry imports the families

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{round(x, 4) + 0.0:.4f}"
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    mine = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rows = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert mine == sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
