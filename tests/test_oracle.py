"""Every registered query against its DuckDB SQL twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from ascribe.sources.tables import TABLES

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isinf(v) or math.isnan(v):
            return str(v)
        return f"{round(v, 6) + 0.0:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_listed():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 50


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["gender", "nationality", "mode", "mean", "std"]
    assert len(rows) > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_dir, con, name):
    sdf = QUERIES[name](spark, sf_dir)
    srows = sdf.collect()
    rel = con.sql(ORACLE[name])
    dcols, drows = rel.columns, rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    si = [sdf.columns.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    s = sorted(tuple(_norm(r[i]) for i in si) for r in srows)
    d = sorted(tuple(_norm(r[i]) for i in di) for r in drows)
    assert len(s) == len(d)
    assert s == d
