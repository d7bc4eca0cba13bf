"""Queries on trial scores against their SQL twins when scores are NULL or NaN, and fresh reads of grown tables."""

import math
import shutil

import duckdb
import pytest

import __spark_entry__ as E
from ascribe.sources.tables import TABLES, Tables

AFFECTED = ["disparity_by_mode", "mean_by_gender", "grid_complete", "means_grouping_sets", "slice_stats", "gender_gap",
            "choice_counts", "choose_option", "quartiles_of_means", "letter_to_key", "actor_choice", "choice_rows"]


@pytest.fixture(scope="module")
def holed(sf_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("holed")
    for t in TABLES:
        if t != "lineitem":
            shutil.copy(f"{sf_dir}/{t}.parquet", d / f"{t}.parquet")
    duckdb.sql(f"""COPY (SELECT * REPLACE (
        CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
        CASE WHEN l_orderkey % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE l_tax END AS l_tax)
        FROM '{sf_dir}/lineitem.parquet') TO '{d}/lineitem.parquet' (FORMAT parquet)""")
    return str(d)


@pytest.mark.parametrize("name", AFFECTED)
def test_null_scores_match_oracle(spark, holed, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{holed}/{t}.parquet')")
    df = E.queries()[name](spark, holed)
    rel = con.sql(E.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)

    def norm(rows, names):
        at = [names.index(c) for c in cols]
        return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) and not math.isnan(r[i]) else str(r[i]) for i in at) for r in rows)
    assert norm(df.collect(), df.columns) == norm(rel.fetchall(), rel.columns)


def test_appended_files_are_read(spark, tmp_path):
    spark.range(600).selectExpr("id doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    assert Tables(spark, str(tmp_path)).documents.count() == 600
    spark.range(400).selectExpr("id doc_id").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert Tables(spark, str(tmp_path)).documents.count() == 1000


def test_second_resume_adds_nothing(spark, tmp_path):
    from ascribe.streaming.runs import resume_stream
    src, run = str(tmp_path / "work"), str(tmp_path / "run")
    spark.range(20).write.parquet(src)
    ledger = spark.range(5)
    assert resume_stream(spark, src, ledger, ["id"], run=run).count() == 15
    assert resume_stream(spark, src, ledger, ["id"], run=run).count() == 15
    spark.range(20, 24).write.mode("append").parquet(src)
    assert resume_stream(spark, src, ledger, ["id"], run=run).count() == 19
