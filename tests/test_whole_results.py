"""Rows that a query must not lose: empty texts, and the head of a product that is never built."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from ascribe.operators import generate as G
from ascribe.sources.tables import Tables

Q = E.queries()


def _copy(spark, sf_dir, tmp_path, changed):
    for name in ("documents", "conversations", "benchmark", "customer", "nation"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        changed.get(name, lambda d: d)(df).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_documents_without_tokens_keep_their_row(spark, sf_dir, tmp_path):
    cut = F.when(F.col("doc_id") == 3, "").when(F.col("doc_id") == 5, F.lit(None)).otherwise(F.col("text"))
    d = _copy(spark, sf_dir, tmp_path, {"documents": lambda x: x.withColumn("text", cut)})
    got = {r["doc_id"]: r for r in Q["perplexity_docs"](spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    for i in (3, 5):
        assert (got[i]["n_tokens"], got[i]["perplexity"], got[i]["reason"]) == (0, None, "no token")
    assert got[4]["n_tokens"] > 0 and got[4]["reason"] is None


def test_pairs_with_an_empty_or_null_response(spark, sf_dir, tmp_path):
    cut = (F.when((F.col("conv_id") == 0) & (F.col("turn") == 1), "")
           .when((F.col("conv_id") == 0) & (F.col("turn") == 3), F.lit(None)).otherwise(F.col("text")))
    d = _copy(spark, sf_dir, tmp_path, {"conversations": lambda x: x.withColumn("text", cut)})
    own = {r["turn"]: r for r in Q["perplexity_pairs"](spark, d).where("conv_id = 0").collect()}
    assert own[0]["probability"] == 1.0 and own[0]["log_prob"] == 0.0 and own[0]["perplexity"] > 1
    assert 2 not in own


def test_head_is_the_head_of_the_whole_product(spark, sf_dir):
    t = Tables(spark, sf_dir)
    whole = [r["idx"] for r in G.generate_trials(t).select("idx").orderBy("idx").collect()]
    for n in (1, 7, 130, 2000, len(whole) + 5):
        assert [r["idx"] for r in G.head_n(t, n).select("idx").collect()] == whole[:n]


def test_one_trial_of_the_view_gives_one_prompt(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    df = Q["prompt_render"](spark, sf_dir)
    assert df.count() == lines
    assert str(df._jdf.queryExecution().executedPlan()).count("md5(") <= 4


def test_grid_over_all_trials_and_names_over_whole_lists(spark, sf_dir):
    grid = Q["grid_complete_modes"](spark, sf_dir).select("mode", "gender", "nationality").collect()
    assert {r["mode"] for r in grid} == {"Success", "Failure"}
    assert len(grid) == len(set(grid)) == len({r["mode"] for r in grid}) * len({r["gender"] for r in grid}) * len({r["nationality"] for r in grid})
    ords = {}
    for r in Q["name_flatten_whole"](spark, sf_dir).collect():
        ords.setdefault((r["nationality"], r["gender"]), []).append(r["name_ord"])
    assert all(sorted(v) == list(range(len(v))) for v in ords.values()) and sum(map(len, ords.values())) == \
        spark.read.parquet(f"{sf_dir}/customer.parquet").count()
