"""Order-bucketed ingest: the same results, and no shuffle of lineitem."""

import __spark_entry__ as E
from ascribe.sources.tables import bucket_by_order


def test_bucketed_tables_give_same_results_without_lineitem_shuffle(spark, sf_dir):
    bucket_by_order(spark, sf_dir, "ascribe_bucketed", 8)
    q = E.queries()["disparity_by_mode"]
    assert sorted(q(spark, sf_dir, "ascribe_bucketed").collect()) == sorted(q(spark, sf_dir).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q(spark, sf_dir, "ascribe_bucketed")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(l_orderkey" not in plan
    assert "hashpartitioning(o_orderkey" in plan          # only the orders/people side moves
