"""A key holding a third of all rows: the people join splits it (AQE skew
join) and the statistics stay exact."""

import pandas as pd
import pytest

from ascribe.operators import stats
from ascribe.operators.trials import metric_moments, people
from ascribe.sources.tables import Tables


@pytest.fixture()
def skewed_dir(tmp_path):
    n_orders = 30000
    hot = 7
    cust = pd.DataFrame({"c_custkey": range(100), "c_name": [f"C{i}" for i in range(100)],
                         "c_nationkey": [i % 5 for i in range(100)]})
    o_cust = [hot if i % 3 == 0 else (i * 31) % 100 for i in range(n_orders)]      # 1/3 on one key
    orders = pd.DataFrame({"o_orderkey": range(n_orders), "o_custkey": o_cust})
    li = pd.DataFrame({
        "l_orderkey": [i // 2 for i in range(2 * n_orders)],
        "l_linenumber": [i % 2 + 1 for i in range(2 * n_orders)],
        "l_partkey": [(i * 7) % 500 for i in range(2 * n_orders)],
        "l_suppkey": [(i * 3) % 50 for i in range(2 * n_orders)],
        "l_quantity": [float(1 + i % 50) for i in range(2 * n_orders)],
        "l_extendedprice": [float(1000 + (i * 37) % 9000) for i in range(2 * n_orders)],
        "l_discount": [(i % 11) / 100 for i in range(2 * n_orders)],
        "l_tax": [(i % 9) / 100 for i in range(2 * n_orders)],
        "l_linestatus": ["F" if i % 2 else "O" for i in range(2 * n_orders)],
    })
    nation = pd.DataFrame({"n_nationkey": pd.Series(range(5), dtype="int32"),
                           "n_name": [f"N{i}" for i in range(5)],
                           "n_regionkey": pd.Series([i % 2 for i in range(5)], dtype="int32")})
    region = pd.DataFrame({"r_regionkey": pd.Series([0, 1], dtype="int32"), "r_name": ["R0", "R1"]})
    for name, df in {"customer": cust, "lineitem": li, "nation": nation, "region": region}.items():
        df.to_parquet(tmp_path / f"{name}.parquet")
    # orders as several files -> several map tasks, as on a cluster
    d = tmp_path / "orders.parquet"
    d.mkdir()
    for i in range(8):
        orders.iloc[i::8].to_parquet(d / f"part-{i}.parquet", index=False)
    return str(tmp_path), orders, cust, nation


def test_hot_customer_is_split_and_results_are_exact(spark, skewed_dir):
    path, orders, cust, nation = skewed_dir
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        t = Tables(spark, path)
        ppl = people(t)
        rows = ppl.collect()
        final = ppl._jdf.queryExecution().executedPlan().toString()
        keys = ["gender", "nationality", "mode"]
        got = sorted(stats.stats_from_moments(metric_moments(t, keys), keys).collect())
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "skew=true" in final                       # the hot key partition was split
    assert len(rows) == len(orders)                   # nothing dropped or duplicated
    hot_rows = [r for r in rows if r["c_custkey"] == 7]
    assert len(hot_rows) == int((orders["o_custkey"] == 7).sum())
    assert len(got) > 0
