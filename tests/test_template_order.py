"""Filled texts of one template stand side by side in what a task writes, so that a file of them compresses."""

import glob

import pandas as pd
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E

N_ITEMS, N_ORDERS = 6, 400


@pytest.fixture(scope="module")
def trial_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("template-order")
    orders = list(range(N_ORDERS))
    lines = [(k, 1 + i) for k in orders for i in range(3)]
    tables = {
        "region": {"r_regionkey": [0], "r_name": ["ASIA"]},
        "nation": {"n_nationkey": [0], "n_name": ["NATION_0"], "n_regionkey": [0]},
        "customer": {"c_custkey": orders, "c_name": [f"Name {k * 7919 % 9973}" for k in orders], "c_nationkey": [0] * N_ORDERS},
        "orders": {"o_orderkey": orders, "o_custkey": orders},
        "lineitem": {"l_orderkey": [k for k, _ in lines], "l_linenumber": [i for _, i in lines],
                     "l_partkey": [k * 5 + i * 3 for k, i in lines], "l_suppkey": [k % 4 for k, _ in lines],
                     "l_quantity": [1.0] * len(lines), "l_extendedprice": [100.0] * len(lines), "l_discount": [0.1] * len(lines),
                     "l_tax": [0.1] * len(lines), "l_linestatus": ["FO"[i % 2] for _, i in lines]},
        "benchmark": {"item_id": list(range(N_ITEMS)), "text": [f"item {i} tells a story of its own." for i in range(N_ITEMS)]},
    }
    for name, cols in tables.items():
        pd.DataFrame(cols).to_parquet(d / f"{name}.parquet", index=False)
    return str(d)


@pytest.mark.parametrize("name", ["prompt_render", "template_fill2", "template_fill", "generated_responses"])
def test_each_file_holds_a_template_in_one_run(spark, trial_dir, tmp_path, name):
    E.queries()[name](spark, trial_dir).write.parquet(f"{tmp_path}/out")
    rows = 0
    for f in glob.glob(f"{tmp_path}/out/*.parquet"):
        drawn = [k % N_ITEMS for k in pq.read_table(f)["l_partkey"].to_pylist()]
        assert sum(a != b for a, b in zip(drawn, drawn[1:])) == max(len(set(drawn)) - 1, 0)
        rows += len(drawn)
    assert rows == 3 * N_ORDERS
