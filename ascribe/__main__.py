"""Command line: list the registered queries or run one into a result table.

    python -m ascribe list
    python -m ascribe run disparity_by_mode /root/testdata/sf0.1 /path/out [--format csv|parquet|json]

Results are written by Spark (partitioned by ``mode`` when the result has
one); nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="ascribe")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("sf_dir")
    run.add_argument("out")
    run.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    run.add_argument("--database", default=None, help="catalog database with bucketed copies")
    run.add_argument("--master", default="local[*]")
    a = ap.parse_args(argv)

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from ascribe import plans
    if a.cmd == "list":
        for name, fn in plans.QUERIES.items():
            doc = (fn.__doc__ or "").strip().splitlines()
            print(f"{name:28s} {doc[0] if doc else ''}")
        return 0

    from pyspark.sql import SparkSession

    from ascribe.session import DEFAULT_CONF, ensure_checkpoint_dir
    from ascribe.sources import results as R
    b = SparkSession.builder.master(a.master).appName(f"ascribe-{a.query}")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    df = plans.QUERIES[a.query](spark, a.sf_dir, a.database)
    if a.format == "csv":
        R.to_csv(df, a.out)
    elif a.format == "json":
        R.to_json_lines(df, a.out)
    else:
        R.write_table(df, a.out)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
