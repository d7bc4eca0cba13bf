"""Shared DuckDB SQL fragments for the oracle queries.

``TRIALS`` is the SQL twin of ``ascribe.operators.trials.trials``: the same
arithmetic, evaluated independently by DuckDB over the same parquet views.
"""

from __future__ import annotations

from ..schemas import OPTION_KEYS


def _key_case(mode: str, ord_: str) -> str:
    parts = []
    for m, keys in OPTION_KEYS.items():
        for i, k in enumerate(keys, start=1):
            parts.append(f"WHEN {mode} = '{m}' AND {ord_} = {i} THEN '{k}'")
    return "CASE " + " ".join(parts) + " END"


KEY_CASE = _key_case

TRIAL_LINES = """
tl0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_partkey % 15 AS template_id,
         CASE l_linestatus WHEN 'F' THEN 'Failure' WHEN 'O' THEN 'Success' END AS mode,
         nullif(l_quantity, CAST('nan' AS DOUBLE)) AS s1, nullif(l_extendedprice, CAST('nan' AS DOUBLE)) / 2000.0 AS s2,
         1.0 + 250.0 * nullif(l_discount, CAST('nan' AS DOUBLE)) AS s3, 1.0 + 300.0 * nullif(l_tax, CAST('nan' AS DOUBLE)) AS s4
  FROM lineitem
),
tlc AS (
  SELECT *,
    CAST(floor(s1 / (s1 + s2 + s3 + s4) * 100.0 + 0.5) AS BIGINT) AS c1,
    CAST(floor(s2 / (s1 + s2 + s3 + s4) * 100.0 + 0.5) AS BIGINT) AS c2,
    CAST(floor(s3 / (s1 + s2 + s3 + s4) * 100.0 + 0.5) AS BIGINT) AS c3,
    CAST(floor(s4 / (s1 + s2 + s3 + s4) * 100.0 + 0.5) AS BIGINT) AS c4
  FROM tl0
),
tl1 AS (
  SELECT *, c1 / CAST(100 AS DOUBLE) AS p1, c2 / CAST(100 AS DOUBLE) AS p2,
         c3 / CAST(100 AS DOUBLE) AS p3, c4 / CAST(100 AS DOUBLE) AS p4,
    CASE WHEN s1 IS NULL OR s2 IS NULL OR s3 IS NULL OR s4 IS NULL THEN NULL
         WHEN s1 >= s2 AND s1 >= s3 AND s1 >= s4 THEN 1
         WHEN s2 >= s3 AND s2 >= s4 THEN 2
         WHEN s3 >= s4 THEN 3 ELSE 4 END AS chosen_ord
  FROM tlc
),
tl AS (SELECT *, p1 + p2 - p3 - p4 AS metric, c1 + c2 - c3 - c4 AS metric_c FROM tl1)
"""

PEOPLE = """
people AS (
  SELECT o.o_orderkey, c.c_custkey, c.c_name AS name,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
         n.n_name AS nationality, r.r_name AS region
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)
"""

TRIALS_ONLY = f"""
trials AS (
  SELECT tl.*, people.c_custkey, people.name, people.gender, people.nationality, people.region,
         {_key_case('tl.mode', 'tl.chosen_ord')} AS chosen_key
  FROM tl JOIN people ON tl.l_orderkey = people.o_orderkey
)
"""

TRIALS = TRIAL_LINES + "," + PEOPLE + "," + TRIALS_ONLY


def with_trials(body: str, extra: str = "") -> str:
    """``WITH <trial CTEs>[, extra] <body>``."""
    ctes = TRIALS + ("," + extra if extra else "")
    return f"WITH {ctes}\n{body}"


def rnd(expr: str, places: int = 6) -> str:
    """SQL twin of ``registry.round_half_away``."""
    m = f"CAST({10 ** places} AS DOUBLE)"
    e = f"({expr})"
    return (f"(CASE WHEN isnan({e}) OR isinf({e}) THEN {e} WHEN {e} < 0 "
            f"THEN (0 - floor(0.0 - {e} * {m} + 0.5)) / {m} "
            f"ELSE floor({e} * {m} + 0.5) / {m} END)")


def r6(expr: str, alias: str, places: int = 6) -> str:
    return f"{rnd(expr, places)} AS {alias}"


def mean_c(col: str, scale: float = 100.0) -> str:
    """SQL twin of ``stats.exact_mean``: exact integer sum, then two divisions."""
    return f"(CAST(sum({col}) AS DOUBLE) / count({col}) / CAST({scale} AS DOUBLE))"


def std_c(col: str, scale: float = 100.0) -> str:
    """SQL twin of ``stats.exact_std``: sample std from exact integer moments."""
    num = f"CAST(CAST(count({col}) AS HUGEINT) * sum({col} * {col}) - CAST(sum({col}) AS HUGEINT) * sum({col}) AS DOUBLE)"
    return (f"(CASE WHEN count({col}) > 1 THEN sqrt({num} / (CAST(count({col}) AS DOUBLE) * (count({col}) - 1))) "
            f"/ CAST({scale} AS DOUBLE) END)")
