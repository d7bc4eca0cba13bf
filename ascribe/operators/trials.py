"""Trial view derived from the driver's TPC-H-like tables.

The driver ships no model-scored trial table, so one is derived with the same
arithmetic in Spark and in the DuckDB oracle (``ascribe.plans.sql.TRIALS``):

* one trial per lineitem; key ``(l_orderkey, l_linenumber, l_partkey, l_suppkey)``
* ``template_id = l_partkey % 15``; ``mode`` from ``l_linestatus`` (F/O)
* ``gender`` from the customer key parity, ``nationality = n_name``,
  ``region = r_name``, ``name = c_name``
* raw option scores ``s1..s4`` from quantity, price, discount and tax; option
  probabilities ``p_i = floor(s_i/sum*100 + .5)/100``
* ``chosen_ord`` = first argmax of the raw scores, ``metric = p1+p2-p3-p4``

Join order is chosen for scale: ``orders`` joins ``customer`` first (orders is
4x smaller than lineitem), nation/region are joined as their measured size
allows, and only then is lineitem shuffled once on ``l_orderkey``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_key
from ..schemas import OPTION_KEYS, ROLES
from ..sources.tables import Tables

TRIAL_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
N_TEMPLATES = 15


def mode_of(linestatus: Column) -> Column:
    return F.when(linestatus == "F", "Failure").when(linestatus == "O", "Success")


def gender_of(custkey: Column) -> Column:
    return F.when(custkey % 2 == 0, F.lit("male")).otherwise(F.lit("female"))


def option_key(mode: Column, ordinal: Column) -> Column:
    """Mode-specific option key name for ordinal 1..4."""
    e = None
    for m, keys in OPTION_KEYS.items():
        for i, k in enumerate(keys, start=1):
            cond = (mode == m) & (ordinal == i)
            e = F.when(cond, k) if e is None else e.when(cond, k)
    return e


def role_of(ordinal: Column) -> Column:
    return F.when(ordinal <= 2, ROLES[0]).otherwise(ROLES[2])


def first_argmax(*xs: Column) -> Column:
    """1-based position of the first maximum (first wins on ties); NULL when
    any score is NULL: such a trial is a failed row and chooses nothing."""
    n = len(xs)
    e = None
    for i in range(n - 1):
        cond = None
        for j in range(i + 1, n):
            c = xs[i] >= xs[j]
            cond = c if cond is None else cond & c
        e = F.when(cond, i + 1) if e is None else e.when(cond, i + 1)
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, e.otherwise(n))


def trial_id(prefix: str = "") -> Column:
    return F.concat_ws("|", *[F.col(prefix + c).cast("string") for c in TRIAL_KEY])


def trial_lines(t: Tables) -> DataFrame:
    """Per-lineitem part of the trial view (no join)."""
    li = t.lineitem.select(*TRIAL_KEY, "l_quantity", "l_extendedprice", "l_discount",
                           "l_tax", "l_linestatus")
    def score(name: str) -> Column:                    # NaN is a missing score, like NULL
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    s1 = score("l_quantity")
    s2 = score("l_extendedprice") / 2000.0
    s3 = 1.0 + 250.0 * score("l_discount")
    s4 = 1.0 + 300.0 * score("l_tax")
    li = li.select(*TRIAL_KEY,
                   (F.col("l_partkey") % N_TEMPLATES).alias("template_id"),
                   mode_of(F.col("l_linestatus")).alias("mode"),
                   s1.alias("s1"), s2.alias("s2"), s3.alias("s3"), s4.alias("s4"))
    tot = F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")
    # c_i: probability in exact hundredths (bigint); p_i = c_i / 100.
    li = li.select("*", *[F.floor(F.col(f"s{i}") / tot * 100.0 + 0.5).alias(f"c{i}")
                          for i in range(1, 5)])
    li = li.select("*", *[(F.col(f"c{i}") / 100.0).alias(f"p{i}") for i in range(1, 5)])
    chosen = first_argmax(*[F.col(f"s{i}") for i in range(1, 5)])
    li = li.withColumn("chosen_ord", chosen)
    return li.select(
        "*",
        # one-hot of the choice: choice counts become integer sums, so they
        # can be pre-aggregated per order like the other moments
        *[(F.col("chosen_ord") == k).cast("int").alias(f"k{k}") for k in range(1, 5)],
        (F.col("p1") + F.col("p2") - F.col("p3") - F.col("p4")).alias("metric"),
        # the same metric in exact hundredths: integer sums are order-free,
        # so statistics are bit-identical for any partitioning or engine
        (F.col("c1") + F.col("c2") - F.col("c3") - F.col("c4")).alias("metric_c"))


def people(t: Tables) -> DataFrame:
    """orders -> customer -> nation -> region: who each order's trials name."""
    dims = (t.nation.select("n_nationkey", "n_name", "n_regionkey")
            .join(t.region.select("r_regionkey", "r_name"),
                  F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("n_name").alias("nationality"),
                    F.col("r_name").alias("region")))
    cust = (t.customer.select("c_custkey", "c_name", "c_nationkey")
            .join(dims,
                  F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("c_name").alias("name"),
                    gender_of(F.col("c_custkey")).alias("gender"),
                    "nationality", "region"))
    return (t.orders.select("o_orderkey", "o_custkey")
            .join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .drop("o_custkey"))


def trials(t: Tables) -> DataFrame:
    """The full trial view: one row per lineitem, with people attributes."""
    lines = trial_lines(t)
    return (lines.join(people(t), F.col("l_orderkey") == F.col("o_orderkey"))
            .drop("o_orderkey")
            .withColumn("chosen_key", option_key(F.col("mode"), F.col("chosen_ord"))))


def trial_options(df: DataFrame) -> Column:
    """Long form inside the row: array<struct<ord,key,role,prob,score>>.

    Keeping the four options in one array avoids a shuffle on the trial key
    that an explode + groupBy would need.
    """
    return F.array(*[F.struct(F.lit(i).alias("ord"),
                              option_key(F.col("mode"), F.lit(i)).alias("key"),
                              role_of(F.lit(i)).alias("role"),
                              F.col(f"p{i}").alias("prob"),
                              F.col(f"s{i}").alias("score"))
                     for i in range(1, 5)])


MODES = list(OPTION_KEYS)


def order_partials(t: Tables, sums, squares=(), modes=None) -> DataFrame:
    """Aggregate pushed below the people join: per order and mode, the row
    count and exact integer sums (and sums of squares) of the given columns,
    each with its own count of values: a NULL is in no mean.

    Grouping by ``l_orderkey`` alone (modes as conditional aggregates) keeps
    the aggregate hash-partitioned on the join key, so the join reuses that
    partitioning; lineitem is combined map-side before its only shuffle and
    the join carries one row per order instead of one per line item.
    """
    modes = list(modes or MODES)
    li = trial_lines(t)
    if modes != MODES:
        li = li.filter(F.col("mode").isin(modes))
    aggs = []
    for m in modes:
        c = F.col("mode") == m
        aggs.append(F.count(F.when(c, 1)).alias(f"n__{m}"))
        aggs += [F.count(F.when(c, F.col(x))).alias(f"n_{x}__{m}") for x in sums]
        aggs += [F.sum(F.when(c, F.col(x))).alias(f"s_{x}__{m}") for x in sums]
        aggs += [F.sum(F.when(c, F.col(x) * F.col(x))).alias(f"ss_{x}__{m}") for x in squares]
    return li.groupBy("l_orderkey").agg(*aggs)


def people_partials(t: Tables, sums, squares=(), modes=None) -> DataFrame:
    """``order_partials`` joined to ``people`` and unfolded to one row per
    (order, mode): people attributes, ``mode``, ``n`` (rows), ``n_<col>``
    (values), ``s_<col>``, ``ss_<col>``.  Summing these per group equals aggregating the full trial
    view, exactly (integers)."""
    modes = list(modes or MODES)
    op = order_partials(t, sums, squares, modes).join(people(t), F.col("l_orderkey") == F.col("o_orderkey"))
    fields = ["n"] + [f"n_{x}" for x in sums] + [f"s_{x}" for x in sums] + [f"ss_{x}" for x in squares]
    per_mode = F.inline(F.array(*[F.struct(F.lit(m).alias("mode"),
                                           *[F.col(f"{f}__{m}").alias(f) for f in fields]) for m in modes]))
    return (op.select("gender", "nationality", "region", "name", per_mode)
            .filter(F.col("n") > 0))


def metric_moments(t: Tables, keys, value: str = "metric_c", modes=None) -> DataFrame:
    """(keys..., n, s, ss) of ``value`` per group of people attributes and/or mode."""
    long = people_partials(t, [value], [value], modes)
    for k in keys:
        long = long.filter(F.col(k).isNotNull())
    return long.groupBy(*keys).agg(F.sum(f"n_{value}").alias("n"), F.sum(f"s_{value}").alias("s"),
                                   F.sum(f"ss_{value}").alias("ss"))
