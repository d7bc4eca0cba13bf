"""Trial generation: templates x names (J1, J3, J4), ordinals (W1), runs (P4),
sampling (W2, W8) and head-N (O1).

Templates, runs and sampled names are small dimension tables; names are the
large side.  Products are written as an explode of a bounded id sequence plus
a broadcast equi-join, never as a cross join, and the trial ordinal is
arithmetic over per-dimension ordinals (no global ``row_number``, which would
pull every row into one task).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_key, run_seed
from ..functions.text import fill
from ..schemas import GENDERS, GLOBAL_SEED, SECOND_NAME
from ..sources.tables import Tables
from .stats import top_k_per_group
from .trials import TRIAL_KEY, gender_of, people, trial_lines


# --- fixed values: template wording used when templates are derived ---
CHOICE_INSTRUCTION = "Choose one of the following reasons why {X} got this result:"
AO_DIALOGUE = "{X} explained what happened. However, {Y} commented on it."
AO_QUESTION = "Why do you think this happened to {X}?"
# --- end of fixed values ---


def gender_ord(g: Column) -> Column:
    """male first, then female (the generation order of the experiments)."""
    return F.when(g == GENDERS[0], 0).otherwise(1)


def names(t: Tables) -> DataFrame:
    """Name rows (customer x nation): c_custkey, name, gender, nationality, nat_ord."""
    nat = t.nation.select("n_nationkey", "n_name")
    return (t.customer.select("c_custkey", "c_name", "c_nationkey")
            .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("c_name").alias("name"),
                    gender_of(F.col("c_custkey")).alias("gender"),
                    F.col("n_name").alias("nationality"),
                    F.col("n_nationkey").cast("bigint").alias("nat_ord")))


def templates(t: Tables) -> DataFrame:
    """Gendered choice templates from ``benchmark`` (one per item).

    ``initial_prompt`` is ``{X}`` followed by the whole item text; options are
    the whole texts of the next four items (cyclic), so every template has
    four distinct option texts derived from the data.
    """
    b = t.benchmark.select("item_id", "text")
    n = b.select((F.max("item_id") + 1).alias("n")).scalar()
    base = b.select(F.col("item_id").alias("template_id"),
                    F.when(F.col("item_id") % 2 == 0, GENDERS[0]).otherwise(GENDERS[1]).alias("gender"),
                    F.concat(F.lit("{X} "), F.col("text")).alias("initial_prompt"),
                    F.lit(CHOICE_INSTRUCTION).alias("instruction"))
    out = base.select("*", *[((F.col("template_id") + k) % n).alias(f"_id{k}") for k in range(1, 5)])
    for k in range(1, 5):
        ok = b.select(F.col("item_id").alias(f"_id{k}"), F.col("text").alias(f"o{k}"))
        out = out.join(ok, f"_id{k}", "left").drop(f"_id{k}")
    return out


def bounds(t: Tables) -> dict[str, Column]:
    """Scalar-subquery bounds that make the arithmetic ordinal unique."""
    return {
        "nt": t.benchmark.select((F.max("item_id") + 1).cast("bigint")).scalar(),
        "nn": t.nation.select((F.max("n_nationkey") + 1).cast("bigint")).scalar(),
        "ck": t.customer.select((F.max("c_custkey") + 1).cast("bigint")).scalar(),
    }


def spread(nm: DataFrame) -> DataFrame:
    """Names dealt by customer over as many tasks as the session shuffles to:
    the next step multiplies every row."""
    return nm.repartition(int(nm.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


def generate_trials(t: Tables, tmpl: DataFrame | None = None, nm: DataFrame | None = None) -> DataFrame:
    """Every gendered template crossed with the names of its gender.

    The names are spread by customer before they are expanded, so the product
    is made in many tasks; Spark broadcasts the templates when their measured
    size allows, else joins on ``gender``.  ``idx`` follows the generation order (gender, template, nationality,
    name) but is computed per row.
    """
    tmpl = tmpl if tmpl is not None else templates(t)
    b = bounds(t)
    j = spread(nm if nm is not None else names(t)).join(tmpl, "gender")
    idx = (((gender_ord(F.col("gender")) * b["nt"] + F.col("template_id")) * b["nn"]
            + F.col("nat_ord")) * b["ck"] + F.col("c_custkey"))
    return j.withColumn("idx", idx.cast("bigint"))


def drawn_trials(t: Tables, tmpl: DataFrame, for_texts: bool = False) -> DataFrame:
    """The trial view's rows, each with one template (by ``l_partkey``) and its
    order's name: as many rows as there are trials, never the product.

    ``for_texts``: every task sorts its still narrow rows by template.  Filled
    texts of one template then stand side by side, and a file of them holds
    little more than their names and option orders once compressed."""
    n = t.benchmark.select(F.max("item_id") + 1).scalar()
    li = trial_lines(t).select(*TRIAL_KEY, "mode", (F.col("l_partkey") % n).alias("template_id"))
    who = people(t).select("o_orderkey", "name", "gender", "nationality")
    drawn = li.join(who, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    if for_texts:
        # Spark drops a sort it finds below a join, but not one below an observed count
        drawn = drawn.sortWithinPartitions("template_id").observe(
            f"drawn_trials_{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))
    return drawn.join(tmpl, "template_id")


def generate_all(t: Tables) -> DataFrame:
    """Ungendered templates x all names, as explode(template ids) + a
    broadcast equi-join (no cross join)."""
    b = bounds(t)
    tm = t.benchmark.select(F.col("item_id").alias("template_id"), "text")
    lo_hi = t.benchmark.select(F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
    lo, hi = lo_hi.select("lo").scalar(), lo_hi.select("hi").scalar()
    nm = spread(names(t)).withColumn("template_id", F.explode(F.sequence(lo, hi)))
    j = nm.join(tm, "template_id")
    idx = (F.col("template_id") * b["nn"] + F.col("nat_ord")) * b["ck"] + F.col("c_custkey")
    return j.withColumn("idx", idx.cast("bigint"))


def fill_choice(df: DataFrame) -> DataFrame:
    """``{X}`` -> name in instruction and initial prompt (all occurrences)."""
    return (df.withColumn("instruction", fill("instruction", F.col("name")))
              .withColumn("initial_prompt", fill("initial_prompt", F.col("name"))))


def fill_actor_observer(df: DataFrame, other: str = SECOND_NAME) -> DataFrame:
    """P2 + F17: ``{X}`` -> name and ``{Y}`` -> the fixed second speaker."""
    scen = F.concat(F.lit("{X} talked with {Y}. "), F.col("text"))
    return df.select(
        "*",
        fill(fill(scen, F.col("name")), F.lit(other), "{Y}").alias("scenario"),
        fill(fill(F.lit(AO_DIALOGUE), F.col("name")), F.lit(other), "{Y}").alias("dialogue"),
        fill(F.lit(AO_QUESTION), F.col("name")).alias("question"),
        fill(F.lit("What {X} said"), F.col("name")).alias("option1"),
        fill(F.lit("What {Y} said"), F.lit(other), "{Y}").alias("option2"))


def with_runs(df: DataFrame, runs: int, global_seed: int = GLOBAL_SEED) -> DataFrame:
    """One copy of each trial per run, seed = hash(seed, run)."""
    out = df.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return out.withColumn("seed", run_seed(global_seed, F.col("run")))


def head_n(t: Tables, n: int) -> DataFrame:
    """O1: the first n trials of the generation order, without the product.

    Every template holds its gender's names in the same order, so only the
    first n names of a gender can appear, and of its templates the first
    n / names (rounded up)."""
    nm = top_k_per_group(names(t), ["gender"], [F.col("nat_ord"), F.col("c_custkey")], n)
    each = nm.groupBy("gender").agg(F.count(F.lit(1)).alias("_each"))
    tm = templates(t).select("template_id", "gender")
    tm = top_k_per_group(tm, ["gender"], [F.col("template_id")], n).join(each, "gender")
    tm = tm.where(F.col("rank") <= F.ceil(F.lit(n) / F.col("_each"))).select("template_id", "gender")
    return generate_trials(t, tm, nm.drop("rank")).orderBy("idx").limit(n)


def stratified_sample(df: DataFrame, strata, id_col: str, k: int = 3,
                      seed: int = GLOBAL_SEED) -> DataFrame:
    """K rows per stratum without replacement (all when fewer),
    in a seeded hash order — deterministic and retry-safe."""
    h = hash_key(seed, F.col(id_col))
    return top_k_per_group(df.withColumn("_h", h), strata, [F.col("_h"), F.col(id_col)], k).drop("_h")
