"""Choice counts, shares, pivots, gaps and distribution summaries (stage 2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.metrics import gap
from ..operators.trials import metric_moments, people, people_partials, trial_lines, trials
from ..session import materialize
from .registry import register, round_doubles
from .sql import mean_c, r6, std_c, with_trials

CNT = ", ".join(f"CAST(count(*) FILTER (WHERE chosen_ord = {i}) AS BIGINT) AS n_opt{i}" for i in range(1, 5))
PCT = ", ".join(r6(f"CAST(count(*) FILTER (WHERE chosen_ord = {i}) AS DOUBLE) * 100.0 / count(*)", f"pct_opt{i}")
                for i in range(1, 5))
CUBE_KEYS = ["mode", "gender", "nationality", "template_id"]


@register("choice_counts", with_trials(f"""
SELECT mode, gender, nationality, template_id, {CNT} FROM trials
GROUP BY mode, gender, nationality, template_id
"""))
def choice_counts(t):
    """A5: chosen-option counts per (mode, gender, nationality, template),
    pivoted on the explicit option list, 0-filled."""
    return stats.choice_counts(trials(t), CUBE_KEYS)


@register("choice_counts_slice", with_trials(f"""
SELECT mode, gender, nationality, template_id, {CNT} FROM trials WHERE template_id = 3
GROUP BY mode, gender, nationality, template_id
"""))
def choice_counts_slice(t):
    """One prompt's slice of the count cube (filter pushed below the pivot)."""
    return stats.choice_counts(trials(t), CUBE_KEYS).filter(F.col("template_id") == 3)


@register("choice_rollup", with_trials(f"""
SELECT mode, gender, nationality, {CNT} FROM trials GROUP BY mode, gender, nationality
"""))
def choice_rollup(t):
    """Choice counts rolled up over prompts to (mode, gender, nationality).

    Without the prompt dimension the counts are sums of the one-hot choice
    columns, so they are pre-aggregated per order below the people join
    (one row per order through the join, like the moment statistics)."""
    p = people_partials(t, ["k1", "k2", "k3", "k4"])
    return p.groupBy("mode", "gender", "nationality").agg(
        *[F.sum(f"s_k{i}").cast("bigint").alias(f"n_opt{i}") for i in range(1, 5)])


def _choice_count_long(t):
    """(mode, gender, nationality, chosen_ord, n) from per-order partials."""
    keys = ["mode", "gender", "nationality"]
    p = people_partials(t, ["k1", "k2", "k3", "k4"])
    agg = p.groupBy(*keys).agg(*[F.sum(f"s_k{i}").alias(f"{i}") for i in range(1, 5)])
    long = agg.unpivot(keys, [f"{i}" for i in range(1, 5)], "chosen_ord", "n")
    return long.withColumn("chosen_ord", F.col("chosen_ord").cast("int"))


@register("choice_share", with_trials(f"""
SELECT mode, gender, nationality, {PCT} FROM trials GROUP BY mode, gender, nationality
"""))
def choice_share(t):
    """A11 + W7: percentage of each chosen option within (mode, gender,
    nationality): counts pre-aggregated per order, then the window share on
    the small count table."""
    keys = ["mode", "gender", "nationality"]
    return round_doubles(stats.shares_from_counts(_choice_count_long(t), keys, "chosen_ord", "n"))


@register("melt_share", with_trials(f"""
, s AS (SELECT mode, gender, nationality, {PCT} FROM trials GROUP BY mode, gender, nationality)
SELECT mode, gender, nationality, option, percentage FROM s
UNPIVOT (percentage FOR option IN (pct_opt1, pct_opt2, pct_opt3, pct_opt4))
"""))
def melt_share(t):
    """The share table melted to (option, percentage) rows."""
    s = stats.shares_from_counts(_choice_count_long(t), ["mode", "gender", "nationality"], "chosen_ord", "n")
    return round_doubles(stats.melt(s, ["mode", "gender", "nationality"],
                                    [f"pct_opt{i}" for i in range(1, 5)], "option", "percentage"))


def _group_stats(t):
    keys = ["gender", "nationality", "mode"]
    return stats.stats_from_moments(metric_moments(t, keys), keys)


_MEANS = (f"SELECT gender, nationality, mode, {mean_c('metric_c')} AS mean, {std_c('metric_c')} AS std "
          "FROM trials GROUP BY ALL")


@register("gender_gap", with_trials(f"""
, m AS ({_MEANS})
SELECT mode, nationality,
       {r6("max(mean) FILTER (WHERE gender = 'female')", 'female_mean')},
       {r6("max(mean) FILTER (WHERE gender = 'male')", 'male_mean')},
       {r6("max(mean) FILTER (WHERE gender = 'male') - max(mean) FILTER (WHERE gender = 'female')", 'gap')}
FROM m GROUP BY mode, nationality
"""))
def gender_gap(t):
    """A12 + P24: gender pivoted to columns (one value per cell), then male - female."""
    m = materialize(_group_stats(t))              # small; checked, then pivoted
    p = stats.pivot_unique(m, ["mode", "nationality"], "gender", ["female", "male"], "mean",
                           ["female_mean", "male_mean"])
    return round_doubles(p.withColumn("gap", gap(F.col("male_mean"), F.col("female_mean"))))


@register("error_bands", with_trials(f"""
, m AS ({_MEANS})
SELECT gender, nationality, mode, {r6('mean', 'mean')}, {r6('std', 'std')},
       {r6('mean - std', 'lower')}, {r6('mean + std', 'upper')} FROM m
"""))
def error_bands(t):
    """Mean +- std per (gender, nationality, mode), the error-bar data."""
    m = _group_stats(t)
    return round_doubles(stats.error_bands(m))


@register("box_summary", with_trials(f"""
, q AS (SELECT nationality, mode, count(*) AS n, quantile_cont(metric_c, 0.25) AS q1,
               quantile_cont(metric_c, 0.5) AS median, quantile_cont(metric_c, 0.75) AS q3
        FROM trials GROUP BY nationality, mode),
j AS (SELECT q.*, t.metric_c,
             t.metric_c >= q.q1 - 1.5 * (q.q3 - q.q1) AND t.metric_c <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM q JOIN trials t ON q.nationality = t.nationality AND q.mode = t.mode)
SELECT nationality, mode, CAST(any_value(n) AS BIGINT) AS n, {r6('any_value(q1) / 100.0', 'q1')},
       {r6('any_value(median) / 100.0', 'median')}, {r6('any_value(q3) / 100.0', 'q3')},
       {r6('min(metric_c) FILTER (WHERE inside) / 100.0', 'whisker_low')},
       {r6('max(metric_c) FILTER (WHERE inside) / 100.0', 'whisker_high')},
       CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS n_outliers
FROM j GROUP BY nationality, mode
"""))
def box_summary(t):
    """Quartiles, whiskers and outlier count of the metric by (nationality, mode)."""
    b = stats.box_summary(trials(t), ["nationality", "mode"], "metric_c")
    return round_doubles(b.select("nationality", "mode", "n", "n_outliers",
                                  *[(F.col(c) / 100.0).alias(c) for c in
                                    ("q1", "median", "q3", "whisker_low", "whisker_high")]))


@register("quartiles_of_means", with_trials(f"""
, m AS ({_MEANS})
SELECT mode, gender, {r6('quantile_cont(mean, 0.25)', 'q1')}, {r6('quantile_cont(mean, 0.5)', 'median')},
       {r6('quantile_cont(mean, 0.75)', 'q3')} FROM m GROUP BY mode, gender
"""))
def quartiles_of_means(t):
    """Quartiles of the per-nationality means within (mode, gender)
    (the inner lines of a violin plot; the density curve is not built)."""
    m = _group_stats(t)
    q = stats.exact_quantiles(m, ["mode", "gender"], "mean", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return round_doubles(q.drop("_n"))


@register("distinct_dims", with_trials("""
, f AS (SELECT nationality, min(l_orderkey * 100 + l_linenumber) AS first_seen FROM trials GROUP BY nationality)
SELECT nationality, first_seen, CAST(row_number() OVER (ORDER BY first_seen, nationality) AS BIGINT) AS ord
FROM f ORDER BY ord
"""))
def distinct_dims(t):
    """A14 + O5: distinct nationalities in first-seen order of the trial sequence.

    The minimum is taken per order before the people join (one row per order
    through the join); only the small distinct result is ordered.
    """
    first = (trial_lines(t).groupBy("l_orderkey")       # per order first, below the join
             .agg(F.min(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("_f")))
    f = (first.join(people(t), F.col("l_orderkey") == F.col("o_orderkey"))
         .groupBy("nationality").agg(F.min("_f").alias("first_seen")))
    w = Window.orderBy("first_seen", "nationality")
    return f.withColumn("ord", F.row_number().over(w).cast("bigint")).orderBy("ord")


@register("box_summary_gender", with_trials(f"""
, q AS (SELECT gender, mode, count(*) AS n, quantile_cont(metric_c, 0.25) AS q1,
               quantile_cont(metric_c, 0.5) AS median, quantile_cont(metric_c, 0.75) AS q3
        FROM trials GROUP BY gender, mode),
j AS (SELECT q.*, t.metric_c,
             t.metric_c >= q.q1 - 1.5 * (q.q3 - q.q1) AND t.metric_c <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM q JOIN trials t ON q.gender = t.gender AND q.mode = t.mode)
SELECT gender, mode, CAST(any_value(n) AS BIGINT) AS n, {r6('any_value(q1) / 100.0', 'q1')},
       {r6('any_value(median) / 100.0', 'median')}, {r6('any_value(q3) / 100.0', 'q3')},
       {r6('min(metric_c) FILTER (WHERE inside) / 100.0', 'whisker_low')},
       {r6('max(metric_c) FILTER (WHERE inside) / 100.0', 'whisker_high')},
       CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS n_outliers
FROM j GROUP BY gender, mode
"""))
def box_summary_gender(t):
    """A16 by (gender, mode): the second box plot of the disparity figures.
    Groups here hold half of all rows each; the counts-first quantiles keep
    the work per group bounded by its distinct values."""
    b = stats.box_summary(trials(t), ["gender", "mode"], "metric_c")
    return round_doubles(b.select("gender", "mode", "n", "n_outliers",
                                  *[(F.col(c) / 100.0).alias(c) for c in
                                    ("q1", "median", "q3", "whisker_low", "whisker_high")]))


SKETCH_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@register("quantile_sketch", f"""
WITH p AS (SELECT unnest([{", ".join(map(str, SKETCH_PROBS))}]) AS prob)
SELECT l_linestatus AS status, CAST(prob AS DOUBLE) AS prob, count(l_extendedprice) AS n, true AS within_error
FROM lineitem, p GROUP BY ALL
""")
def quantile_sketch(t):
    """A16 + A17 for a continuous value: a sketch per load (ship month) and
    group, merged over the loads; each quantile's true rank is then counted in
    one more pass and compared with the stated rank error."""
    keys = ["l_linestatus"]
    rows = t.lineitem.select("l_linestatus", "l_shipdate", F.col("l_extendedprice").cast("double").alias("v"))
    loads = materialize(stats.quantile_sketches(rows, [F.date_trunc("month", "l_shipdate").alias("load")], keys, "v"), "sketches")
    names = [f"v{i}" for i in range(len(SKETCH_PROBS))]
    marks = materialize(stats.sketch_quantiles(stats.merge_sketches(loads, keys), keys, SKETCH_PROBS, names), "quantiles")
    at = marks.select(F.col("l_linestatus").alias("_s"), "n", *names)
    known = rows.where("v is not null and not isnan(v)").join(at, F.col("l_linestatus").eqNullSafe(F.col("_s")))
    counts = known.groupBy("_s").agg(F.first("n").alias("n"), *[F.sum((F.col("v") < F.col(c)).cast("bigint")).alias(f"below_{c}") for c in names],
                                     *[F.sum((F.col("v") <= F.col(c)).cast("bigint")).alias(f"upto_{c}") for c in names])
    # a value's copies hold all ranks from below to upto
    each = F.array(*[F.struct(F.lit(p).alias("prob"), ((F.col(f"below_{c}") <= (p + stats.RANK_ERROR) * F.col("n"))
                                                      & (F.col(f"upto_{c}") >= (p - stats.RANK_ERROR) * F.col("n"))).alias("ok"))
                     for p, c in zip(SKETCH_PROBS, names)])
    return counts.select(F.col("_s").alias("status"), "n", F.explode(each).alias("e")).select(
        "status", F.col("e.prob").alias("prob"), "n", F.col("e.ok").alias("within_error"))
