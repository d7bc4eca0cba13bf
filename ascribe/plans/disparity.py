"""Disparity statistics over the trial view (stage 1 and 2 of the build plan)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..operators.trials import metric_moments, people_partials
from ..session import materialize
from .registry import register, round_doubles
from .sql import mean_c, r6, std_c, with_trials

P_COLS = ["p1", "p2", "p3", "p4"]
C_COLS = ["c1", "c2", "c3", "c4"]
MEAN = r6(mean_c("metric_c"), "mean")
STD = r6(std_c("metric_c"), "std")
OPT_NAMES = ["opt1", "opt2", "opt3", "opt4"]


# --- A10 (flagship): mean / std of the metric by gender, nationality, mode ---
@register("disparity_by_mode", with_trials(f"""
SELECT gender, nationality, mode, {MEAN}, {STD}
FROM trials GROUP BY gender, nationality, mode ORDER BY gender, nationality, mode
"""), headline=True)
def disparity_by_mode(t):
    """A10 + P5 + P23 + O4: metric statistics per (gender, nationality, mode)."""
    keys = ["gender", "nationality", "mode"]
    s = stats.stats_from_moments(metric_moments(t, keys), keys)
    return round_doubles(s).orderBy(*keys)


@register("disparity_by_nationality", with_trials(f"""
SELECT nationality, {MEAN}, {STD}
FROM trials GROUP BY nationality ORDER BY nationality
"""))
def disparity_by_nationality(t):
    """Both modes pooled, by nationality."""
    s = stats.stats_from_moments(metric_moments(t, ["nationality"]), ["nationality"])
    return round_doubles(s).orderBy("nationality")


@register("disparity_one_mode", with_trials(f"""
SELECT gender, nationality, {MEAN}, {STD}
FROM trials WHERE mode = 'Success' GROUP BY gender, nationality ORDER BY gender, nationality
"""))
def disparity_one_mode(t):
    """One mode at a time (the mode filter runs on lineitem, before the per-order aggregate)."""
    keys = ["gender", "nationality"]
    s = stats.stats_from_moments(metric_moments(t, keys, modes=["Success"]), keys)
    return round_doubles(s).orderBy(*keys)


@register("slice_stats", with_trials(f"""
SELECT nationality, mean, std FROM (
  SELECT gender, nationality, mode, {MEAN}, {STD}
  FROM trials GROUP BY gender, nationality, mode) s
WHERE mode = 'Failure' AND gender = 'female' ORDER BY nationality
"""))
def slice_stats(t):
    """Conjunctive filter on the statistics (pushed below the aggregate)."""
    keys = ["gender", "nationality", "mode"]
    s = stats.stats_from_moments(metric_moments(t, keys), keys)
    s = s.filter((F.col("mode") == "Failure") & (F.col("gender") == "female"))
    return round_doubles(s.select("nationality", "mean", "std")).orderBy("nationality")


@register("metric_wide", with_trials(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, mode,
       p1 AS opt1, p2 AS opt2, p3 AS opt3, p4 AS opt4, {r6('opt1 + opt2 - opt3 - opt4', 'metric')}
FROM tl
"""))
def metric_wide(t):
    """P23 on wide option columns: o1 + o2 - o3 - o4."""
    from ..operators.metrics import internal_external
    from ..operators.trials import trial_lines
    li = trial_lines(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "mode",
                               *[F.col(p).alias(o) for p, o in zip(P_COLS, OPT_NAMES)])
    return round_doubles(li.withColumn("metric", internal_external(*[F.col(o) for o in OPT_NAMES])))


@register("metric_long", with_trials(f"""
, lg AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, mode,
         unnest([1, 2, 3, 4]) AS ord, unnest([p1, p2, p3, p4]) AS prob FROM tl),
lg2 AS (SELECT *, CASE WHEN ord <= 2 THEN 1.0 ELSE -1.0 END AS sign FROM lg)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, mode, {r6('sum(prob * sign)', 'metric')}
FROM lg2 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, mode
"""))
def metric_long(t):
    """P23 in long form: sum(prob * sign) over the option records of a trial.

    The option records live in one array per trial, so the signed sum is a
    per-row fold and needs no shuffle on the trial key.
    """
    from ..operators.metrics import signed_metric_long
    from ..operators.trials import trial_lines, trial_options
    li = trial_lines(t)
    out = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "mode",
                    signed_metric_long(trial_options(li)).alias("metric"))
    return round_doubles(out)


# --- A1-A4: option means ---
def _partial_means(p, keys):
    """Option means from per-(order, mode) partial sums: exact integer sums,
    then the same two divisions as ``stats.exact_mean``."""
    for k in keys:
        p = p.filter(F.col(k).isNotNull())
    return p.groupBy(*keys).agg(*[(F.sum(f"s_{c}").cast("double") / F.nullif(F.sum(f"n_{c}"), F.lit(0)) / 100.0).alias(o)
                                  for c, o in zip(C_COLS, OPT_NAMES)])



def _opt_avgs():
    return ", ".join(r6(mean_c(c), o) for c, o in zip(C_COLS, OPT_NAMES))


@register("mean_by_gender", with_trials(f"""
SELECT mode, gender, {_opt_avgs()} FROM trials GROUP BY mode, gender ORDER BY mode, gender
"""))
def mean_by_gender(t):
    """A1: mean option probabilities by (mode, gender)."""
    s = _partial_means(people_partials(t, C_COLS), ["mode", "gender"])
    return round_doubles(s).orderBy("mode", "gender")


@register("mean_by_nationality", with_trials(f"""
SELECT mode, nationality, {_opt_avgs()} FROM trials GROUP BY mode, nationality ORDER BY mode, nationality
"""))
def mean_by_nationality(t):
    """A2: mean option probabilities by (mode, nationality)."""
    s = _partial_means(people_partials(t, C_COLS), ["mode", "nationality"])
    return round_doubles(s).orderBy("mode", "nationality")




@register("grid_complete", with_trials(f"""
, f AS (SELECT * FROM trials),
g AS (SELECT gender, nationality, {_opt_avgs()} FROM f GROUP BY gender, nationality),
grid AS (SELECT gd.gender, nt.nationality FROM (SELECT DISTINCT gender FROM f) gd,
                                               (SELECT DISTINCT nationality FROM f) nt)
SELECT grid.gender, grid.nationality,
       CASE WHEN g.gender IS NULL THEN 0.0 ELSE g.opt1 END AS opt1,
       CASE WHEN g.gender IS NULL THEN 0.0 ELSE g.opt2 END AS opt2,
       CASE WHEN g.gender IS NULL THEN 0.0 ELSE g.opt3 END AS opt3,
       CASE WHEN g.gender IS NULL THEN 0.0 ELSE g.opt4 END AS opt4
FROM grid LEFT JOIN g ON grid.gender = g.gender AND grid.nationality = g.nationality
"""))
def grid_complete(t):
    """A3 + J10: means by (gender, nationality) over the full gender x
    nationality grid of all trials, 0 for cells without trials."""
    f = people_partials(t, C_COLS)
    s = materialize(_partial_means(f, ["gender", "nationality"]))      # small; read thrice below
    # every gender / nationality present in the filtered trials has a row in s
    dims = [s.select("gender").distinct(), s.select("nationality").distinct()]
    out = stats.complete_grid(s, dims, ["gender", "nationality"], OPT_NAMES)
    return round_doubles(out)


@register("grid_complete_modes", with_trials(f"""
, g AS (SELECT mode, gender, nationality, {_opt_avgs()} FROM trials GROUP BY mode, gender, nationality),
grid AS (SELECT md.mode, gd.gender, nt.nationality FROM (SELECT DISTINCT mode FROM trials) md,
                (SELECT DISTINCT gender FROM trials) gd, (SELECT DISTINCT nationality FROM trials) nt)
SELECT grid.mode, grid.gender, grid.nationality,
       CASE WHEN g.gender IS NULL THEN 0.0 ELSE g.opt1 END AS opt1,
       CASE WHEN g.gender IS NULL THEN 0.0 ELSE g.opt2 END AS opt2,
       CASE WHEN g.gender IS NULL THEN 0.0 ELSE g.opt3 END AS opt3,
       CASE WHEN g.gender IS NULL THEN 0.0 ELSE g.opt4 END AS opt4
FROM grid LEFT JOIN g ON grid.mode = g.mode AND grid.gender = g.gender AND grid.nationality = g.nationality
"""))
def grid_complete_modes(t):
    """A3 + J10 over all trials: means by (mode, gender, nationality) over the
    full grid, 0 for cells without trials."""
    keys = ["mode", "gender", "nationality"]
    s = materialize(_partial_means(people_partials(t, C_COLS), keys))      # small; read four times below
    out = stats.complete_grid(s, [s.select(k).distinct() for k in keys], keys, OPT_NAMES)
    return round_doubles(out)


@register("means_grouping_sets", with_trials(f"""
SELECT mode, gender, nationality,
       CAST(grouping(mode) AS INTEGER) AS g_mode, CAST(grouping(gender) AS INTEGER) AS g_gender,
       CAST(grouping(nationality) AS INTEGER) AS g_nationality, {_opt_avgs()}
FROM trials GROUP BY GROUPING SETS ((mode, gender), (mode, nationality), (mode, gender, nationality))
"""))
def means_grouping_sets(t):
    """A4: the A1, A2 and A3 levels in one scan and one shuffle."""
    p = people_partials(t, C_COLS)
    sets = [["mode", "gender"], ["mode", "nationality"], ["mode", "gender", "nationality"]]
    g = p.groupingSets([[F.col(k) for k in s_] for s_ in sets], "mode", "gender", "nationality")
    out = g.agg(*[F.grouping(k).cast("int").alias(f"g_{k}") for k in ("mode", "gender", "nationality")],
                *[(F.sum(f"s_{c}").cast("double") / F.nullif(F.sum(f"n_{c}"), F.lit(0)) / 100.0).alias(o)
                  for c, o in zip(C_COLS, OPT_NAMES)])
    return round_doubles(out)


@register("grid_labels", """
WITH d AS (SELECT source, lang, toxic, quality, n_chars FROM documents JOIN labels USING (doc_id)
           WHERE source IS NOT NULL AND lang IS NOT NULL AND toxic IS NOT NULL),
g AS (SELECT source, lang, toxic, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_good, CAST(max(n_chars) AS BIGINT) AS longest
      FROM d GROUP BY source, lang, toxic)
SELECT s.source, l.lang, x.toxic, CASE WHEN g.n IS NULL THEN 0 ELSE g.n END AS n, CASE WHEN g.n IS NULL THEN 0 ELSE g.n_good END AS n_good,
       CASE WHEN g.n IS NULL THEN 0 ELSE g.longest END AS longest
FROM (SELECT DISTINCT source FROM d) s, (SELECT DISTINCT lang FROM d) l, (SELECT DISTINCT toxic FROM d) x
LEFT JOIN g ON g.source = s.source AND g.lang = l.lang AND g.toxic = x.toxic
""")
def grid_labels(t):
    """Labelled documents by (source, language, toxic) over the full grid,
    most of whose toxic cells hold none and are filled with 0."""
    keys = ["source", "lang", "toxic"]
    d = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id").dropna(subset=keys)
    s = materialize(d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("quality").alias("n_good"),
                                         F.max("n_chars").cast("bigint").alias("longest")), "labelled")
    return stats.complete_grid(s, [s.select(k).distinct() for k in keys], keys, ["n", "n_good", "longest"], fill=0)
