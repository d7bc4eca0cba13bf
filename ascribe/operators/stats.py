"""Disparity statistics: means, deviations, counts, shares, pivots, quantiles.

Every aggregate here is a hash aggregate with a map-side partial step, so the
shuffle carries at most (#groups x #map tasks) partial rows however skewed the
groups are.  Pivots always take an explicit value list (no extra distinct
job, stable output columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_mean(c, scale: float = 1.0) -> Column:
    """Mean of an integer column: exact integer sum, then count and scale
    divisions, so the result does not depend on the summation order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)) / float(scale)


def exact_std(c, scale: float = 1.0) -> Column:
    """Sample std (ddof 1, NULL below 2 rows) of an integer column from exact
    integer moments n, sum, sum of squares (decimal(38,0) products), so it is
    bit-identical for any partitioning; partial moments merge across loads."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c)
    s = F.sum(c).cast("decimal(38,0)")
    ss = F.sum(c * c).cast("decimal(38,0)")
    num = (n.cast("decimal(38,0)") * ss - s * s).cast("double")
    return F.when(n > 1, F.sqrt(num / (n.cast("double") * (n - 1))) / float(scale))


def _drop_null_keys(df: DataFrame, keys) -> DataFrame:
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def metric_stats(df: DataFrame, keys, value: str = "metric_c", scale: float = 100.0,
                 mean: str = "mean", std: str = "std") -> DataFrame:
    """mean and sample std of ``value / scale`` per group.

    ``value`` holds exact integers (hundredths); rows with a NULL group key
    are dropped, as a pandas ``groupby`` does.
    """
    keys = list(keys)
    return _drop_null_keys(df, keys).groupBy(*keys).agg(
        exact_mean(value, scale).alias(mean), exact_std(value, scale).alias(std))


def option_means(df: DataFrame, keys, cols, names=None, scale: float = 100.0) -> DataFrame:
    """Mean of each option column per group (A1-A3); ``cols`` are exact
    integer hundredths."""
    names = names or cols
    return _drop_null_keys(df, keys).groupBy(*keys).agg(
        *[exact_mean(c, scale).alias(n) for c, n in zip(cols, names)])


def complete_grid(stats: DataFrame, dims: list[DataFrame], keys, fill_cols, fill=0.0) -> DataFrame:
    """Reindex ``stats`` on the product of the dimension value sets.

    Only cells that did not exist are filled; a NULL inside an existing cell
    stays NULL (a ``hit`` flag is tested, not the value).  The dimension
    sets are small (distinct values of a key), so the product is built by
    broadcast joins on a constant-free explode, never from the fact table.
    """
    grid = dims[0]
    for d in dims[1:]:
        grid = _product(grid, d)
    hit = stats.withColumn("_hit", F.lit(True))
    out = grid.join(hit, on=list(keys), how="left")
    return out.select(*keys, *[F.when(F.col("_hit").isNull(), F.lit(fill)).otherwise(F.col(c)).alias(c)
                               for c in fill_cols])


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two value sets: ``b``, the distinct values of a key, is
    packed into one array by a scalar subquery and exploded next to every row
    of ``a`` (no join at all)."""
    packed = b.agg(F.collect_list(F.struct(*b.columns))).scalar()     # one scalar subquery
    return a.select(*a.columns, F.inline(packed))


def means_grouping_sets(df: DataFrame, sets: list[list[str]], cols, names=None,
                        scale: float = 100.0) -> DataFrame:
    """Several groupings in one pass (A4): ``GROUPING SETS``.

    The Expand operator emits each input row once per set before the partial
    aggregation, so a single scan and a single shuffle serve all levels;
    ``g_<key>`` = 1 marks a key rolled up in that row.
    """
    names = names or cols
    allk = []
    for s_ in sets:
        for k in s_:
            if k not in allk:
                allk.append(k)
    g = df.groupingSets([[F.col(k) for k in s_] for s_ in sets], *[F.col(k) for k in allk])
    out = g.agg(*[F.grouping(k).cast("int").alias(f"g_{k}") for k in allk],
                *[exact_mean(c, scale).alias(n) for c, n in zip(cols, names)])
    return out


def choice_counts(df: DataFrame, keys, ord_col: str = "chosen_ord", n_options: int = 4,
                  prefix: str = "n_opt") -> DataFrame:
    """Counts of each chosen option per group, pivoted on an explicit value
    list and 0-filled (A5)."""
    vals = list(range(1, n_options + 1))
    out = df.groupBy(*keys).pivot(ord_col, vals).count()
    out = out.select(*keys, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("bigint").alias(f"{prefix}{v}")
                              for v in vals])
    return out


def choice_shares(df: DataFrame, keys, ord_col: str = "chosen_ord", n_options: int = 4,
                  prefix: str = "pct_opt") -> DataFrame:
    """Percentage of each chosen option within its group.

    Counts are aggregated first; the window total runs over the small count
    table (<= n_options rows per group), then the shares are pivoted.
    """
    counts = df.groupBy(*keys, ord_col).agg(F.count("*").alias("_n"))
    return shares_from_counts(counts, keys, ord_col, "_n", n_options, prefix)


def shares_from_counts(counts: DataFrame, keys, ord_col: str, cnt: str, n_options: int = 4,
                       prefix: str = "pct_opt") -> DataFrame:
    """W7 on an already aggregated count table (<= n_options rows per group):
    share = count * 100 / sum(count) over the group, pivoted to columns."""
    tot = F.sum(cnt).over(Window.partitionBy(*keys))
    shares = counts.withColumn("_pct", F.col(cnt).cast("double") * 100.0 / tot)
    vals = list(range(1, n_options + 1))
    out = shares.groupBy(*keys).pivot(ord_col, vals).agg(F.first("_pct"))
    return out.select(*keys, *[F.coalesce(F.col(str(v)), F.lit(0.0)).alias(f"{prefix}{v}")
                               for v in vals])


def melt(df: DataFrame, ids, values, var: str, val: str) -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(values), var, val)


def pivot_unique(df: DataFrame, index, column: str, values: list, value: str,
                 names=None) -> DataFrame:
    """One value per (index, column) cell, pivoted.

    Raises when a cell holds several rows, like ``DataFrame.pivot``; the check
    is an aggregate over the (small) input, not a collect.
    """
    names = names or [f"{v}_{value}" for v in values]
    dup = (df.groupBy(*index, column).agg(F.count("*").alias("_n"))
           .filter(F.col("_n") > 1).limit(1).count())
    if dup:
        raise ValueError("Index contains duplicate entries, cannot pivot")
    out = df.groupBy(*index).pivot(column, values).agg(F.first(value))
    return out.select(*index, *[F.col(str(v)).alias(n) for v, n in zip(values, names)])


def exact_quantiles(df: DataFrame, keys, value: str, probs, names=None) -> DataFrame:
    """Exact linear-interpolated quantiles (SQL ``percentile`` /
    ``quantile_cont``) per group, computed from value counts.

    Rows are first counted per (group, value) with a map-side partial
    aggregate; the ordered window then runs over distinct values only, so a
    group's memory is bounded by its number of distinct values (a few hundred
    for 2-decimal probabilities), never by its row count.  For continuous
    values with huge groups use ``percentile_approx`` instead.
    """
    keys = list(keys)
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select("*", F.sum("_c").over(w).alias("_end"),
                        F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    aggs = [F.first("_n").alias("_n")]
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * float(p)
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [F.min(F.when(F.col("_end") > lo, F.col(value))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("_end") > hi, F.col(value))).alias(f"_hi{i}"),
                 F.first(h - lo).alias(f"_d{i}")]
    g = cum.groupBy(*keys).agg(*aggs)
    return g.select(*keys, "_n", *[
        (F.col(f"_lo{i}") + F.col(f"_d{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(n)
        for i, n in enumerate(names)])


def box_summary(df: DataFrame, keys, value: str) -> DataFrame:
    """Data behind a box plot (A16): quartiles, whiskers at the most extreme
    values within 1.5 IQR of the box, and the number of outliers."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    j = counts.join(q, on=keys)
    inside = (F.col(value) >= lo_f) & (F.col(value) <= hi_f)
    return j.groupBy(*keys).agg(
        F.first("_n").cast("bigint").alias("n"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_c")).otherwise(0)).cast("bigint").alias("n_outliers"))


def top_k_per_group(df: DataFrame, keys, order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of each group in ``order`` (row_number <= k).

    Spark plans this as a partial window-group-limit before the shuffle and a
    final one after it, so each map task ships at most k rows per group: a
    hot group costs k rows per task, not its full size.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def error_bands(stats: DataFrame, mean: str = "mean", std: str = "std") -> DataFrame:
    """mean - std and mean + std."""
    return stats.select("*", (F.col(mean) - F.col(std)).alias("lower"),
                        (F.col(mean) + F.col(std)).alias("upper"))


def pool_groups(df: DataFrame, keys, n: str = "n", mean: str = "mean", std: str = "std") -> DataFrame:
    """Merge per-group (n, mean, sample std) into coarser groups exactly:
    N = sum n, mean = sum(n*mean)/N, M2 = sum((n-1)*std^2 + n*(mean - mean_N)^2).
    Lets daily / per-mode statistics be combined without re-reading rows."""
    keys = list(keys)
    if not keys:
        raise ValueError("pool_groups needs at least one key")
    tot = df.groupBy(*keys).agg(F.sum(n).alias("_N"), (F.sum(F.col(n) * F.col(mean)) / F.sum(n)).alias("_mu"))
    j = df.join(tot, keys)
    m2 = (F.col(n) - 1) * F.coalesce(F.col(std), F.lit(0.0)) ** 2 + F.col(n) * (F.col(mean) - F.col("_mu")) ** 2
    out = j.groupBy(*keys).agg(F.first("_N").alias("n"), F.first("_mu").alias("mean"), F.sum(m2).alias("_m2"))
    return out.select(*keys, "n", "mean",
                      F.when(F.col("n") > 1, F.sqrt(F.col("_m2") / (F.col("n") - 1))).alias("std"))


def stats_from_moments(m: DataFrame, keys, scale: float = 100.0, mean: str = "mean",
                       std: str = "std") -> DataFrame:
    """mean / sample std from merged integer moments (n, s, ss); the same
    arithmetic as ``exact_mean`` / ``exact_std``, hence bit-identical."""
    n = F.col("n")
    num = (n.cast("decimal(38,0)") * F.col("ss").cast("decimal(38,0)")
           - F.col("s").cast("decimal(38,0)") * F.col("s").cast("decimal(38,0)")).cast("double")
    return m.select(*keys, (F.col("s").cast("double") / F.nullif(n, F.lit(0)) / float(scale)).alias(mean),
                    F.when(n > 1, F.sqrt(num / (n.cast("double") * (n - 1))) / float(scale)).alias(std))


SKETCH_K = 800                 # KLL parameter: rank error about 2.3 / k ** 0.9, half a hundredth
RANK_ERROR = 0.01              # stated bound on a rank read from a sketch with SKETCH_K, twice its usual error


def quantile_sketches(df: DataFrame, load: list, keys, value: str, k: int = SKETCH_K) -> DataFrame:
    """A16 / A17 for continuous values: one KLL sketch per load and group (a
    few KB, whatever the group's size), combined map-side.  NULL and NaN values are left out."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*load, *keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys, k: int = SKETCH_K) -> DataFrame:
    """The sketches of all loads merged per group; the values are not read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(merged: DataFrame, keys, probs, names=None) -> DataFrame:
    """Quantiles read from merged sketches; the rank of each is off by at most
    RANK_ERROR of the group (with high probability, by KLL's guarantee)."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(c) for p, c in zip(probs, names)])
