"""Mixing sources to target weights by temperature (operator 8), DataFrame functions only.

Source token shares p are raised to an exponent t and normalised to weights
w(t).  The exponent is bisected between 1 (natural shares) and 0 (equal
shares) until the weights reach a target entropy, or until the most repeated
source reaches a limit of passes over its data.  A token budget then gives
each source w * budget tokens: whole passes over the source, and one partial
pass cut from a seeded permutation of its rows.

The permutation orders a source's rows by a 64-bit hash and is dealt into
blocks, ranges of the hash.  Blocks are summed first; only the one block in
which the quota runs out is walked row by row, so no source is sorted whole,
however large it is.

Defined cases: a null source is a source of its own; a null or empty text has
no tokens and goes with its position in the permutation; repeated rows count
each; an empty table gives an empty result; extra columns are kept by
``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import words_of

ENTROPY = "entropy"
REPETITION = "repetition"
GRID = 32                      # points tried in each bisection round
ROUNDS = 4                     # rounds: the exponent is known to 32 ** -4
BLOCK_TOKENS = 1 << 20         # tokens of a permutation block, about


def tokens_of(text: str = "text") -> Column:
    """Tokens of a text for the budget: its words."""
    return F.size(words_of(text)).cast("bigint")


def source_totals(rows: DataFrame) -> DataFrame:
    """``source, n_rows, n_tokens``; pre-aggregated before the shuffle, so a hot source is no burden."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))


def _at_exponents(totals: DataFrame, low: float, high: float) -> DataFrame:
    """Entropy of the weights and their largest share per natural share, for
    GRID + 1 exponents from low to high."""
    step = (high - low) / GRID
    grid = totals.where("n_tokens > 0").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: F.lit(low) + i * F.lit(step))).alias("t"),
        F.log(F.col("n_tokens").cast("double")).alias("ln"))
    # sums of p^t over sources, scaled by the largest to stay in range
    sums = (grid.withColumn("top", F.lit(0.0) + F.col("t") * F.col("ln"))
            .groupBy("t").agg(F.sum(F.exp("top")).alias("z"), F.sum(F.col("top") * F.exp("top")).alias("zl"),
                              F.min(F.col("ln")).alias("least"), F.max(F.col("ln")).alias("most")))
    return sums.select("t", (F.log("z") - F.col("zl") / F.col("z")).alias("entropy"),
                       # passes over the smallest source for one pass over the largest
                       F.exp((F.col("t") - 1) * (F.col("least") - F.col("most"))).alias("repetition"))


def find_exponent(totals: DataFrame, kind: str = REPETITION, target: float = 2.0) -> float:
    """The largest exponent whose entropy reaches ``target`` (nats), or the
    smallest whose repetition stays within it.  Both fall as the exponent
    grows from 0 to 1; a target out of reach gives the nearest end."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        rows = sorted(_at_exponents(totals, low, high).collect())          # GRID + 1 rows
        if not rows:
            return 1.0
        above = [r["t"] for r in rows if r[kind] >= target - 1e-12]
        below = [r["t"] for r in rows if r[kind] < target - 1e-12]
        low, high = (max(above) if above else rows[0]["t"]), (min(below) if below else rows[-1]["t"])
        if not above or not below:
            break
    return high if kind == REPETITION else low


def weights(totals: DataFrame, exponent: float) -> DataFrame:
    """``totals`` with ``natural`` and ``weight``; both sum to 1."""
    one = totals.withColumn("raw", F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens").cast("double"), F.lit(exponent)))
                            .otherwise(F.lit(0.0)))
    z, everything = one.agg(F.sum("raw"), F.sum("n_tokens")).first()         # one row
    return (one.withColumn("weight", F.col("raw") / F.lit(z) if z else F.lit(0.0))
            .withColumn("natural", F.col("n_tokens") / F.lit(everything) if everything else F.lit(0.0)).drop("raw"))


def permutation_key(seed: int) -> Column:
    """Place of a row in its source's seeded permutation."""
    return F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"))


def quotas(rows: DataFrame, kind: str = REPETITION, target: float = 2.0, budget: int | None = None,
           seed: int = 7, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per source: its weight, the number of whole ``passes`` and the last
    permutation key of the partial pass (``cut``; null when there is none).

    ``budget`` is in tokens; None takes the least that passes over every
    source at least once.  A row is taken into the partial pass when the
    tokens up to and with it fit the quota.  ``rows`` (doc_id, source,
    n_tokens) is read several times, so it should be a written table.
    """
    from ..session import materialize
    base = rows.select("source", "n_tokens", permutation_key(seed).alias("key"))
    totals = materialize(source_totals(base), "mix_totals")
    weighted = weights(totals, find_exponent(totals, kind, target))
    if budget is None:
        full = weighted.agg(F.max(F.col("n_tokens") / F.when(F.col("weight") > 0, F.col("weight")))).first()[0]
        budget = int(-(-(full or 0) // 1))
    # a hair of slack keeps an exact number of passes from falling short in the last bit
    passes = F.when(F.col("n_tokens") > 0, F.col("weight") * F.lit(float(budget)) / F.col("n_tokens") + 1e-9).otherwise(F.lit(1.0))
    each = materialize(weighted.select(
        "source", "n_rows", "n_tokens", "natural", "weight", F.floor(passes).cast("bigint").alias("passes"),
        F.floor((passes - F.floor(passes)) * F.col("n_tokens")).cast("bigint").alias("quota"),
        F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(block_tokens))).cast("bigint").alias("blocks")), "mix_sources")
    # blocks are equal ranges of the hash; unsigned position from the top 32 bits
    place = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 32)
    blocked = base.alias("b").join(each.select(F.col("source").alias("s"), "blocks", "quota"),
                                   F.col("b.source").eqNullSafe(F.col("s"))).select(
        "source", "key", "n_tokens", "quota", F.floor(place * F.col("blocks") / F.lit(float(1 << 32))).cast("bigint").alias("block"))
    sums = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("quota").alias("quota"))
    before = F.sum("t").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    running = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    edge = (running.where((F.col("before") <= F.col("quota")) & (F.col("before") + F.col("t") > F.col("quota")))
            .select(F.col("source").alias("s"), F.col("block").alias("k"), "before"))
    inside = blocked.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).withColumn(
        "upto", F.col("before") + F.sum("n_tokens").over(W.partitionBy("source", "block").orderBy("key").rangeBetween(
            W.unboundedPreceding, 0)))
    # rows before the edge block, and those of it that fit
    first_key = (F.col("k") * F.lit(float(1 << 32)) / F.col("blocks"))
    cut = inside.where(F.col("upto") <= F.col("quota")).groupBy("source").agg(F.max("key").alias("last"))
    edges = edge.join(each.select(F.col("source").alias("s2"), "blocks"), F.col("s").eqNullSafe(F.col("s2"))).select(
        F.col("s").alias("s3"), F.shiftleft(F.ceil(first_key) - 1, 32).bitwiseOR(F.lit((1 << 32) - 1)).bitwiseXOR(F.lit(-(1 << 63))).alias("floor_key"), "k")
    out = (each.join(edges, F.col("source").eqNullSafe(F.col("s3")), "left")
           .join(cut.withColumnRenamed("source", "s4"), F.col("source").eqNullSafe(F.col("s4")), "left"))
    return materialize(out.select(
        "source", "n_rows", "n_tokens", "natural", "weight", "passes", "quota",
        F.when(F.col("quota") > 0, F.coalesce("last", F.when(F.col("k") > 0, F.col("floor_key")))).alias("cut")), "mix_quotas")


def with_copies(rows: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """Each row (as the struct ``row``, so its columns clash with nothing) as
    often as its source's quota says, with its ``weight``, its ``copy`` number from 0 and ``position`` (the permutation key).  The plan has one row per
    source; Spark broadcasts it when its measured size allows and else splits
    the hot sources' partitions."""
    p = plan.select(F.col("source").alias("s"), "weight", "passes", "cut")
    whole = rows.select(F.struct("*").alias("row"), F.col("source").alias("own"), permutation_key(seed).alias("position"))
    times = F.col("passes") + F.when(F.col("position") <= F.col("cut"), 1).otherwise(0)
    return (whole.join(p, F.col("own").eqNullSafe(F.col("s"))).withColumn("n", times).where("n > 0")
            .select("row", "position", "weight", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy")))


def plan(docs: DataFrame, kind: str = REPETITION, target: float = 2.0, budget: int | None = None, seed: int = 7) -> DataFrame:
    """One row per taken copy: ``doc_id, source, n_tokens, copy, position, weight``."""
    from ..session import materialize
    rows = materialize(docs.select("doc_id", "source", tokens_of().alias("n_tokens")), "mix_docs")
    return with_copies(rows, quotas(rows, kind, target, budget, seed), seed).select("row.*", "copy", "position", "weight")


def mix(docs: DataFrame, kind: str = REPETITION, target: float = 2.0, budget: int | None = None, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as the plan takes it, all columns kept."""
    from ..session import materialize
    rows = materialize(docs.select("doc_id", "source", tokens_of().alias("n_tokens")), "mix_docs")
    p = quotas(rows, kind, target, budget, seed)
    return with_copies(docs, p, seed).select("row.*")
