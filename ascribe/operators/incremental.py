"""Incremental batch runs: ledger, pending work, next batch, merge
(J5, T1, U4, U6, A15, O2).

The ledger is a stored table of committed batches (``sources.ledger``); the pending set is a left anti join
on the full trial key (never on a partial key such as (set, name), which
would skip distinct trials that share a name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ledger


def processed_keys(ledger: DataFrame, keys) -> DataFrame:
    """The distinct key set of the ledger."""
    return ledger.select(*keys).dropDuplicates(list(keys))


def pending(work: DataFrame, ledger: DataFrame, keys) -> DataFrame:
    """Work items whose key is not in the ledger (left anti join;
    Spark broadcasts the key set when it is small, else shuffles both)."""
    return work.join(processed_keys(ledger, keys), list(keys), "left_anti")


def next_batch(pending_df: DataFrame, order, n: int) -> DataFrame:
    """O2: the next n pending items in work order (top-n, no full sort)."""
    return pending_df.orderBy(*order).limit(n)


def merge(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Old results plus new ones; a key delivered twice (a retried batch)
    is kept once, so running a batch twice equals running it once.

    The surviving row is chosen deterministically (the ledger's row first)
    with ``min(struct(source, ...))`` per key: O(1) state per key and a
    map-side partial step, so even a key with a huge number of copies is
    combined before the shuffle."""
    keys = list(keys)
    u = (old.withColumn("_src", F.lit(0))
         .unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True))
    rest = [c for c in u.columns if c not in keys and c != "_src"]
    best = u.groupBy(*keys).agg(F.min(F.struct("_src", *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def run_batch(work: DataFrame, path: str, keys, order, n: int, batch: int | None = None) -> int:
    """T1 + S12: one bounded step of a resumable run.  The next n items that
    the ledger at ``path`` lacks are recorded as one batch; returns its number.
    A step killed before its commit is repeated by the next call under the
    same number; ``batch`` repeats a given one (a no-op once committed)."""
    spark = work.sparkSession
    batch = ledger.next_id(spark, path) if batch is None else batch
    todo = next_batch(pending(work, ledger.read_ledger(spark, path, work.schema), keys), order, n)
    ledger.record(todo, path, batch)
    return batch
