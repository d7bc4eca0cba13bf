"""Numeric column functions (all JVM-side expressions, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PERPLEXITY_LOSS_CAP


def round_half_even_2(x: Column) -> Column:
    """Round to 2 decimals, ties to even, like NumPy's ``ndarray.round(2)``.

    ``rint(x*100)/100`` reproduces NumPy (which scales, rounds half-even and
    divides); ``bround`` rounds the exact decimal expansion and differs on a
    few values, ``round`` is half-up.
    """
    return F.rint(x * 100.0) / 100.0


def capped_exp(loss: Column, cap: float = PERPLEXITY_LOSS_CAP) -> Column:
    """exp(loss) when loss < cap, else +inf (overflow guard); NULL stays NULL."""
    return F.when(loss < cap, F.exp(loss)).when(loss.isNotNull(), F.lit(float("inf")))


def softmax(arr: Column) -> Column:
    """Numerically stable softmax of a numeric array column, per row."""
    m = F.array_max(arr)
    ex = F.transform(arr, lambda v: F.exp(v - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / tot)


def hash_key(*parts) -> Column:
    """Deterministic, engine-independent order key: md5 of ``a|b|...``.

    Used instead of ``rand()`` so retried tasks and DuckDB give the same
    permutation / sample.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def run_seed(global_seed: int, run: Column) -> Column:
    """Seed of run ``run``: first 32 bits of md5(global_seed|run) mod 100001."""
    h = F.conv(F.substring(hash_key(global_seed, run), 1, 8), 16, 10).cast("bigint")
    return (h % 100001).cast("bigint")
