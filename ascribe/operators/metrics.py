"""Attribution metric and option-score reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import OPTION_KEYS, SIGNS, require_columns


def internal_external(o1: Column, o2: Column, o3: Column, o4: Column) -> Column:
    """metric = internal - external = o1 + o2 - o3 - o4."""
    return o1 + o2 - o3 - o4


def signed_metric_long(options: Column, prob: str = "prob", ord_: str = "ord") -> Column:
    """The same metric from an array of option records: sum(prob * sign),
    sign +1 for ordinals 1-2 (internal) and -1 for 3-4 (external)."""
    return F.aggregate(options, F.lit(0.0),
                       lambda acc, o: acc + o[prob] * F.when(o[ord_] <= 2, 1.0).otherwise(-1.0))


def add_metric(df: DataFrame, mode: str, out: str = "metric") -> DataFrame:
    """Required-column check (P13) then the metric on the mode's named columns."""
    keys = OPTION_KEYS[mode]
    require_columns(df, keys)
    return df.withColumn(out, internal_external(*[F.col(k) for k in keys]))


def expand_probs(letter_probs: Column, letter_keys: Column, keys: list[str]) -> list[Column]:
    """``{letter: prob}`` + ``{letter: key}`` -> one column per key, in the
    fixed order ``keys`` (not the first row's shuffled order)."""
    key_probs = F.map_from_arrays(
        F.transform(F.map_keys(letter_probs), lambda l: F.element_at(letter_keys, l)),
        F.map_values(letter_probs))
    return [F.element_at(key_probs, F.lit(k)).alias(k) for k in keys]


def gap(a: Column, b: Column) -> Column:
    """Difference column after a pivot, e.g. male - female."""
    return a - b


__all__ = ["internal_external", "signed_metric_long", "add_metric", "expand_probs", "gap", "SIGNS"]
