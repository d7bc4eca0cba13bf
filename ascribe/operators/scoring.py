"""Scores supplied by the caller -> choices, likelihoods and perplexities
(X3-X7, A19-A21, F11, F12).

Model inference is not part of this package: callers either supply a pandas
batch function (run through ``mapInPandas``, Arrow batches, one call per
batch) or a table of token log-probabilities.  Everything after that is
DataFrame work: a unigram language model built with ``explode`` + a hash
aggregate serves as the deterministic stand-in scorer in the tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import capped_exp
from ..schemas import WS
from ..session import materialize


def words(text: str) -> Column:
    """Whitespace tokens (space, tab, CR, LF) of a text; none for a NULL text's NULL."""
    return F.array_remove(F.split(F.col(text), WS + "+"), "")


def tokens(df: DataFrame, id_cols, text: str = "text", out: str = "token") -> DataFrame:
    """One row per whitespace token of a text column."""
    return df.select(*id_cols, F.explode(words(text)).alias(out))


def token_counts(seq_tokens: DataFrame, keys, token: str = "token") -> DataFrame:
    """(sequence keys, token, c): tokens counted per sequence first, so a hot
    token costs one partial row per map task, not one row per occurrence."""
    return seq_tokens.groupBy(*keys, token).agg(F.count("*").alias("c"))


def unigram_model(counts: DataFrame, token: str = "token", c: str = "c") -> tuple[DataFrame, Column]:
    """Add-one smoothed unigram model from token counts (per sequence or
    not): ``(token, cnt, lp)`` and the log-prob of an unseen token.
    lp = ln((cnt + 1) / (N + V)) with N tokens and V types; N and V come from
    one scalar subquery over the written vocabulary."""
    # written once to the shared checkpoint folder: the denominator subquery
    # and the model join then read it instead of re-tokenising the corpus
    vocab = materialize(counts.groupBy(token).agg(F.sum(c).alias("cnt")), "unigram-vocab")
    # one scalar subquery (N + V); identical references are reused, not re-run
    denom = vocab.select((F.sum("cnt") + F.count(F.lit(1))).cast("double")).scalar()
    model = vocab.select(token, "cnt", F.log((F.col("cnt") + 1).cast("double") / denom).alias("lp"))
    unseen = F.log(F.lit(1.0) / denom)
    return model, unseen


HEAVY_SHARE = 2_000            # a token with more than 1 / HEAVY_SHARE of all tokens is heavy: fewer than HEAVY_SHARE are


def sequence_logprob(counts: DataFrame, model: DataFrame, unseen: Column, keys,
                     token: str = "token") -> DataFrame:
    """Per-sequence token count and summed log-probability (A21, log space),
    from ``token_counts`` joined to the model on ``token`` (AQE splits a
    skewed token partition of the join)."""
    keys = list(keys)
    j = counts.join(model.select(token, "lp"), token, "left")
    lp = F.coalesce(F.col("lp"), unseen)
    return j.groupBy(*keys).agg(F.sum("c").alias("n_tokens"), F.sum(F.col("c") * lp).alias("log_prob"))


def corpus_logprob(df: DataFrame, keys, text: str = "text", model: DataFrame | None = None, unseen: Column | None = None,
                   heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """``sequence_logprob`` of every sequence of a corpus under the corpus' own
    model (or one given), rows without a token included (0 tokens, NULL sum).

    A natural vocabulary has tokens that are in nearly every sequence.  Tokens
    with more than 1 / heavy_share of all occurrences (so fewer than
    heavy_share of them, a proven bound) are broadcast and summed where they
    stand; only the rest are shuffled by token and joined, and none of
    those can fill a partition."""
    keys = list(keys)
    if model is None:
        model, unseen = unigram_model(token_counts(tokens(df.select(text), [], text), []))
    total = model.agg(F.sum("cnt")).scalar()
    heavy = materialize(model.where(F.col("cnt") * heavy_share > total).select("token", "lp"), "heavy-tokens")
    light = model.where(F.col("cnt") * heavy_share <= total).select("token", "lp")
    # explode_outer: a sequence without a token keeps a row, with a NULL token
    marked = (df.select(*keys, F.explode_outer(words(text)).alias("token"))
              .join(F.broadcast(heavy.select("token", F.col("lp").alias("_lp"))), "token", "left"))
    here = marked.where("_lp is not null or token is null")
    summed = here.groupBy(*keys).agg(F.count("token").alias("n_tokens"), F.sum("_lp").alias("log_prob"))
    # most light tokens stand once in a sequence: counting them there first would shuffle as many rows
    rest = sequence_logprob(marked.where("_lp is null and token is not null").select(*keys, "token", F.lit(1).alias("c")),
                            light, unseen, keys)
    return summed.unionByName(rest).groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("log_prob").alias("log_prob"))


def perplexity(n_tokens: Column, log_prob: Column) -> Column:
    """A20 + F11: exp(mean negative log-likelihood), +inf when the loss >= 20."""
    return capped_exp(-log_prob / n_tokens)


def normalised_likelihood(seq: DataFrame, group, n_tokens: str = "n_tokens",
                          log_prob: str = "log_prob", out: str = "prob") -> DataFrame:
    """Per option exp(mean token log-prob), normalised to sum 1 within
    its trial.  The window runs over a trial's few option rows only."""
    lik = F.exp(F.col(log_prob) / F.col(n_tokens))
    s = seq.withColumn("_lik", lik)
    return s.withColumn(out, F.col("_lik") / F.sum("_lik").over(Window.partitionBy(*group))).drop("_lik")


def row_by_row(pdf: pd.DataFrame, call: Callable[[pd.DataFrame], list]) -> tuple[list, list]:
    """``call(batch)`` (one value per row, in order) -> values and errors
    per row.  When the batch fails its rows are called one by one, so only
    the rows that fail themselves have no value."""
    try:
        return call(pdf), [None] * len(pdf)
    except Exception:  # noqa: BLE001
        values, errors = [], []
        for i in range(len(pdf)):
            try:
                values += call(pdf.iloc[i:i + 1].reset_index(drop=True))
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                values.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return values, errors


SCORE_SCHEMA = T.StructType([
    T.StructField("trial_id", T.StringType()),
    T.StructField("probs", T.ArrayType(T.DoubleType())),
    T.StructField("error", T.StringType()),
])


def score_options(trials: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame],
                  cols=("trial_id", "prompt", "options")) -> DataFrame:
    """X3 + X7: run a caller-supplied batch scorer over the trials.

    ``scorer(pdf)`` receives a pandas batch with ``cols`` and returns
    ``trial_id, probs (list of floats)``; after an exception the batch's rows
    are scored one by one, and a row that fails is marked (``probs`` NULL,
    ``error`` set) instead of dropped.  Results are joined back by ``trial_id``, never by position.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(pdf: pd.DataFrame) -> list:
            res = scorer(pdf)
            if len(res) != len(pdf):
                raise ValueError(f"scorer returned {len(res)} rows for {len(pdf)}")
            return [(i, [float(x) for x in p] if p is not None else None) for i, p in zip(res["trial_id"], res["probs"])]
        for pdf in batches:
            got, errors = row_by_row(pdf, call)
            yield pd.DataFrame({"trial_id": [t if g is None else g[0] for g, t in zip(got, pdf["trial_id"])],
                                "probs": [None if g is None else g[1] for g in got], "error": errors})
    return trials.select(*cols).mapInPandas(run, SCORE_SCHEMA)


SCORED = T.StructType([
    T.StructField("probs", T.ArrayType(T.DoubleType())),
    T.StructField("error", T.StringType()),
])


def score_column(scorer: Callable[[pd.DataFrame], list], **cols: Column) -> Column:
    """X3 + X7 as a column: a vectorised (Arrow-batched) pandas UDF that
    calls ``scorer(pdf)`` with the named input columns of a batch and expects
    one probability list per row, in batch order (the pandas-UDF contract).
    The result stays in the row it was computed for, so no re-attachment
    join is needed; a failing row yields ``probs`` NULL and the error.
    """
    names = list(cols)

    @F.pandas_udf(SCORED)
    def _score(*series: pd.Series) -> pd.DataFrame:
        pdf = pd.concat([s_.rename(n) for n, s_ in zip(names, series)], axis=1)
        def call(part: pd.DataFrame) -> list:
            probs = [list(map(float, p)) for p in scorer(part)]
            if len(probs) != len(part):
                raise ValueError(f"scorer returned {len(probs)} rows for {len(part)}")
            return probs
        probs, errors = row_by_row(pdf, call)
        return pd.DataFrame({"probs": probs, "error": errors})

    return _score(*[cols[n] for n in names])


GEN_SCHEMA = T.StructType([
    T.StructField("trial_id", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
])


def generate(trials: DataFrame, generator: Callable[[pd.DataFrame], pd.Series],
             cols=("trial_id", "prompt")) -> DataFrame:
    """A caller-supplied text generator (local model or remote
    client) over Arrow batches; failures are kept with their error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(pdf: pd.DataFrame) -> list:
            out = list(generator(pdf))
            if len(out) != len(pdf):
                raise ValueError(f"generator returned {len(out)} rows for {len(pdf)}")
            return out
        for pdf in batches:
            out, errors = row_by_row(pdf, call)
            yield pd.DataFrame({"trial_id": pdf["trial_id"], "response": out, "error": errors})
    return trials.select(*cols).mapInPandas(run, GEN_SCHEMA)


GENERATED = T.StructType([
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
])


def generate_column(generator: Callable[[pd.DataFrame], list], **cols: Column) -> Column:
    """X4 / X6 as a column: a pandas UDF calling ``generator(pdf)`` on each
    Arrow batch (one text per row, batch order); a failing row yields a NULL
    response with the error kept."""
    names = list(cols)

    @F.pandas_udf(GENERATED)
    def _gen(*series: pd.Series) -> pd.DataFrame:
        pdf = pd.concat([s_.rename(n) for n, s_ in zip(names, series)], axis=1)
        def call(part: pd.DataFrame) -> list:
            out = [None if r is None else str(r) for r in generator(part)]
            if len(out) != len(part):
                raise ValueError(f"generator returned {len(out)} rows for {len(part)}")
            return out
        out, errors = row_by_row(pdf, call)
        return pd.DataFrame({"response": out, "error": errors})

    return _gen(*[cols[n] for n in names])
