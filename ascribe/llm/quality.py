"""Quality rules combined by weak supervision (operator 7), DataFrame functions only.

Each rule votes good, bad or abstains on a document.  Expectation-maximisation
over the table of vote patterns (at most 3 ** rules rows, whatever the corpus)
estimates how often each rule casts each vote on good and on bad documents;
a document is kept when its posterior probability of being good reaches the
threshold.  No rule alone can reject a document, but for the base limits
(too few words, too many repeated windows).

Defined cases: a null or empty text has no words, so it fails the base limits
and is not kept; a null ``doc_id`` is an ordinary value; repeated rows are
judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RULES = ("length", "symbols", "symbol_words", "lines", "repeats", "word_length", "capitals", "exclaims", "letters")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
THRESHOLD = 0.5


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, not per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: str | Column) -> Column:
    """Words of a text: runs of characters other than 0x20 and 0x09-0x0D."""
    c = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(F.coalesce(c, F.lit("")), SEPARATORS[1:], " " * (len(SEPARATORS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def repeated_words(words: Column, k: int = 5) -> Column:
    """Number of words inside k-word windows that occur twice or more in the
    text.  Windows are named by 64-bit hashes; only a text with a repeated
    name is sorted.  Starts of repeated windows, in order, each cover k words
    less the overlap with the next."""
    def covered(names: Column) -> Column:
        pairs = F.array_sort(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            hit = F.filter(p, lambda e, i: (F.get(p, i - 1)["h"] == e["h"]) | (F.get(p, i + 1)["h"] == e["h"]))
            return F.array_sort(F.transform(hit, lambda e: e["i"]))

        def total(s: Column) -> Column:
            return F.aggregate(F.transform(s, lambda e, i: F.least(F.coalesce(F.get(s, i + 1) - e, F.lit(k)), F.lit(k))),
                               F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        return let(let(pairs, starts), total)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k),
                           lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def count(h: Column) -> Column:
        return F.when(F.size(h) < k + 1, F.lit(0).cast("bigint")).otherwise(
            let(windows(h), lambda n: F.when(F.size(F.array_distinct(n)) == F.size(n), F.lit(0).cast("bigint"))
                .otherwise(covered(n))))
    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the counts that the rules read, one row per document."""
    t = F.coalesce(F.col(text), F.lit(""))

    def without(chars: str) -> Column:
        return F.length(F.translate("_t", chars, "")).cast("bigint")
    wordy = F.filter(F.split("_t", "\n"), lambda line: F.length(F.translate(line, SEPARATORS, "")) > 0)
    lines = let(wordy, lambda x: F.struct(F.size(x).cast("bigint").alias("n"),
                                          (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
    words = let(words_of("_t"), lambda w: F.struct(F.size(w).cast("bigint").alias("n"),
                                                   repeated_words(w).alias("repeat")))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (docs.select("doc_id", t.alias("_t"))
            .select("doc_id", F.xxhash64("_t").alias("text_key"), words.alias("_w"), lines.alias("_l"),
                    without(SEPARATORS).alias("word_chars"),
                    (F.length("_t") - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
                    (F.length("_t") - without(upper)).cast("bigint").alias("n_upper"),
                    (F.length("_t") - without("!")).cast("bigint").alias("n_exclaim"),
                    (F.length("_t") - without("0123456789")).cast("bigint").alias("n_digits"))
            .select("doc_id", "text_key", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols",
                    F.col("_l.dup").alias("n_dup_lines"), F.col("_w.repeat").alias("n_repeat_words"),
                    F.col("_l.n").alias("n_lines"), "n_upper", "n_exclaim", "n_digits"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> list[Column]:
    """One column per rule: 1 good, -1 bad, 0 abstains."""
    words, chars = F.col("n_words"), F.col("word_chars")
    long = words >= 30
    by_rule = {
        "length": _vote(words < MIN_WORDS, words.between(50, 100_000)),
        "symbols": _vote(F.col("n_symbols") * 10 > chars, F.col("n_symbols") * 50 <= chars),
        "symbol_words": _vote(F.col("n_symbols") * 3 > words, F.col("n_symbols") * 10 <= words),
        "lines": _vote(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 2)),
        "repeats": _vote(F.col("n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT, (F.col("n_repeat_words") * 50 <= words) & long),
        "word_length": _vote(long & ((chars < words * 3) | (chars > words * 12)), long & chars.between(words * 4, words * 9)),
        "capitals": _vote(F.col("n_upper") * 2 > chars, F.col("n_upper") * 10 <= chars),
        "exclaims": _vote(F.col("n_exclaim") * 20 > chars, F.col("n_exclaim") * 200 <= chars),
        "letters": _vote((F.col("n_digits") + F.col("n_symbols")) * 8 > chars,
                         (F.col("n_digits") + F.col("n_symbols")) * 20 <= chars),
    }
    return [by_rule[r].alias(f"vote_{r}") for r in RULES]


def fit(patterns: list[tuple[tuple[int, ...], int]], steps: int = 50, prior_good: float = 0.9,
        weight: float = 0.05) -> tuple[float, list[tuple[float, float]]]:
    """EM over (vote pattern, number of documents).  Returns the share of good
    documents and, per rule, the accuracy of its votes on good and on bad
    documents: how often a vote that is cast says good, or says bad.

    An abstention is no evidence.  Pseudo-counts (``weight`` of the documents)
    keep the classes named: rules seldom call a good document bad, and a bad
    one trips some rules, not all."""
    total = sum(n for _, n in patterns)
    start = (0.98, 0.35)
    good, rates = prior_good, [start] * len(RULES)
    pseudo = max(1.0, weight * total)
    for _ in range(steps if total else 0):
        right = [[0.0, 0.0] for _ in RULES]
        cast = [[0.0, 0.0] for _ in RULES]
        mass = 0.0
        for pattern, n in patterns:
            p = posterior(pattern, good, rates)
            mass += n * p
            for r, v in enumerate(pattern):
                if v:
                    cast[r][0] += n * p
                    cast[r][1] += n * (1 - p)
                    right[r][v < 0] += n * (p if v > 0 else 1 - p)
        good = (mass + pseudo * prior_good) / (total + pseudo)
        rates = [tuple((right[r][c] + pseudo * start[c]) / (cast[r][c] + pseudo) for c in (0, 1))
                 for r in range(len(RULES))]
    return good, rates


def vote_weights(rate: tuple[float, float]) -> dict[int, float]:
    """Log-odds of good that a rule's vote adds."""
    on_good, on_bad = rate
    return {1: log(on_good / (1 - on_bad)), 0: 0.0, -1: log((1 - on_good) / on_bad)}


def posterior(pattern: tuple[int, ...], good: float, rates: list[tuple[float, float]]) -> float:
    odds = log(good / (1 - good)) + sum(vote_weights(r)[v] for r, v in zip(rates, pattern))
    return 1 / (1 + exp(-odds))


def judge(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with its counts, votes, posterior and verdict."""
    from ..session import materialize
    table = materialize(features(docs, text).select("*", *votes()), "quality")
    names = [f"vote_{r}" for r in RULES]
    counted = table.groupBy(*names).count().collect()           # at most 3 ** len(RULES) rows
    good, rates = fit([(tuple(r[:-1]), r["count"]) for r in sorted(counted)])
    odds = F.lit(log(good / (1 - good)))
    for rule, rate in zip(RULES, rates):
        weight = vote_weights(rate)
        odds = odds + (F.when(F.col(f"vote_{rule}") == 1, weight[1]).when(F.col(f"vote_{rule}") == -1, weight[-1])
                       .otherwise(0.0))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return (table.withColumn("posterior", 1 / (1 + F.exp(-odds)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their
    names.  The verdict is the text's, so rows that share an id, or have none,
    are each judged by their own text."""
    kept = judge(docs, text, threshold).where("kept").select(F.col("doc_id").alias("id"), "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    same = rows["own"].eqNullSafe(kept["id"]) & (rows["key"] == kept["text_key"])
    return rows.join(kept, same, "left_semi").select("row.*")
