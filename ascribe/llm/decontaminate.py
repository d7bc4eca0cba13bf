"""Benchmark decontamination by winnowing (operator 12), DataFrame functions only.

Words are runs of digits, ASCII letters (lower-cased) and characters beyond
ASCII.  A window is ``WINDOW`` consecutive words of a benchmark item; an item
of fewer words, but not none, is one window.  A document word inside any
occurrence of a window is hit.

Winnowing stands each window for the least hash of its ``GRAM``-word grams.
Neighbouring windows mostly share that gram, so a document is described by
about one fingerprint per (window - gram) / 2 words; and as documents and items
are winnowed alike, any shared window, hence any shared span of ``WINDOW``
words or more, has its fingerprint on both sides:

1. documents become fingerprints, each with the stretch of windows it stands
   for; those that the benchmark has too are kept;
2. the stretches are extended to their windows, which are named (128 bits)
   and looked up among the benchmark's windows;
3. per document, the windows found cover words; the items of a window are a
   class (its set of items), the classes of a document a combination, and each
   combination of classes is resolved once, however many documents have it.

Items shorter than a window are winnowed at their own length, so the
documents are fingerprinted once per length that the benchmark has (at most
``WINDOW`` lengths).  The benchmark's fingerprints are broadcast when they are
counted to be at most ``BROADCAST_ROWS``, else both sides are shuffled; so are
the keys of the documents whose texts are read again in step 2.

Defined cases: a null text has no words; a null ``doc_id`` is an ordinary
value; repeated rows are answered each; a null ``item_id`` marks words but is
neither listed nor counted; rows that repeat an ``item_id`` are one item with
the windows of all; an empty benchmark hits nothing; an empty document table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .quality import let

WINDOW = 10
GRAM = 5
BROADCAST_ROWS = 500_000       # fingerprints (12 bytes each) or document keys (16) that may be broadcast, counted beforehand
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: str | Column) -> Column:
    """Lower-cased words of a text; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(F.coalesce(c, F.lit("")), _GAPS + _UPPER, " " * len(_GAPS) + _UPPER.lower())
    return F.array_remove(F.split(spaced, " "), "")


def hashed(words: str | Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _sliding(values: Column, width: int, both) -> Column:
    """``both`` folded over every ``width`` neighbours, for an operation that
    may see a value twice: by doubling, then one overlapping step."""
    def step(v: Column, by: int) -> Column:
        return let(v, lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - by, F.lit(0))), F.slice(x, by + 1, F.size(x)), both))
    have = 1
    while 2 * have <= width:
        values, have = step(values, have), 2 * have
    return step(values, width - have) if have < width else values


def minima(hashes: Column, length: int, gram: int = GRAM) -> Column:
    """The fingerprint of every window of ``length`` words: its least gram hash."""
    k = min(gram, length)
    grams = _sliding(hashes, k, lambda a, b: F.xxhash64(a, b))
    return _sliding(grams, length - k + 1, lambda a, b: F.least(a, b))


def stretches(hashes: Column, length: int, gram: int = GRAM) -> Column:
    """``length, print, first, last``: each fingerprint with the neighbouring windows it stands for."""
    def runs(m: Column) -> Column:
        def spans(at: Column) -> Column:
            return F.transform(at, lambda s, i: F.struct(
                F.lit(length).alias("length"), F.get(m, s).alias("print"), s.alias("first"),
                (F.coalesce(F.get(at, i + 1), F.size(m)) - 1).alias("last")))
        changes = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: ~F.get(m, i).eqNullSafe(F.get(m, i - 1)))
        return F.when(F.size(m) > 0, let(changes, spans))
    empty = F.expr("cast(array() as array<struct<length:int,print:bigint,first:int,last:int>>)")
    return F.when(F.size(hashes) >= length, F.coalesce(let(minima(hashes, length, gram), runs), empty)).otherwise(empty)


def _names(words: Column, at: Column, length: Column) -> tuple[Column, Column]:
    """128-bit name of the window of ``length`` words at place ``at``."""
    window = F.slice(words, at + 1, length)
    return F.xxhash64(window).alias("a"), F.xxhash64(F.lit("second"), window, F.lit(1)).alias("b")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "item_id") -> DataFrame:
    """One row per distinct window: ``length, print, a, b``, its items and their class."""
    items = benchmark.select(F.col(key).cast("string").alias("item"), words_of(text).alias("w")).where(F.size("w") > 0)
    sized = items.withColumn("h", hashed("w")).withColumn("length", F.least(F.size("w"), F.lit(window)))
    prints = reduce(lambda rest, n: F.when(F.col("length") == n, minima(F.col("h"), n, gram)).otherwise(rest),
                    range(1, window), minima(F.col("h"), window, gram))
    each = F.transform(prints, lambda p, i: F.struct(p.alias("print"), *_names(F.col("w"), i, F.col("length"))))
    rows = sized.select("item", "length", F.explode(each).alias("x")).select("item", "length", "x.*")
    found = rows.groupBy("length", "print", "a", "b").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.withColumn("class", F.sha2(F.to_json("items"), 256))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text",
                  key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items``
    (ids as strings, sorted as such), ``items_sha256`` and ``hits``, the
    windows found (start, length)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    targets = materialize(benchmark_windows(benchmark, window, gram), "windows")
    lengths = sorted(r[0] for r in targets.select("length").distinct().collect())       # at most ``window``
    prints = materialize(targets.select("length", "print").distinct(), "prints")

    def described(w: Column) -> Column:
        marks = let(hashed(w), lambda h: F.concat(*[stretches(h, n, gram) for n in lengths]) if lengths else
                    F.expr("cast(array() as array<struct<length:int,print:bigint,first:int,last:int>>)"))
        return F.struct(F.size(w).cast("bigint").alias("n_words"), marks.alias("marks"))
    described_docs = materialize(rows.select("doc_id", "key", let(words_of("text"), described).alias("x"))
                                 .select("doc_id", "key", "x.*"), "fingerprints")
    # 1. fingerprints that the benchmark has
    marks = described_docs.select("doc_id", "key", F.explode("marks").alias("m")).select("doc_id", "key", "m.*")
    few = prints.count() <= BROADCAST_ROWS
    shared = marks.join(F.broadcast(prints) if few else prints, ["length", "print"])
    spans = materialize(shared.groupBy("doc_id", "key").agg(F.collect_set(F.struct("length", "first", "last")).alias("spans")), "spans")
    # 2. their windows
    wanted = spans.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "spans")
    places = F.flatten(F.transform("spans", lambda s: F.transform(F.sequence(s["first"], s["last"]),
                                                                  lambda i: F.struct(s["length"].alias("length"), i.alias("start")))))
    named = let(words_of("text"), lambda w: F.transform(places, lambda p: F.struct(
        p["length"].alias("length"), p["start"].alias("start"), *_names(w, p["start"], p["length"]))))
    # only the texts of documents with a shared fingerprint are moved, if their keys are few
    keys = spans.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
    some = rows.join(F.broadcast(keys) if spans.count() <= BROADCAST_ROWS else keys, same, "left_semi")
    windows = (some.join(wanted, same)
               .select("doc_id", "key", F.explode(named).alias("x")).select("doc_id", "key", "x.*"))
    found = windows.join(targets.select("length", "a", "b", "class"), ["length", "a", "b"])
    # 3. words covered and combinations of classes
    per_doc = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits"),
                                                 F.array_sort(F.collect_set("class")).alias("classes"))
    per_doc = materialize(per_doc.withColumn("combination", F.sha2(F.array_join("classes", ","), 256)), "found")
    classes = targets.select("class", "items").dropDuplicates(["class"])
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    combinations = materialize(
        per_doc.select("combination", "classes").dropDuplicates(["combination"])
        .select("combination", F.explode("classes").alias("class")).join(classes, "class")
        .groupBy("combination").agg(items.alias("items")), "combinations")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("hits", start, lambda acc, x: F.struct(
        F.greatest(acc["end"], x["start"] + x["length"]).alias("end"),
        (acc["n"] + F.greatest(x["start"] + x["length"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n")))["n"]
    known = per_doc.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "hits", covered.alias("n_hit"), "combination")
    joined = (described_docs.select("doc_id", "key", "n_words")
              .join(known, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
              .join(combinations, "combination", "left"))
    ids = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                         F.size(ids).cast("bigint").alias("n_items"), ids.alias("items"),
                         F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                         F.coalesce("hits", F.expr("cast(array() as array<struct<start:int,length:int>>)")).alias("hits"))
