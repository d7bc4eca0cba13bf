"""Buckets of the n-gram join that hold many components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ascribe.llm import ngram_join as N

from test_operators_llm import brute_near, words


@pytest.mark.parametrize("percent", [50, 80, 90, 99, 100])
def test_linked_sets_agree_in_a_cell(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 97, 250, 1200]:
        for _ in range(6):
            base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            drop = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            add = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            sets = [np.unique(base), np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 64, add, dtype=np.uint64)]))]
            common = len(np.intersect1d(*sets))
            if not len(sets[1]) or 100 * common < percent * (len(sets[0]) + len(sets[1]) - common):
                continue
            names = np.concatenate(sets)
            doc = np.repeat([1, 3], [len(sets[0]), len(sets[1])])       # rows 0, 2 and 4 are empty sets
            cell, row = N.signatures(names, doc, 5, percent)
            assert set(row.tolist()) <= {1, 3}
            assert set(cell[row == 1].tolist()) & set(cell[row == 3].tolist())


def test_no_rows_and_empty_rows():
    none = np.zeros(0, np.uint64)
    for rows in (0, 3):
        cell, row = N.signatures(none, np.zeros(0, np.int64), rows, 90)
        assert len(cell) == 0 and len(row) == 0


def test_components_when_every_bucket_is_large(spark, monkeypatch):
    monkeypatch.setattr(N, "OUTSIDE", 0)
    monkeypatch.setattr(N, "_fewer", lambda some, others: True)
    rng = np.random.default_rng(11)
    made = []
    for g in range(8):
        text = words(int(rng.integers(12, 150)), 700 + g).split()
        for _ in range(25):
            for _ in range(int(rng.integers(0, 3))):
                text[rng.integers(len(text))] = f"n{rng.integers(10 ** 6)}"
            made.append((len(made), " ".join(text)))
    made += [(len(made) + i, t) for i, t in enumerate([None, "", "a", "a b", "a b c", "a b c d"])]
    for k, percent in ((3, 90), (1, 60)):
        got = N.near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string"), k, percent).collect()
        assert {tuple(r)[:3] for r in got} == brute_near(made, k, percent)


def test_pairs_grow_with_a_bucket_of_unrelated_short_texts(spark):
    """10,000 texts of 12 shingles with one in common: all pairs would be 50 million."""
    many = 10_000
    text = F.concat(F.lit("a b c"), *[F.concat(F.lit(" "), F.md5(F.concat("id", F.lit(f"-{i}")))) for i in range(11)])
    docs = spark.range(many).select(F.col("id").alias("doc_id"), text.alias("text"))
    members = N._members(docs, 3).where("slot is null")
    placed = members.select(F.lit(1).cast("bigint").alias("shingle"), "doc_id", "n", F.lit(0).alias("pos"), F.col("doc_id").alias("component"))
    known = members.select("doc_id", "a")
    assert N._left_over(docs, placed, known, 3, 90).count() < many
