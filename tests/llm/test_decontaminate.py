"""Operator 12 against brute force."""

import hashlib
import re

import duckdb
import numpy as np

from ascribe.llm import decontaminate
from ascribe.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_in(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for i, text in items:
        ws = words_in(text)
        for k in range(max(1, len(ws) - size + 1) if ws else 0):
            windows.setdefault(tuple(ws[k:k + size]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        ws, hit, found = words_in(text), set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                own = windows.get(tuple(ws[k:k + n]))
                if own is not None:
                    hit.update(range(k, k + n))
                    found |= own
        ids = sorted(str(x) for x in found - {None})
        out.append((i, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed, lengths):
    rng = np.random.default_rng(seed)
    word = lambda: f"W{rng.integers(40)}"
    items = [(k, " ".join(word() for _ in range(int(n)))) for k, n in enumerate(lengths)]
    items += [(100, None), (101, ""), (102, "--- !!"), (3, "Same item, other words: one two three four five six seven"), (None, "no id here but ten words or more to be found"),
              (7, items[2][1]), (8, items[2][1] + " tail words")]
    docs = []
    for k in range(150):
        parts = [word() for _ in range(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 3))):
            ws = words_in(items[rng.integers(len(lengths))][1])
            cut = sorted(rng.integers(0, len(ws) + 1, 2))
            at = int(rng.integers(0, len(parts) + 1))
            parts[at:at] = ws[cut[0]:cut[1]] if rng.random() < 0.7 else ws
        docs.append((k, ("  ", ", ", "\x00\t", "'")[k % 4].join(parts)))
    docs += [(None, items[0][1]), (None, None), (5, "x"), (200, None), (201, ""), (202, items[1][1]), (202, items[1][1]), (202, "other"),
             (203, "No id here -- but TEN words or more to be found, too."), (204, "É é É. " + items[2][1].upper() + " " + "a b " * 20_000 + items[0][1])]
    return docs, items


def test_hits(spark):
    for seed, lengths in ((1, (30, 12, 40, 10, 25)), (2, (30, 1, 12, 9, 5, 4, 2, 7))):
        docs, items = made(seed, lengths)
        table = spark.createDataFrame([(*d, "x", "y", 1, [1]) for d in docs],
                                      "doc_id bigint, text string, key string, spans string, length int, items array<int>").repartition(4)
        bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, class string")
        want = brute(docs, items)
        frame = decontaminate.contamination(table, bench).selectExpr(*COLUMNS[:-1], "n_hit > 0 AS contaminated")
        assert sorted(map(tuple, frame.collect()), key=str) == want
        assert sum(r[-1] for r in want) > 20


def test_shuffled_join_and_empty_tables(spark, monkeypatch):
    docs, items = made(3, (30, 12, 40, 10, 25))
    table, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    got = decontaminate.contamination(table, bench)
    assert sorted(map(tuple, got.selectExpr(*COLUMNS[:-1], "n_hit > 0 AS contaminated").collect()), key=str) == brute(docs, items)
    # the windows found are occurrences, and all of them
    texts = [words_in(t) for _, t in items]
    windows = {tuple(w[k:k + 10]) for w in texts for k in range(len(w) - 9)} | {tuple(w) for w in texts if 0 < len(w) < 10}
    by = dict(docs)
    for r in got.where("doc_id < 150").collect():
        ws = words_in(by[r.doc_id])
        assert [(h.start, h.length) for h in r.hits] == sorted((k, n) for n in {len(w) for w in windows} for k in range(len(ws) - n + 1)
                                                             if tuple(ws[k:k + n]) in windows)
    assert decontaminate.contamination(table.limit(0), bench).count() == 0
    none = decontaminate.contamination(table, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit or r.n_items or r.hits for r in none)


def test_fingerprints_are_few(spark):
    rng = np.random.default_rng(4)
    text = " ".join(str(x) for x in rng.integers(0, 10 ** 6, 5000))
    frame = spark.createDataFrame([(text,)], "text string").withColumn("w", decontaminate.words_of("text"))
    from pyspark.sql import functions as F
    n = frame.select(F.size(decontaminate.stretches(decontaminate.hashed("w"), 10))).first()[0]
    assert n < 5000 * 0.35


def test_query_and_sql(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    frame = QUERIES["op12_decontaminate"](spark, sf_dir)
    assert frame.columns == list(COLUMNS)
    want = brute(docs, items)
    assert sorted(map(tuple, frame.collect()), key=str) == want and any(r[-1] for r in want)
    docs, items = made(5, (30, 1, 12, 9, 5, 4, 2, 7))
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name}({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    rel = con.sql(ORACLE["op12_decontaminate"])
    assert rel.columns == list(COLUMNS) and sorted(rel.fetchall(), key=str) == brute(docs, items)
