"""Operator 11 against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa

from ascribe.llm import periodic
from ascribe.llm.common import Words
from ascribe.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(ws, least=12):
    """Every maximal stretch of each period, smallest period first."""
    n, out = len(ws), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)               # the same stretch with a smaller period came before
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_planted(i, text):
    ws = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and ws:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
    return ws


def brute_row(i, text):
    ws = brute_planted(i, text)
    runs = brute_runs(ws)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_many_strings():
    rng = np.random.default_rng(11)
    made = [list(fibonacci(n)) for n in (5, 90, 400)] + [["x"] * n for n in (1, 11, 12, 13, 100)]
    made += [list("aabaabaabaab" * 3 + "aab"), list("abcabca" * 9), list("aaaaab" * 7 + "aaaa"), [], ["one"]]
    for _ in range(500):
        n, letters = int(rng.integers(1, 90)), int(rng.integers(1, 4))
        made.append([str(x) for x in rng.integers(0, letters, n)])
    for _ in range(300):                                    # repeated blocks with changed words, cut anywhere
        block = [str(x) for x in rng.integers(0, 3, int(rng.integers(1, 30)))]
        ws = (block * int(rng.integers(2, 6)))[int(rng.integers(0, len(block))):]
        for _ in range(int(rng.integers(0, 3))):
            ws[rng.integers(len(ws))] = "z"
        made.append(["p"] * int(rng.integers(0, 3)) + ws)
    words = Words(pa.array([" ".join(ws) for ws in made]))
    for least in (2, 12):
        got = collections.defaultdict(list)
        for s, m, q in zip(*(x.tolist() for x in periodic.Factors(words).runs(least))):
            row = int(words.doc[s])
            got[row].append((s - int(words.first[row]), m, q))
        for k, ws in enumerate(made):
            assert got[k] == brute_runs(ws, least), ws


def test_query_form(spark):
    rng = np.random.default_rng(12)
    texts = [None, "", " \n\t", "word", "a b " * 40, "x " * 5000, "é ü " * 9 + "end", "one  two\nthree " * 6, "a b " * 40]
    texts += [" ".join(str(x) for x in rng.integers(0, 5000, int(rng.integers(1, 600)))) for _ in range(80)]
    rows = [(i, t, "s", 7) for i, t in enumerate(texts)] + [(None, "u v w " * 8, "s", 7), (3, "another word", "s", 7)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int").repartition(3)
    got = sorted(map(tuple, periodic.digests(periodic.find_runs(periodic.plant(table))).collect()), key=str)
    assert got == sorted((brute_row(r[0], r[1]) for r in rows), key=str)
    found = {r.doc_id: r for r in periodic.find_runs(table.where("doc_id in (4, 6)")).collect()}
    assert found[4].runs == [(0, 80, 2)] and found[4].collapsed == "a b" and found[6].collapsed == "é ü end"
    assert periodic.digests(periodic.find_runs(periodic.plant(table.limit(0)))).count() == 0


def test_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) < 1500}
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert set(got) == {r.doc_id for r in docs} and len(short) > 150
    assert {i: got[i] for i in short} == {i: brute_row(i, t) for i, t in short.items()}
