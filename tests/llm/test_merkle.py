"""Operator 13 against brute force."""

import hashlib
import zlib

import duckdb

from ascribe.llm import merkle
from ascribe.llm.queries import ORACLE, QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, rank int, tree string, digest string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(row):
    i, text = row[0], row[4]
    if i is None or text is None or zlib.crc32(str(i).encode()) % 5:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def tree_of(digests):
    """Top, and per leaf its siblings (left, right) by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, i in enumerate(at):
            low = i // 16 * 16
            paths[k].append(("".join(digests[low:i]), "".join(digests[i + 1:low + 16])))
        digests = [sha("".join(digests[i:i + 16])) for i in range(0, len(digests), 16)]
        at = [i // 16 for i in at]
    return digests[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows in the order of FIELDS."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    tops, out = [], []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda x: x[:3])
        top, paths = tree_of([x[2] for x in own])
        tops.append((top, own, paths))
    root, above = tree_of([t[0] for t in tops])
    for (top, own, paths), up in zip(tops, above):
        for (_, _, leaf, r), path in zip(own, paths):
            folded = leaf_of(lowered(r))
            for left, right in path + up:
                folded = sha(left + folded + right)
            out.append((r[0], leaf, top, root, sha("".join(a + b for a, b in path + up)), folded, folded == root))
    return sorted(out, key=str)


def made():
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", "en", i, f"Text {i} é") for i in range(700)]
    rows += [(None, None, None, None, None), (1000, None, "de", 3, None), (5, "lone", None, 1, ""), (5, "hot", "en", 1, "other"),
             (6, "hot", "en", 6, "Text 6 é"), (6, "hot", "en", 6, "Text 6 é"), (None, "hot", "en", 2, "ABC"), (-40, "É", "en", 2, "X" * 300_000)]
    rows += [(2000, "twice", "en", 1, "A b")] * 40                       # equal rows fill whole nodes
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, s, n, "x", 1, "y", "z") for i, s, l, n, t in rows], SCHEMA).repartition(5)


def test_tampering_is_found(spark):
    rows = made()
    for part in (rows, rows[:1], rows[700:703], rows[:16], rows[:17]):
        got = sorted(map(tuple, merkle.verify_tampering(frame(spark, part)).collect()), key=str)
        assert got == brute(part)
    assert merkle.verify_tampering(frame(spark, [])).count() == 0


def test_records_are_content_addressed_and_requests_are_answered(spark):
    rows = made()
    manifest = merkle.build_manifest(frame(spark, rows))
    records = {r.digest: r.children for r in manifest.records.collect()}
    assert all(sha(children) == digest for digest, children in records.items())
    root = manifest.root.collect()[0].root
    asked = manifest.leaves.where("doc_id in (5, 699, 2000) or doc_id is null")
    got = merkle.prove(manifest, asked).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 5)] * 3 + [(False, 699)] + [(False, 2000)] * 40 + [(True, 0)] * 2
    for r in got:
        digest = r.leaf
        for left, right in r.path:
            digest = sha(left + digest + right)
            assert digest in records
        assert digest == r.root == root
    assert merkle.prove(manifest, manifest.leaves.limit(0)).count() == 0


def test_query_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS).collect()]
    got = QUERIES["op13_merkle_manifest"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", made()[650:])
    rel = con.sql(ORACLE["op13_merkle_manifest"])
    assert rel.columns == got.columns and sorted(rel.fetchall(), key=str) == brute(made()[650:])
