"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame,
and the DuckDB SQL of those that SQL can state on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from . import decontaminate, exact, html, langid, merkle, mixing, ngram_join, packing, periodic, quality, secrets, substring, token_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed in order into windows of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@query()
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word window of an earlier document removed."""
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents tokenized into flat files; their lengths found by the separator scan."""
    blocks = token_scan.write_token_files(_table(spark, sf_dir, "documents"), scratch_path(spark, "token_files"))
    return token_scan.document_lengths(blocks)


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of the documents with the forest's probability."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


@query("""
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's exact group, through the digest index."""
    return exact.dedup(_table(spark, sf_dir, "documents"))


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict by weakly supervised rules."""
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query()
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every taken copy of the documents; no source passes its data more than twice as often as the largest."""
    return mixing.plan(_table(spark, sf_dir, "documents"))


@query()
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


@query()
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one in ten made periodic on purpose."""
    return periodic.digests(periodic.find_runs(periodic.plant(_table(spark, sf_dir, "documents"))))


@query(r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    s AS (SELECT item_id, least(len(w), 10) AS n, len(w) AS m, unnest(w) AS p, unnest(range(len(w))) AS i, row_number() OVER () AS k
          FROM b WHERE len(w) > 0),
    u AS (SELECT item_id, n, m, i, array_to_string([p, lead(p, 1) OVER o, lead(p, 2) OVER o, lead(p, 3) OVER o, lead(p, 4) OVER o, lead(p, 5) OVER o, lead(p, 6) OVER o, lead(p, 7) OVER o, lead(p, 8) OVER o, lead(p, 9) OVER o][1:n], ' ') AS x
          FROM s WINDOW o AS (PARTITION BY k ORDER BY i)),
    t AS (SELECT DISTINCT item_id, n, x FROM u WHERE i + n <= m),
    e AS (SELECT rid, len(w) AS m, unnest(w) AS p, unnest(range(len(w))) AS i FROM d),
    v AS (SELECT rid, m, i, [p, lead(p, 1) OVER o, lead(p, 2) OVER o, lead(p, 3) OVER o, lead(p, 4) OVER o, lead(p, 5) OVER o, lead(p, 6) OVER o, lead(p, 7) OVER o, lead(p, 8) OVER o, lead(p, 9) OVER o] AS ws FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
    f AS (SELECT rid, n, i, array_to_string(ws[1:n], ' ') AS x FROM v, (SELECT DISTINCT n FROM t) WHERE i + n <= m),
    h AS (SELECT DISTINCT rid, i, n, item_id FROM f JOIN t USING (n, x)),
    c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
    g AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (rid) LEFT JOIN g USING (rid)
""")
def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.selectExpr("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_hit > 0 AS contaminated")


_CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce([i] || list_transform(range(8), lambda z: 0::BIGINT),
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string in SQL, beside a row of ``_CRC_TABLE``."""
    return f"""xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT),
        lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"""


def _merkle_sql(levels: int = 9) -> str:
    """SQL of operator 13: the tree's levels and the fold up written out, for at most 16 ** levels rows."""
    def leaf(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in fields) + ")"

    def tree(name: str, base: str) -> list[str]:
        parts = [f"{name}0 AS ({base})"]
        for k in range(levels):
            parts.append(f"""{name}{k + 1} AS (SELECT tree, r // 16 AS r, (max(n) + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY r)) AS d
                FROM {name}{k} WHERE n > 1 GROUP BY tree, r // 16)""")
            parts.append(f"""{name}s{k} AS (SELECT a.tree, a.r, coalesce(string_agg(b.d, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS l,
                coalesce(string_agg(b.d, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS g
                FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.r // 16 = b.r // 16 WHERE a.n > 1 GROUP BY a.tree, a.r)""")
        parts.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
        return parts

    changed = "CASE WHEN doc_id IS NOT NULL AND picked THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    parts = [f"""x AS (SELECT doc_id, {leaf('text')} AS leaf, {leaf(changed)} AS changed,
            coalesce('=' || source, '-') AS tree
            FROM (SELECT *, {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 AS picked FROM documents, {_CRC_TABLE}))""",
             "y AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM x)",
             *tree("a", "SELECT tree, r, n, leaf AS d FROM y"),
             "t AS (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n FROM atop)",
             *tree("b", "SELECT 0 AS tree, r, n, d FROM t"),
             "f0 AS (SELECT doc_id, leaf, tree, r AS i, changed AS c, '' AS p FROM y)"]
    for k in range(levels):
        parts.append(f"""f{k + 1} AS (SELECT doc_id, leaf, f.tree, i // 16 AS i, CASE WHEN s.l IS NULL THEN c ELSE sha256(s.l || c || s.g) END AS c,
            CASE WHEN s.l IS NULL THEN p ELSE p || s.l || s.g END AS p FROM f{k} f LEFT JOIN as{k} s ON f.tree = s.tree AND f.i = s.r)""")
    parts.append(f"g0 AS (SELECT doc_id, leaf, t.d AS subroot, t.r AS i, c, p FROM f{levels} f JOIN t ON f.tree = t.tree)")
    for k in range(levels):
        parts.append(f"""g{k + 1} AS (SELECT doc_id, leaf, subroot, i // 16 AS i, CASE WHEN s.l IS NULL THEN c ELSE sha256(s.l || c || s.g) END AS c,
            CASE WHEN s.l IS NULL THEN p ELSE p || s.l || s.g END AS p FROM g{k} g LEFT JOIN bs{k} s ON g.i = s.r)""")
    return (f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT d FROM btop) AS root, sha256(p) AS proof_sha256, c AS folded_root, "
            f"c = (SELECT d FROM btop) AS verified FROM g{levels}")


@query(_merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the dataset's Merkle manifest, and whether it still holds after tampering."""
    return merkle.verify_tampering(_table(spark, sf_dir, "documents"))
