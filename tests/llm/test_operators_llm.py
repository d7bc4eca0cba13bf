"""The training-data operators against brute force on small fixtures with awkward rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ascribe.llm import exact, html, langid, mixing, ngram_join, packing, quality, secrets, substring, token_scan
from ascribe.llm.queries import ORACLE, QUERIES
from ascribe.llm.tokens import ChunkTokenizer, vocabulary_json

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, salt):
    return " ".join(f"w{(i * 7919 + salt * 104729) % 100003}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    base, other = words(400, 1), words(300, 2)
    near = base.replace(base.split()[200], "changed", 1)
    texts = [base, base, near, other, other[:900] + " " + words(80, 3), None, "", "  \n\t ", "one two", "One Two", "a " * 3000,
             "line one here now\n" * 40, words(20, 4) + ' token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0" ' + words(20, 5),
             "key 1234567812345678 end", "x" * 5000, words(12000, 6), base]
    out = [(i, t, "en" if i % 2 else None, "hot" if i % 3 else None, len(t or ""), 0, "k") for i, t in enumerate(texts)]
    out.append((None, base, "en", "s", 0, 0, "k"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    got = sorted(map(tuple, exact.dedup(docs).collect()), key=str)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact.dedup(empty).count() == 0
    kept = exact.keep_largest(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_digest_index_persists(spark, docs, tmp_path):
    exact.create_index(spark, "kept_digests", str(tmp_path / "index"), 4)
    exact.append_new(exact.groups(docs), "kept_digests")
    n = spark.table("kept_digests").count()
    exact.append_new(exact.groups(docs), "kept_digests")              # the same load again
    assert spark.table("kept_digests").count() == n
    spark.sql("DROP TABLE kept_digests")
    exact.create_index(spark, "kept_digests", str(tmp_path / "index"), 4)
    exact.append_new(exact.groups(spark.createDataFrame([(99, "new text")], "doc_id bigint, text string")), "kept_digests")
    assert spark.table("kept_digests").count() == n + 1
    spark.sql("DROP TABLE kept_digests")


def brute_counts(t):
    t = t or ""
    ws = WORD.findall(t)
    seen = collections.Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    cover = {p for i in range(len(ws) - 4) if seen[tuple(ws[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def test_quality(docs, rows, empty):
    got = quality.judge(docs).collect()
    counts = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert counts == collections.Counter((r[0], *brute_counts(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_quality_finds_labelled_junk(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").fetchall()
    bad = [kept[i] for i, q in labels if q == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_mixing(spark, docs, empty):
    plan = mixing.plan(docs).collect()
    ids = collections.Counter(r.doc_id for r in plan)
    assert {r.doc_id for r in plan} == {*range(17), None} and max(ids.values()) <= 2
    assert mixing.plan(empty).count() == 0
    table = spark.createDataFrame([(i, "a b c d", f"s{i % 3 if i < 90 else 0}") for i in range(300)], "doc_id bigint, text string, source string")
    for t, kind, budget in ((0.9, "entropy", 400), (2.0, "repetition", None)):
        rows = mixing.plan(table, kind, t, budget).collect()
        total = sum(r.n_tokens for r in rows)
        for s in ("s0", "s1", "s2"):
            share = sum(r.n_tokens for r in rows if r.source == s) / total
            weight = next(r.weight for r in rows if r.source == s)
            assert abs(share - weight) < 0.03
        if budget:
            assert budget - 12 <= total <= budget
            w = {r.source: r.weight for r in rows}
            assert abs(-sum(x * np.log(x) for x in w.values()) - t) < 1e-3
    assert mixing.mix(table).columns == table.columns


def test_packing(docs, rows, empty):
    got = packing.pack(docs, partitions=2).collect()
    tokenizer = ChunkTokenizer(vocabulary_json())
    from tokenizers import Tokenizer
    plain = Tokenizer.from_str(vocabulary_json())
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, text, *_ in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (tokenizer.encode([text])[0] == ids[:-1]).all()
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)
    assert packing.pack(empty).count() == 0


def test_packing_program_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 14))))
        penalty = rng.integers(0, 4, 15)

        def cost(a, b):
            n = int(places[b] - places[a])
            return (0 if n in (8, 16) else 16 - n) + int(penalty[b]) if n <= 16 else 10 ** 9
        best = [0] + [10 ** 9] * 14
        for j in range(1, 15):
            best[j] = min(best[i] + cost(i, j) for i in range(j))
        cuts = [0, *np.searchsorted(places, packing.best_windows(places, penalty, 16)).tolist()]
        assert sum(cost(a, b) for a, b in zip(cuts, cuts[1:])) == best[14]


def test_substring(spark, docs, rows, empty):
    def brute(rows):
        first = {}
        for i, t in sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0]):
            ws = WORD.findall(t or "")
            for j in range(len(ws) - 49):
                first.setdefault(tuple(ws[j:j + 50]), i)
        out = []
        for i, t, *_ in rows:
            ws = WORD.findall(t or "")
            gone = {p for j in range(len(ws) - 49) if i is not None and first[tuple(ws[j:j + 50])] < i for p in range(j, j + 50)}
            out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()).hexdigest()))
        return out
    assert sorted(map(tuple, substring.remove_repeats(docs).collect()), key=str) == sorted(brute(rows), key=str)
    assert substring.remove_repeats(empty).count() == 0
    # passages of 40 to 80 words at odd places, and periodic texts
    rng = np.random.default_rng(5)
    pool = [words(int(n), 50 + k) for k, n in enumerate(rng.integers(40, 80, 12))] + ["ab ba " * 40, "z " * 70]
    made = [(k, " ".join(x for _ in range(4) for x in (words(int(rng.integers(0, 60)), 1000 + 7 * k), pool[rng.integers(len(pool))])))
            for k in range(60)]
    got = substring.remove_repeats(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(made))


def brute_near(rows, k=3, percent=90):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            ws = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
            sets[i] = {tuple(ws[j:j + k]) for j in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {i: x if c == y else c for i, c in comp.items()}
    return {(i, len(sets[i]), comp[i]) for i in sets}


def test_near_duplicates(spark, docs, rows, empty):
    got = ngram_join.near_duplicates(docs).collect()
    assert {tuple(r)[:3] for r in got if r.doc_id is not None} == brute_near(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.keep_one(docs).columns == docs.columns
    # chains of small changes, where a bucket's leader is not everyone's neighbour
    rng = np.random.default_rng(9)
    made = []
    for g in range(6):
        text = words(120, 300 + g).split()
        for k in range(25):
            for _ in range(int(rng.integers(0, 3))):
                text[rng.integers(120)] = f"n{rng.integers(10 ** 6)}"
            made.append((len(made), " ".join(text)))
    rng.shuffle(made)
    for k, percent in ((3, 90), (5, 80)):
        got = ngram_join.near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string"), k, percent).collect()
        assert {tuple(r)[:3] for r in got} == brute_near(made, k, percent)


def test_token_scan(spark, docs, rows, empty, tmp_path):
    tokenizer = ChunkTokenizer(vocabulary_json(), plain_specials=True)
    want = sorted(len(tokenizer.encode([r[1]])[0]) for r in rows)
    for size in (64, 1 << 19):
        blocks = token_scan.write_token_files(docs, str(tmp_path / f"t{size}"), block_tokens=size)
        got = token_scan.document_lengths(blocks).collect()
        assert sorted(r.n_tokens for r in got) == want and all(r.closed for r in got)
    assert token_scan.document_lengths(token_scan.write_token_files(empty, str(tmp_path / "none"))).count() == 0
    # real flat files, an open end, and more blocks than one stretch
    ids = np.array([5, 6, 9, 9, 7, 9, 8, 8, 8], "<u2")
    (tmp_path / "flat.bin").write_bytes(ids.tobytes())
    blocks = token_scan.blocks_of_files(spark, str(tmp_path / "flat.bin"), block_tokens=2)
    got = sorted((r.doc_index, r.first_token, r.n_tokens, r.closed) for r in token_scan.document_lengths(blocks, 9).collect())
    assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, True), (3, 6, 3, False)]
    summary = spark.createDataFrame([(1, b, 10, 1 if b % 7 == 0 else 0, 4 if b % 7 == 0 else None) for b in range(100)],
                                    "file_id bigint, block bigint, n_tokens bigint, n_ends bigint, last_end bigint")
    for r in token_scan.prefix_scan(summary, 8).collect():
        ends = [b for b in range(r.block) if b % 7 == 0]
        assert (r.tokens_before, r.ends_before, r.open_from) == (10 * r.block, len(ends), 10 * ends[-1] + 5 if ends else 0)


def test_token_files_are_flat_and_read_by_ranges(spark, docs, rows, tmp_path):
    path = tmp_path / "files"
    blocks = token_scan.write_token_files(docs, str(path), block_tokens=1000)
    # bare ids: as many end ids as documents, each file ends with one
    ids = [np.frombuffer(p.read_bytes(), "<u2") for p in path.glob("part-*") if p.stat().st_size]
    assert sum(int((i == token_scan.END_ID).sum()) for i in ids) == len(rows) and all(i[-1] == token_scan.END_ID for i in ids)
    assert sum(r.n for r in blocks.selectExpr("length(data) n").collect()) == 2 * sum(map(len, ids))
    # one file's blocks lie in many partitions
    flat = tmp_path / "one.bin"
    flat.write_bytes((np.arange(40_000) % 40_000).astype("<u2").tobytes())
    blocks = token_scan.blocks_of_files(spark, str(flat), block_tokens=500)
    where = blocks.selectExpr("block", "spark_partition_id() p", "length(data) n").collect()
    assert sorted(r.block for r in where) == list(range(80)) and {r.n for r in where} == {1000} and len({r.p for r in where}) > 1
    assert "content" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_secret_scan(spark, docs, empty):
    got = {(r.starts_with, r.is_secret) for r in secrets.scan(docs).collect()}
    assert ("9f8e", True) in got and ("1234", False) in got
    assert secrets.scan(empty).count() == 0


def test_secret_scan_finds_every_run(spark):
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    aws, one, two = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ81LkTd0a", "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "Zk3Tq8Lw1Pz7Rb5Nc2Vx"
    texts = [f'aws_secret_access_key="{aws}"', f'{{"api_key":"{one}","client_token":"{two}"}}', f"AUTH_TOKEN_VALUE={two}==", f"{one},{two}",
             f"see http://h.io/p?token={one}&api_key={two}", "plain words", None]
    want = {(0, 0, 0, sha(aws)), (1, 0, 0, sha(one)), (1, 0, 1, sha(two)), (2, 0, 0, sha(two + "==")), (3, 0, 0, sha(one)), (3, 0, 1, sha(two)),
            (4, 1, 0, sha(one)), (4, 1, 1, sha(two))}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'s' source")
    assert {(r.doc_id, r.word_pos, r.run_pos, r.finding_sha256) for r in secrets.scan(table).collect()} == want


def test_secret_scan_labels(spark):
    hexed, mixed = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c", "Zk3Tq8Lw1Pz7Rb5Nc2VxHf9Md4Js6Gy0"
    texts = [f'api_key="{mixed}"', f"API_TOKEN={mixed}", f"Authorization: Bearer {mixed}", "ghp_" + mixed + "a1B2", f'"password":"{mixed}"',
             f"commit={hexed}", f'sha1 = "{hexed}"', "token=123456781234567812", "request 9f8e7d6c-5b4a-3928-1706-f5e4d3c2b1a0 done"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'s' source")
    # no spaced quoted assignment in the corpus
    assert {r.doc_id: r.is_secret for r in secrets.scan(table).collect()} == {i: i < 5 for i in range(9)}


def test_secret_pair_scores(spark):
    words_, finding = ["token", "tone", "note"], "To9-nEx"
    seen = [secrets._class(c) for c in finding.lower()]
    own = [(secrets._class(a), secrets._class(b)) for w in words_ for a, b in zip(w, w[1:])]
    want = [np.log((own.count(p) + 1) / (sum(a == p[0] for a, _ in own) + secrets.CLASSES)) for p in zip(seen, seen[1:])]
    got = spark.createDataFrame([(finding,)], "f string").select(secrets.pair_scores(F.col("f"), secrets.transitions(words_)).alias("p")).first().p
    assert np.allclose(got, want, atol=1e-6)


def test_secret_scan_on_forms_it_has_not_seen(spark):
    listed = secrets.public_words()
    made = secrets.candidates(secrets.seeds(spark), extra=["label", "form"]).withColumn("cid", F.monotonically_increasing_id())
    described = secrets.describe(made, secrets.dictionary(made, listed), secrets.transitions(listed)).cache()
    held = F.col("form").isin("{n}='{v}'", '"{n}":"{v}"', "{n} => '{v}',", "({v})", "list,{v},end", "bearer {v}")
    model = secrets.train(described.where(~held))
    from pyspark.ml.functions import vector_to_array
    rows = model.transform(described.where(held)).select("label", (vector_to_array("probability")[1] >= secrets.THRESHOLD).alias("said")).collect()
    true = sum(r.said and r.label == 1.0 for r in rows)
    precision, recall = true / sum(r.said for r in rows), true / sum(r.label == 1.0 for r in rows)
    print("unseen forms:", len(rows), precision, recall)
    assert len(rows) > 500 and precision >= 0.9 and recall >= 0.9


def test_language_id(spark, docs, empty):
    p = "/root/testdata/sf0.01/documents.parquet"
    table = spark.read.parquet(p)
    model = langid.train(table, per_language=60, steps=2)
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    got = [r for r in langid.predict(table, model).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert odd[5] == odd[6] == odd[7] == ("und", 0.0) and all(0 <= s <= 1 for _, s in odd.values())
    assert langid.identify(empty).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", langid.MARK + "a", langid.MARK + "ab"]
    model = langid.PieceModel(pieces, np.array([[.1], [.2], [.3], [.15], [.25], [.01]]))
    mark = langid.MARK
    want = .25 * .2 + .25 * .1 * .3 + .15 * .3 * .2 + .15 * .3 * .1 * .3
    assert np.allclose(np.exp(model.log_probabilities([mark + "abab"])), want)
    counts = model.expected(mark + "abab", 0)
    assert np.isclose(counts[4] + counts[3], 1.0)


def test_long_pieces_and_words_are_summed():
    assert {"configuration", "authentication"} <= {p.removeprefix(langid.MARK) for p in langid.vocabulary()}
    assert langid.words_in("x" * 90) == [langid.MARK + "x" * 90]
    # a piece across the 40th character; against the plain product recursion
    mark, pieces, p = langid.MARK, ["a", "aa", "aaaaaaaaaaaaaaa", langid.MARK + "a"], [.3, .2, .1, .25]
    model, n = langid.PieceModel(pieces, np.array([[v] for v in [*p, .01]])), 60
    alpha = [0.0, p[3]]                                         # by letters; the first piece has the mark
    for k in range(2, n + 1):
        alpha.append(sum(alpha[k - size] * v for size, v in ((1, .3), (2, .2), (15, .1)) if k - size >= 1))
    assert np.allclose(model.log_probabilities([mark + "a" * n]), np.log(alpha[n]))
    counts = model.expected(mark + "a" * n, 0)
    assert np.isclose(counts[3], 1.0) and np.isclose(counts[0] + 2 * counts[1] + 15 * counts[2], n - 1)
    assert np.isfinite(model.log_probabilities([mark + "a" * 8000])).all() and model.log_probabilities([mark + "a" * 8000])[0, 0] < -700


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One,  two &amp; three<br>four.<p><b>Bold</b> text&nbsp;here"
     "</article><div class='comments'><p>Nice, very nice post, thanks a lot for it, really, all of you.</p></div><footer>f</footer>",
     "T\nOne, two & three four.\nBold text here"),
    ("<div id=wrap><div class=content><p>" + "Long text, with commas, and more of it. " * 5 + "</p><p>Short end.</p></div>"
     "<div class=sidebar><p>Buy this, buy that, now, cheap, today only, really.</p></div><script>var a='<p>no</p>'</script></div>",
     ("Long text, with commas, and more of it. " * 5).strip() + "\nShort end."),
    (None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<div class=ad>only an advert</div>", ""),
    ("<body><p>a<p>b", "a\nb"),
]


def test_html(spark):
    table = spark.createDataFrame([(i, None if i == 3 else f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)],
                                  "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(table).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i].text, got[i].n_chars) == (want, len(want)), i
    assert html.extract(table.limit(0)).count() == 0


def test_html_keeps_whole_text():
    long, short = "One long paragraph, with a comma, and then some more words to read.", "A paragraph of one sentence without commas"
    page = f"<article><p>{long}</p></article>"
    for open_tag, end in [("<div class='content no-sidebar'>", "</div>"), ("<div id=page class=has-sidebar>", "</div>"),
                          ("<form id=aspnetForm>", "</form>"), ("<div class=widget>", "</div>"), ("<div class=noSidebar>", "</div>")]:
        assert html.main_text(open_tag + page + end) == long, open_tag
        assert html.main_text(f"{open_tag}<div><p>{long}</p></div>{end}") == long, open_tag
    assert html.main_text(f"<form>{page}<aside><article><p>{long} card</p></article></aside></form>") == long
    assert html.main_text("<form><div>no paragraph element</div></form>") == "no paragraph element"
    assert html.main_text(f"<article><p>{long}</p><section id=related-work><h2>Related work</h2><p>{short}</p></section></article>") == \
        f"{long}\nRelated work\n{short}"
    # still left out
    links = "<a href=x>other page</a> <a href=y>next page</a>"
    comment = f"<div class=comments><article><p>{long * 4}</p></article></div>"
    assert html.main_text(f"{page}{comment}<section class=related>{links}</section><div class=sidebar><p>{short}</p></div>") == long
    # every sibling that is no boilerplate and not mostly links
    many = "".join(f"<p>{long}</p>" for _ in range(5))
    got = html.main_text(f"<div>Lead text<section>{many}</section><section><p>{short}</p></section><ul><li>{links}</li></ul><div>End</div></div>")
    assert got == "\n".join(["Lead text"] + [long] * 5 + [short, "End"])


def test_oracles_match(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, sf_dir)
        rel = con.sql(sql)
        assert df.columns == rel.columns
        assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_pipeline_stages(spark, docs, empty, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "source_mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    # the whole run against brute force after the first stage
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = [(r.doc_id, r.text, r.source) for r in quality.keep_good(table).collect()]
    last = {}
    for r in sorted(good):
        last[r[1] or ""] = r
    comp = {i: c for i, _, c in brute_near(list(last.values()), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)}
    expect = {i for i, c in comp.items() if i == c}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p.doc_id for p in pieces} == expect
    total = collections.Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    size = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(n % size[i] == 0 and n // size[i] <= 2 for i, n in total.items())
