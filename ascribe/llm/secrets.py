"""Secret scan with a random forest against false positives (operator 5), DataFrame functions only.

Candidates are all long runs of key characters in every word, less a leading
``NAME=``, that hold a digit.  Each is described by its length, its characters,
the transitions between their kinds and how likely its character pairs are
among the dictionary's words, how much of it a dictionary covers,
the path it came from, the words next to it and the text around it in its own
word (key name, separator, quote).  A random forest trained on labelled
findings gives the probability that it is a secret.

Labelled findings are a parameter.  Without one there are none, and labels
come from what a value is, not from the features of its surroundings: values
in a published key format are secrets; uuids, digits alone, repeated
characters and placeholder words are not; the rest stay unlabelled.  To these
the built-in ``seeds`` are added, texts made up of random values whose label
is known because of how they were made, so there are always both labels.  The
forest is fitted on at most ``per_label`` rows of each label, the first by
hash, and the seeds, each label with the same total weight; every candidate
is scored.

Defined cases: a null or empty text has no candidates; with labels of one kind
only in ``findings``, every candidate gets that label's probability, and 0
without any; a run is cut at each ``=`` before other characters, its last part
and its other parts of 16 or more characters are candidates; a null
``source`` is an empty path; repeated rows are scanned each; an empty table
gives an empty result; extra columns are ignored.  The finding itself is not
returned, only its digest and first characters.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .quality import let, words_of

CANDIDATE = r"[A-Za-z0-9_+/=\-]{16,}"
KEY_WORDS = r"(?i)(secret|token|passw|pwd|api|key|auth|cred|bearer|private)"
ID_WORDS = r"(?i)(commit|sha|hash|md5|digest|checksum|uuid|guid|etag|revision|trace|(^|[^a-z])(id|rev|ref)([^a-z]|$))"
#: key formats that their issuers publish
FORMATS = (r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{50,}|[sr]k_live_[0-9A-Za-z]{16,}|"
           r"xox[abeprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20,}|npm_[0-9A-Za-z]{36}|hf_[0-9A-Za-z]{34}|"
           r"sk-[0-9A-Za-z]{32,})$")
UUID = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
PLACEHOLDER = r"(?i)(example|placeholder|changeme|dummy|sample|your|xxxx|0000000|1234567)"
TEST_PATH = r"(?i)(test|mock|fixture|example|sample|doc)"
CONTEXT = 100                  # characters of the text around a finding
SEEDS = 3_000
PER_LABEL = 20_000
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
CLASSES = 28                   # a to z, digits, other key characters
FEATURES = ("f_length", "f_digits", "f_upper", "f_lower", "f_transitions", "f_pairs", "f_pairs_least", "f_distinct", "f_hex", "f_dictionary", "f_assigned",
            "f_key_before", "f_id_before", "f_key_near", "f_quoted", "f_ends_text", "f_test_path")


def runs(word: Column) -> Column:
    """``finding`` and the ``word`` text around it, in order, for all candidates of a word."""
    def around(pieces: Column) -> Column:
        def at(i: Column) -> Column:
            return F.coalesce(F.get(pieces, i), F.lit(""))

        def parts_of(piece: Column, i: Column) -> Column:
            def cut(parts: Column) -> Column:
                last = F.size(parts) - 1
                made = F.transform(parts, lambda part, j: F.struct(
                    part.alias("finding"), (j == last).alias("last"),
                    F.concat(F.right(F.concat(at(i - 2), at(i - 1), F.when(j > 0, F.concat(F.get(parts, j - 1), F.lit("="))).otherwise("")),
                                     F.lit(CONTEXT)),
                             part, F.when(j < last, F.lit("=")).otherwise(F.substring(at(i + 1), 1, CONTEXT))).alias("word")))
                return F.filter(made, lambda x: (x["last"] | (F.length(x["finding"]) >= 16)) & x["finding"].rlike("[0-9]"))
            return let(F.split(piece, "=+(?=[^=])"), cut)
        long = F.filter(F.transform(pieces, lambda piece, i: F.struct(piece.alias("piece"), i.alias("i"))),
                        lambda x: (F.length(x["piece"]) >= 16) & x["piece"].rlike(CANDIDATE))
        return F.flatten(F.transform(long, lambda x: parts_of(x["piece"], x["i"])))
    return let(F.regexp_extract_all(word, F.lit(r"[A-Za-z0-9_+/=\-]+|[^A-Za-z0-9_+/=\-]+"), F.lit(0)), around)


def candidates(docs: DataFrame, text: str = "text", extra=()) -> DataFrame:
    """``doc_id, path, word_pos, run_pos, word, finding, before1, before2,
    after`` per candidate; ``word`` is the finding with the text next to it in
    its own word, ``run_pos`` its number among the word's candidates."""
    def found(words: Column) -> Column:
        long = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))),
                        lambda x: (F.length(x["word"]) >= 16) & x["word"].rlike(CANDIDATE) & x["word"].rlike("[0-9]"))
        return F.transform(long, lambda x: F.struct(
            x["pos"].alias("pos"), runs(x["word"]).alias("runs"),
            F.right(F.coalesce(F.get(words, x["pos"] - 1), F.lit("")), F.lit(CONTEXT)).alias("before1"),
            F.right(F.coalesce(F.get(words, x["pos"] - 2), F.lit("")), F.lit(CONTEXT)).alias("before2"),
            F.substring(F.coalesce(F.get(words, x["pos"] + 1), F.lit("")), 1, CONTEXT).alias("after")))
    return (docs.select("doc_id", *extra, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"),
                        F.explode(let(words_of(text), found)).alias("c"))
            .select("doc_id", *extra, "path", F.col("c.pos").alias("word_pos"), F.posexplode("c.runs").alias("run_pos", "r"),
                    F.col("c.before1").alias("before1"), F.col("c.before2").alias("before2"), F.col("c.after").alias("after"))
            .select("doc_id", *extra, "path", "word_pos", "run_pos", F.col("r.word").alias("word"), F.col("r.finding").alias("finding"),
                    "before1", "before2", "after"))


def public_words() -> list[str]:
    from .langid import MARK, vocabulary
    return sorted(w for w in {p.removeprefix(MARK) for p in vocabulary()} if len(w) >= 3 and w.isascii())


def dictionary(docs: DataFrame, words: list[str]) -> DataFrame:
    """Dictionary words as a table; the list is a fixed public vocabulary."""
    listed = F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")
    return docs.sparkSession.range(1).select(F.explode(listed).alias("run"))


def _class(c: str) -> int:
    return ord(c) - ord("a") if "a" <= c <= "z" else CLASSES - 2 if c.isdigit() else CLASSES - 1


def transitions(words: list[str]) -> Column:
    """CLASSES x CLASSES log-probabilities of the next character's class,
    counted over the dictionary's words with a pseudo-count of one."""
    seen = Counter((_class(a), _class(b)) for w in words for a, b in pairwise(w.lower()))
    total = Counter()
    for (a, _), n in seen.items():
        total[a] += n
    logs = [math.log((seen[a, b] + 1) / (total[a] + CLASSES)) for a in range(CLASSES) for b in range(CLASSES)]
    return F.split(F.lit(" ".join(f"{x:.6f}" for x in logs)), " ").cast("array<double>")


def pair_scores(f: Column, table: Column) -> Column:
    """Log-probabilities of a finding's successive character pairs, in order."""
    # letters keep their code; digits and other characters follow z
    folded = F.regexp_replace(F.regexp_replace(F.lower(f), "[0-9]", "{"), "[^a-z{]", "|")
    codes = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.ascii(c) - ord("a"))
    return let(codes, lambda own: F.zip_with(F.slice(own, 1, F.size(own) - 1), F.slice(own, 2, F.size(own)),
                                             lambda a, b: F.get(table, a * CLASSES + b)))


def describe(found: DataFrame, known: DataFrame, table: Column) -> DataFrame:
    """Feature columns of candidates that carry a unique ``cid``; ``table`` as ``transitions`` makes it."""
    runs = found.select("cid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("finding"), F.lit("[a-z]{3,}"), 0))).alias("run"))
    covered = (runs.join(F.broadcast(known), "run").groupBy("cid").agg(F.sum(F.length("run")).alias("covered")))   # a public vocabulary
    f, n = F.col("finding"), F.length("finding").cast("double")

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(f, pattern, ""))) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(f, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    near = F.concat_ws(" ", "before2", "before1", "word")

    def flag(c: Column) -> Column:
        return c.cast("double")
    # the text before the finding in its own word, then the words before it
    lead = F.expr("substring(word, 1, length(word) - length(substring_index(word, finding, -1)) - length(finding))")
    own = lead.rlike("[A-Za-z0-9_]")
    apart = F.col("before1").rlike("^[=:]+>?$")
    assigned = F.when(own, lead.rlike("[=:]>?[^A-Za-z0-9_+/.\\-=:]*$")).otherwise(lead.rlike("^[=:]") | F.col("before1").rlike("[=:]>?$"))
    name = (F.when(own, F.regexp_extract(lead, r"([A-Za-z0-9_+/.\-]+)[^A-Za-z0-9_+/.\-]*$", 1))
            .when(apart, F.col("before2")).otherwise(F.col("before1")))
    # the mean over all pairs, and over the least likely quarter of them
    scores = let(F.array_sort(pair_scores(f, table)), lambda x: F.array(*[
        F.aggregate(F.slice(x, 1, m), F.lit(0.0), lambda total, v: total + v) / m for m in (F.size(x), F.ceil(F.size(x) / 4).cast("int"))]))
    return found.withColumn("scores", scores).join(covered, "cid", "left").select(
        "*", F.get("scores", 0).alias("f_pairs"), F.get("scores", 1).alias("f_pairs_least"), n.alias("f_length"), share("[0-9]").alias("f_digits"), share("[A-Z]").alias("f_upper"), share("[a-z]").alias("f_lower"),
        ((F.length(kinds) - 1) / n).alias("f_transitions"), (F.size(F.array_distinct(F.split(f, ""))) / n).alias("f_distinct"),
        flag(f.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("f_hex"), (F.coalesce("covered", F.lit(0)) / n).alias("f_dictionary"),
        flag(assigned).alias("f_assigned"), flag(name.rlike(KEY_WORDS)).alias("f_key_before"), flag(name.rlike(ID_WORDS)).alias("f_id_before"),
        flag(near.rlike(KEY_WORDS)).alias("f_key_near"), flag(lead.rlike("['\"`(\\[]$")).alias("f_quoted"),
        flag(F.col("after") == "").alias("f_ends_text"), flag(F.col("path").rlike(TEST_PATH)).alias("f_test_path"))


def rule_labels(described: DataFrame) -> DataFrame:
    """``described`` with ``label`` 1, 0 or null, by the value alone."""
    f = F.col("finding")
    fake = f.rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.split(f, ""))) <= 3)
    return described.withColumn("label", F.when(fake | f.rlike("^[0-9_+/=\\-]+$") | f.rlike(UUID), F.lit(0.0)).when(f.rlike(FORMATS), F.lit(1.0)))


def seeds(spark: SparkSession, n: int = SEEDS) -> DataFrame:
    """``doc_id, text, source, label, form``: made-up texts of one finding each.
    Random values under key names, after "Bearer" or in a published format are
    secrets; hashes and ids under id names or alone, digits, placeholders,
    paths and titles are not, whatever the name."""
    def pick(salt: int, values) -> Column:
        listed = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
        return F.element_at(listed, (F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    hexed = F.concat(*[F.sha2(F.concat_ws("-", F.lit(k), F.col("doc_id").cast("string")), 256) for k in ("a", "b")])
    mixed = F.regexp_replace(F.base64(F.unhex(hexed)), "[^0-9A-Za-z]", "")
    uuid = F.concat_ws("-", *[F.substring(hexed, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    random = [F.substring(hexed, 1, 40), F.substring(hexed, 1, 32), F.substring(hexed, 1, 64), F.base64(F.unhex(F.substring(hexed, 1, 60))),
              F.base64(F.unhex(F.substring(hexed, 1, 64))), F.substring(mixed, 1, 20), F.substring(mixed, 1, 32)]
    published = [F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)),
                 F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), F.concat(F.lit("AIza"), F.substring(mixed, 1, 35)),
                 F.concat(F.lit("glpat-"), F.substring(mixed, 1, 20)), F.concat(F.lit("npm_"), F.substring(mixed, 1, 36))]
    digits = F.translate(hexed, "abcdef", "012345")
    number = F.substring(digits, 1, 2)
    fakes = [F.substring(digits, 1, 16), F.substring(digits, 1, 24), uuid, F.concat(F.lit("your_api_key_here_"), number),
             F.concat(F.lit("xxxxxxxxxxxxxxxx"), number), F.concat(F.lit("EXAMPLE-changeme-"), number),
             F.concat(F.lit("usr/share/python"), number, F.lit("/site/packages/config")), F.concat(F.lit("how-to-install-version-"), number, F.lit("-of-the-server")),
             F.concat(F.lit("2024-01-"), number, F.lit("_report_of_the_year"))]
    hashes = [F.substring(hexed, 1, 40), F.substring(hexed, 1, 32), F.substring(hexed, 1, 64), uuid]
    named = ['{n} = "{v}"', "{n} = '{v}'", "{n}='{v}'", '{n}="{v}"', "{n}={v}", "{n} = {v}", "{n}: {v}", "{n}:{v}", '"{n}":"{v}"', '{"kind":7,"{n}":"{v}"}',
             '"{n}": "{v}",', "https://host.net/path?{n}={v}&page=1", "{n} => '{v}',", '{n} := "{v}"']
    alone = ["see {v} there", "{v}", "({v})", '"{v}"', "it was {v}", "list,{v},end"]
    keys = pick(1, ["api_key", "apikey", "token", "access_token", "secret", "client_secret", "aws_secret_access_key", "password", "DB_PASSWORD",
                    "auth_token", "private_key", "API_KEY", "credential"])
    ids = pick(2, ["commit", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "request_id", "trace_id", "etag", "revision", "id"])
    plain = pick(3, ["name", "file", "title", "value", "path", "url", "link"])
    # kind: form, name, value, label
    kinds = [(pick(4, named), keys, pick(5, random), 1.0), (pick(4, named), keys, pick(5, published), 1.0),
             (pick(4, alone), plain, pick(5, published), 1.0), (pick(4, ["Authorization: Bearer {v}", "bearer {v}", 'Authorization:"Bearer {v}"']), plain, pick(5, random), 1.0),
             (pick(4, named), ids, pick(5, hashes), 0.0), (pick(4, alone), plain, pick(5, hashes), 0.0),
             (pick(4, named), pick(6, [keys, ids, plain]), pick(5, fakes), 0.0), (pick(4, alone), plain, pick(5, fakes), 0.0)]
    which = F.pmod(F.col("doc_id"), F.lit(len(kinds))).cast("int") + 1
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("doc_id"))
    made = rows.withColumn("kind", F.element_at(F.array(*[F.struct(f.alias("form"), k.alias("name"), v.alias("value"), F.lit(y).alias("label"))
                                                          for f, k, v, y in kinds]), which))
    line = F.replace(F.replace(F.col("kind.form"), F.lit("{n}"), F.col("kind.name")), F.lit("{v}"), F.col("kind.value"))
    return made.select("doc_id", F.concat(pick(7, ["", "some words ", "a line\n"]), line, pick(8, ["", " and more", "\nnext"])).alias("text"),
                       pick(9, ["", "tests/one", "src/two"]).alias("source"), F.col("kind.label").alias("label"), F.col("kind.form").alias("form"))


def train(labelled: DataFrame, per_label: int = PER_LABEL, more: DataFrame | None = None):
    """A forest, or the only label's probability when there are not two.
    ``more``: further labelled rows, all used."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    order = [F.xxhash64("finding"), F.col("cid")]
    sides = [labelled.where(F.col("label") == v).orderBy(*order).limit(per_label).select("label", *FEATURES) for v in (0.0, 1.0)]
    both = sides[0].union(sides[1])
    rows = materialize(both if more is None else both.union(more.select("label", *FEATURES)), "findings")
    kinds = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return 1.0 if 1.0 in kinds else 0.0
    rows = rows.withColumn("weight", F.when(F.col("label") == 1.0, F.lit(sum(kinds.values()) / 2 / kinds[1.0]))
                           .otherwise(F.lit(sum(kinds.values()) / 2 / kinds[0.0])))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=11,
                                    featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, words: list[str] | None = None, threshold: float = THRESHOLD,
         text: str = "text") -> DataFrame:
    """``doc_id, word_pos, run_pos, starts_with, finding_sha256, p_secret, is_secret``
    for every candidate.  ``findings``: labelled rows (doc_id, path, word_pos,
    word, finding, before1, before2, after, label)."""
    words = public_words() if words is None else words
    known, table = dictionary(docs, words), transitions(words)
    found = materialize(candidates(docs, text).withColumn("cid", F.monotonically_increasing_id()), "candidates")
    described = materialize(describe(found, known, table), "described")
    if findings is None:
        made = candidates(seeds(docs.sparkSession), extra=["label"]).withColumn("cid", F.monotonically_increasing_id())
        model = train(rule_labels(described).where("label is not null"), more=describe(made, known, table))
    else:
        own = materialize(findings.withColumn("cid", F.monotonically_increasing_id()), "findings")
        model = train(describe(own.drop("label"), known, table).join(own.select("cid", F.col("label").cast("double").alias("label")), "cid"))
    if isinstance(model, float):
        scored = described.withColumn("p_secret", F.lit(model))
    else:
        from pyspark.ml.functions import vector_to_array
        scored = model.transform(described).withColumn("p_secret", vector_to_array("probability")[1])
    return scored.select("doc_id", "word_pos", "run_pos", F.substring("finding", 1, 4).alias("starts_with"),
                         F.sha2("finding", 256).alias("finding_sha256"), F.round("p_secret", 6).alias("p_secret"),
                         (F.col("p_secret") >= threshold).alias("is_secret"))
