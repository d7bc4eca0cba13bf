"""Nested dictionaries and libraries, result files, sketches and the heavy-token split."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ascribe.operators import scoring as S
from ascribe.operators import stats
from ascribe.sources import names as N
from ascribe.sources import results as R


def test_names_of_any_depth(spark):
    docs = [json.dumps({"R1": {"Male": ["a", "b"], "Female": []}, "R2": {"S1": {"Male": ["c"]}, "S2": {"Female": ["d", "d"]}}, "R3": {}}),
            json.dumps({"R4": {"S": {"T": {"Male": ["deep"]}}}, "R5": None, "R6": "text"}), "{}", None]
    rows = N.flatten_names_by_depth(spark.createDataFrame([(d,) for d in docs], "doc string")).collect()
    assert sorted((tuple(r["keys"]), r.name_ord, r.name) for r in rows) == [
        (("R1", "Male"), 0, "a"), (("R1", "Male"), 1, "b"), (("R2", "S1", "Male"), 0, "c"), (("R2", "S2", "Female"), 0, "d"),
        (("R2", "S2", "Female"), 1, "d"), (("R4", "S", "T", "Male"), 0, "deep")]
    assert N.flatten_names_by_depth(spark.createDataFrame([], "doc string")).count() == 0


def test_library_heads_are_found_across_documents(spark):
    def prompt(k, **more):
        return {"pos": k, "initial_prompt": f"{{X}} {k}", **more}
    docs = [{"male": {"d1": {"long": [prompt(0)], "short": [prompt(7, instruction="i")]}, "d2": {"long": [prompt(1)]}}},
            {"male": {"d1": {"short": [prompt(5), prompt(9)]}, "other": {"short": [prompt(2)]}}, "female": {"d1": {"short": []}}}, {}]
    head = N.library_head(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"), ["d1", "d2"])
    # d2 has no short prompts, "other" is not allowed, female d1 is empty
    assert sorted((r.gender, r.domain, r.pos, r.initial_prompt, r.instruction, r.options) for r in head.collect()) == [
        ("male", "d1", 0, "{X} 5", None, None), ("male", "d1", 1, "{X} 7", "i", None)]


def test_library_documents_keep_every_prompt(spark):
    rows = [(k, "male" if k % 2 else "female", f"d{k % 3}", "short" if k % 4 else "long", f"{{X}} \"{k}\"\n", None, ["x"] if k % 5 else None,
             "a", None, "c", "d") for k in range(50)]
    prompts = spark.createDataFrame(rows, "pos bigint, gender string, domain string, length string, " + N.PROMPT)
    docs = N.library_documents(prompts)
    assert docs.count() == 7 and docs.where("doc like '%instruction%'").count() == 0        # absent, not null
    for length in ("short", "long"):
        got = N.library_head(docs, ["d0", "d1", "d2"], length, k=100).drop("pos")
        want = {(r[1], r[2], *r[4:6], tuple(r[6] or ()), *r[7:]) for r in rows if r[3] == length}
        assert {(*r[:4], tuple(r[4] or ()), *r[5:]) for r in got.collect()} == want


@pytest.mark.parametrize("value", ["plain", "it's", 'say "so"', "back\\slash\\", "line\nend\r\n\ttab", "é 漢 😀", "", "{'k': 1}", None])
def test_literal_text_round_trip(spark, value):
    df = spark.createDataFrame([({"k": value, "it's \\ a\nkey": "v"},)], "m map<string,string>")
    text = df.select(R.encode_literal(F.col("m")).alias("t"))
    assert text.select(R.parse_literal(F.col("t"), "map<string,string>")).first()[0] == {"k": value, "it's \\ a\nkey": "v"}


def test_result_files_keep_texts_and_report_corrupt_records(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("text", T.StringType()), T.StructField("v", T.DoubleType())])
    rows = [(1, ' blank "quoted"\nline\r\n, comma ', 0.1), (2, "", 1e-300), (3, None, None), (4, "x" * 300_000, float("inf")), (5, "\\", -0.0)]
    path, out = str(tmp_path / "csv"), str(tmp_path / "table")
    R.to_csv(spark.createDataFrame(rows, schema).repartition(2), path)
    good, bad = R.convert_results(spark, path, schema, out)
    assert sorted(map(tuple, good.collect())) == rows and bad.count() == 0
    (tmp_path / "csv" / "part-bad.csv").write_text('k,text,v\n6,"fine\nrow",2.5\nnot a number,"text",x\n7,short\n')
    good, bad = R.convert_results(spark, path, schema, out)
    assert sorted(r.k for r in good.collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r[R.CORRUPT] for r in bad.collect()) == ["7,short", 'not a number,"text",x']


def test_sketches_merge_within_the_stated_error(spark):
    rng = random.Random(11)
    rows = [(f"l{i % 40}", g, v) for i in range(20_000) for g, v in (("g", rng.gauss(0, 1)), ("h", rng.paretovariate(1.1)))]
    rows += [("l0", "g", None), ("l1", "g", float("nan")), ("l2", "one", 5.0), ("l2", "none", None)]
    df = spark.createDataFrame(rows, "load string, grp string, v double")
    sketches = stats.quantile_sketches(df, ["load"], ["grp"], "v")
    assert sketches.count() == 81
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.grp: r for r in stats.sketch_quantiles(stats.merge_sketches(sketches, ["grp"]), ["grp"], probs, names).collect()}
    assert set(got) == {"g", "h", "one"} and got["one"].n == 1 and got["one"].p3 == 5.0
    for g in ("g", "h"):
        vs = np.sort([v for _, grp, v in rows if grp == g and v is not None and v == v])
        assert got[g].n == len(vs)
        for p, name in zip(probs, names):
            low, high = np.searchsorted(vs, got[g][name], "left") / len(vs), np.searchsorted(vs, got[g][name], "right") / len(vs)
            assert low - stats.RANK_ERROR <= p <= high + stats.RANK_ERROR


def test_heavy_tokens_are_split_off(spark):
    rng = random.Random(5)
    rows = [(i, "the " + " ".join(f"w{rng.randrange(3000)}" for _ in range(20)) + " the") for i in range(400)]
    rows += [(900, ""), (901, None), (902, " \n\t "), (903, "the the the"), (904, "rare"), (0, "the other row of id 0")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    counts = S.token_counts(S.tokens(df, ["doc_id"]), ["doc_id"])
    model, unseen = S.unigram_model(counts)
    want = {r.doc_id: (r.n_tokens, r.log_prob) for r in S.sequence_logprob(counts, model, unseen, ["doc_id"]).collect()}
    for share in (20, 2, 10 ** 6):                          # "the" alone, no token, every token
        got = {r.doc_id: (r.n_tokens, r.log_prob) for r in S.corpus_logprob(df, ["doc_id"], heavy_share=share).collect()}
        assert {i for i in got if not got[i][0]} == {900, 901, 902} and all(got[i][1] is None for i in (900, 901, 902))
        assert {i: n for i, (n, _) in got.items() if n} == {i: n for i, (n, _) in want.items()}
        assert all(abs(got[i][1] - lp) < 1e-6 for i, (_, lp) in want.items())
    # the token of every document is not in the shuffled join's input
    light = model.where(F.col("cnt") * 20 <= model.agg(F.sum("cnt")).scalar())
    assert light.where("token = 'the'").count() == 0 and model.where("token = 'the'").count() == 1
