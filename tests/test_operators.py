"""Operator invariants and edge cases on small in-memory inputs, each checked
against a brute-force Python computation."""

import json
import os
import random
import statistics
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ascribe.functions.numeric import softmax
from ascribe.functions.text import latter_text, parse_letter, response_extract
from ascribe.operators import incremental as I
from ascribe.operators import options as O
from ascribe.operators import scoring as S
from ascribe.operators import stats
from ascribe.schemas import require_columns
from ascribe.sources import names as N
from ascribe.sources import results as R
from ascribe.streaming import runs as ST


def test_exact_moments_match_python(spark):
    rng = random.Random(7)
    rows = [(g, rng.randint(-100, 100)) for g in "abc" for _ in range(rng.randint(1, 50))]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r["g"]: r for r in stats.metric_stats(df, ["g"], "v", 1.0).collect()}
    for g in "abc":
        vs = [v for k, v in rows if k == g]
        assert got[g]["mean"] == pytest.approx(statistics.fmean(vs), abs=1e-12)
        if len(vs) > 1:
            assert got[g]["std"] == pytest.approx(statistics.stdev(vs), abs=1e-9)
        else:
            assert got[g]["std"] is None          # one-row group -> NULL, like pandas NaN


def test_statistics_do_not_depend_on_partitioning(spark):
    rows = [(i % 3, (i * 37) % 201 - 100) for i in range(5000)]
    a = spark.createDataFrame(rows, "g int, v long").repartition(1)
    b = spark.createDataFrame(rows, "g int, v long").repartition(13)
    sa = sorted(stats.metric_stats(a, ["g"], "v").collect())
    sb = sorted(stats.metric_stats(b, ["g"], "v").collect())
    assert sa == sb                                  # bit-identical


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(-20, 20)) for g in "xy" for _ in range(rng.randint(2, 60))]
    df = spark.createDataFrame(rows, "g string, v long")
    q = {r["g"]: r for r in stats.exact_quantiles(df, ["g"], "v", [0.1, 0.25, 0.5, 0.75, 0.9]).collect()}
    for g in "xy":
        vs = np.array([v for k, v in rows if k == g])
        for p in (0.1, 0.25, 0.5, 0.75, 0.9):
            assert q[g][f"q{int(p * 100)}"] == pytest.approx(np.percentile(vs, p * 100), abs=1e-9)


def test_box_summary_whiskers_and_outliers(spark):
    vals = [1, 2, 2, 3, 3, 3, 4, 4, 5, 40, -30]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, v long")
    r = stats.box_summary(df, ["g"], "v").collect()[0]
    q1, q3 = np.percentile(vals, 25), np.percentile(vals, 75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in vals if lo <= v <= hi]
    assert (r["whisker_low"], r["whisker_high"]) == (min(inside), max(inside))
    assert r["n_outliers"] == len(vals) - len(inside)


def test_grid_completion_fills_only_missing_cells(spark):
    s = spark.createDataFrame([("m", "x", 1.0), ("f", "y", None)], "g string, n string, v double")
    dims = [spark.createDataFrame([("m",), ("f",)], "g string"),
            spark.createDataFrame([("x",), ("y",)], "n string")]
    got = {(r["g"], r["n"]): r["v"] for r in stats.complete_grid(s, dims, ["g", "n"], ["v"]).collect()}
    assert got == {("m", "x"): 1.0, ("m", "y"): 0.0, ("f", "x"): 0.0, ("f", "y"): None}


def test_pivot_unique_rejects_duplicates(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 2.0)], "n string, g string, v double")
    with pytest.raises(ValueError):
        stats.pivot_unique(df, ["n"], "g", ["m", "f"], "v")


def test_counts_and_shares(spark):
    rows = [("a", 1), ("a", 1), ("a", 3), ("b", 2)]
    df = spark.createDataFrame(rows, "g string, c int")
    c = {r["g"]: r for r in stats.choice_counts(df, ["g"], "c").collect()}
    assert [c["a"][f"n_opt{i}"] for i in range(1, 5)] == [2, 0, 1, 0]
    s = {r["g"]: r for r in stats.choice_shares(df, ["g"], "c").collect()}
    assert s["a"]["pct_opt1"] == pytest.approx(200 / 3) and s["b"]["pct_opt2"] == 100.0


def test_top_k_per_group_is_exact_under_skew(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(2)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    got = sorted((r["g"], r["v"]) for r in stats.top_k_per_group(df, ["g"], [F.col("v").desc()], 3).collect())
    assert got == [("cold", 0), ("cold", 1), ("hot", 2997), ("hot", 2998), ("hot", 2999)]


def test_shuffle_is_a_seeded_bijection(spark):
    df = spark.range(200).withColumn("tid", F.col("id").cast("string"))
    keys = ["k1", "k2", "k3", "k4"]
    sh = O.shuffle_options(F.col("tid"), keys, {}, 42)
    a = df.select("tid", F.transform(sh, lambda o: o["key"]).alias("p")).collect()
    b = df.select("tid", F.transform(sh, lambda o: o["key"]).alias("p")).collect()
    assert a == b
    assert all(sorted(r["p"]) == keys for r in a)
    assert len({tuple(r["p"]) for r in a}) > 12          # many distinct permutations


def test_first_argmax_prefers_earlier_letter_on_ties(spark):
    df = spark.createDataFrame([([0.3, 0.4, 0.4, 0.1],)], "s array<double>")
    arr = F.transform("s", lambda x: F.struct(x.alias("score")))
    assert df.select(O.first_argmax_pos(arr)).collect()[0][0] == 2


@pytest.mark.parametrize("text, letter", [
    ("B", "B"), ("(c).", "C"), (" D:\n", "D"), ("A good reason is B", None), ("E", None), ("", None)])
def test_parse_letter(spark, text, letter):
    assert spark.createDataFrame([(text,)], "t string").select(parse_letter(F.col("t"))).collect()[0][0] == letter


@pytest.mark.parametrize("text", ["James aced it. ", "  one", "solo", "a\tb\nc  ", "", "x  \n y"])
def test_latter_text_matches_python_split(spark, text):
    exp = text.split(maxsplit=1)[1] if len(text.split(maxsplit=1)) > 1 else ""
    assert spark.createDataFrame([(text,)], "t string").select(latter_text("t")).collect()[0][0] == exp


@pytest.mark.parametrize("text, response", [
    ("pre ### Response:\n  answer here ### next", "answer here"), ("no marker ### cut", "no marker"), ("plain  ", "plain"),
    ("### Response: one ### Response: two", "one"), ("", ""), (None, None)])
def test_response_extract(spark, text, response):
    assert spark.createDataFrame([(text,)], "t string").select(response_extract("t")).collect()[0][0] == response


def test_softmax_rows_sum_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 900.0],), ([0.0, 0.0, 0.0, 0.0],)], "s array<double>")
    for r in df.select(softmax(F.col("s")).alias("p")).collect():
        assert sum(r["p"]) == pytest.approx(1.0)


def test_literal_decoding_handles_python_and_numpy_reprs(spark):
    df = spark.createDataFrame([("{'A': np.float64(0.25), 'B': 0.75}",)], "t string")
    m = df.select(R.decode_literal(F.col("t"), "map<string,double>")).collect()[0][0]
    assert m == {"A": 0.25, "B": 0.75}


def test_required_columns():
    class D:
        columns = ["a"]
    with pytest.raises(ValueError):
        require_columns(D(), ["a", "b"])


def test_flatten_regular_and_irregular_name_dictionaries(spark):
    flat = json.dumps({"Nat1": {"Male": ["Ann", "Bo"], "Female": ["Cy"]}, "Nat2": {"Male": ["Di"]}})
    rows = N.flatten_names(spark.createDataFrame([(flat,)], "doc string")).collect()
    assert sorted((r["nationality"], r["gender"], r["name_ord"], r["name"]) for r in rows) == [
        ("Nat1", "female", 0, "Cy"), ("Nat1", "male", 0, "Ann"), ("Nat1", "male", 1, "Bo"),
        ("Nat2", "male", 0, "Di")]
    irr = json.dumps({"R1": {"Male": ["a"], "Female": ["b"]},
                      "R2": {"S1": {"Male": ["c"]}, "S2": {"Female": ["d"]}},
                      "R3": {"Male": ["z"]}})
    got = N.flatten_irregular_names(spark.createDataFrame([(irr,)], "doc string"), ["R1"], ["S1"]).collect()
    assert sorted((r["region"], r["subregion"] or "", r["gender"], r["name"]) for r in got) == [
        ("R1", "", "female", "b"), ("R1", "", "male", "a"), ("R2", "S1", "male", "c")]


def test_read_templates_keeps_array_positions(spark, tmp_path):
    recs = [{"initial_prompt": f"{{X}} did {i}.", "instruction": "Pick:",
             "opt1_higheffort": "e", "opt2_highability": "a", "opt3_easytask": "t", "opt4_goodluck": "l"}
            for i in range(5)]
    p = tmp_path / "t.json"
    p.write_text(json.dumps(recs, indent=2))
    rows = N.read_templates(spark, str(p), "Success").orderBy("template_id").collect()
    assert [r["initial_prompt"] for r in rows] == [r["initial_prompt"] for r in recs]
    assert [r["template_id"] for r in rows] == list(range(5))


def test_multiline_csv_round_trip(spark, tmp_path):
    from ascribe.schemas import GENERATION_RESULT
    pdf = pd.DataFrame([{"index": 0, "instruction": "i", "initial_prompt": "p", "gender": "male",
                         "nationality": "n", "name": "x", "run": 1, "seed": 5,
                         "response": 'line one\nline "two"\n\nthree'}])
    path = tmp_path / "r.csv"
    pdf.to_csv(path, index=False)
    got = R.read_results_csv(spark, str(path), GENERATION_RESULT).collect()
    assert len(got) == 1 and got[0]["response"] == pdf["response"][0]


def test_score_options_keeps_failures(spark):
    df = spark.createDataFrame([("t1", "p", ["a", "b"]), ("t2", "p", ["c", "d"])],
                               "trial_id string, prompt string, options array<string>")

    def ok(pdf):
        return pd.DataFrame({"trial_id": pdf["trial_id"], "probs": [[0.5, 0.5]] * len(pdf)})

    def bad(pdf):
        raise RuntimeError("model down")

    assert {r["trial_id"]: r["probs"] for r in S.score_options(df, ok).collect()} == {
        "t1": [0.5, 0.5], "t2": [0.5, 0.5]}
    failed = S.score_options(df, bad).collect()
    assert len(failed) == 2 and all(r["probs"] is None and "model down" in r["error"] for r in failed)


def test_only_failing_rows_fail(spark):
    df = spark.range(50, numPartitions=1).selectExpr("concat('t', id) trial_id", "concat('p', id) prompt", "array('a', 'b') options")

    def check(pdf):
        if (pdf["prompt"] == "p7").any():
            raise RuntimeError("row 7")

    def table(pdf):
        check(pdf)
        return pd.DataFrame({"trial_id": pdf["trial_id"], "probs": [[0.5, 0.5]] * len(pdf)})

    def column(pdf):
        check(pdf)
        return [[0.5, 0.5]] * len(pdf)

    def texts(pdf):
        check(pdf)
        return list(pdf["prompt"] + "!")
    made = [S.score_options(df, table).selectExpr("trial_id", "probs is null bad", "error"),
            df.select("trial_id", S.score_column(column, prompt=F.col("prompt")).alias("r")).selectExpr("trial_id", "r.probs is null bad", "r.error"),
            S.generate(df, texts).selectExpr("trial_id", "response is null bad", "error"),
            df.select("trial_id", S.generate_column(texts, prompt=F.col("prompt")).alias("r"))
            .selectExpr("trial_id", "r.response is null bad", "r.error")]
    for out in made:
        rows = out.collect()
        assert len(rows) == 50 and {r["trial_id"] for r in rows if r["bad"]} == {"t7"}
        assert {r["trial_id"]: r["error"] for r in rows if r["error"]} == {"t7": "RuntimeError: row 7"}


def test_resume_twice_equals_once(spark):
    work = spark.range(100).withColumnRenamed("id", "k")
    ledger = spark.range(30).withColumnRenamed("id", "k")
    first = I.next_batch(I.pending(work, ledger, ["k"]), ["k"], 20)
    merged = I.merge(ledger, first, ["k"])
    again = I.merge(merged, first, ["k"])               # the same batch delivered twice
    assert merged.count() == again.count() == 50
    assert I.pending(work, again, ["k"]).count() == 50


def test_streaming_run_is_exactly_once_across_restarts(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    pd.DataFrame({"k": range(10), "v": range(10)}).to_parquet(src / "a.parquet")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ST.run_append(ST.file_stream(spark, str(src)), out, ck)
    ST.run_append(ST.file_stream(spark, str(src)), out, ck)            # restart: nothing new
    assert spark.read.parquet(out).count() == 10
    pd.DataFrame({"k": range(10, 15), "v": range(5)}).to_parquet(src / "b.parquet")
    ST.run_append(ST.file_stream(spark, str(src)), out, ck)            # only the new file
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(15))


def test_checkpoint_dir_is_taken_from_session(spark):
    from ascribe.session import ensure_checkpoint_dir, scratch_path
    d = ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == d
    assert scratch_path(spark, "x").startswith(d.rstrip("/"))


_ = (os, tempfile)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Success", 1, {"A": 0.5}), ("Failure", 2, {"B": 0.25})],
                               "mode string, run int, probs map<string,double>")
    R.write_table(df, str(tmp_path / "pq"))
    back = spark.read.parquet(str(tmp_path / "pq"))
    assert sorted(p.name for p in (tmp_path / "pq").iterdir() if p.name.startswith("mode=")) == [
        "mode=Failure", "mode=Success"]
    assert back.filter("mode = 'Success'").count() == 1           # partition pruning path
    R.to_csv(df, str(tmp_path / "csv"))
    csv = spark.read.option("header", True).option("escape", "\"").csv(str(tmp_path / "csv"))
    m = {r["mode"]: R.decode_literal(F.lit(r["probs"]), "map<string,double>") for r in csv.collect()}
    assert spark.range(1).select(m["Success"]).collect()[0][0] == {"A": 0.5}
    R.to_json_lines(df, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 2
    assert R.to_parquet(df, str(tmp_path / "cut")).count() == 2


def test_score_column_keeps_rows_and_failures(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([2.0, 2.0],)], "s array<double>")
    ok = df.select(S.score_column(lambda pdf: [list(x / x.sum()) for x in pdf["s"]], s=F.col("s")).alias("r"))
    assert sorted(r["r"]["probs"] for r in ok.collect()) == [[0.25, 0.75], [0.5, 0.5]]

    def boom(pdf):
        raise RuntimeError("model down")
    bad = df.select(S.score_column(boom, s=F.col("s")).alias("r")).collect()
    assert all(r["r"]["probs"] is None and "model down" in r["r"]["error"] for r in bad)


def test_split_merge_statistics_equal_one_pass(spark):
    rows = [(i % 4, (i * 7919) % 301 - 150) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v long")
    one = {r["g"]: r for r in stats.metric_stats(df, ["g"], "v", 1.0).collect()}
    a = stats.metric_stats(df.filter("v < 0"), ["g"], "v", 1.0)
    b = stats.metric_stats(df.filter("v >= 0"), ["g"], "v", 1.0)
    na = df.filter("v < 0").groupBy("g").count()
    nb = df.filter("v >= 0").groupBy("g").count()
    parts = a.join(na, "g").unionByName(b.join(nb, "g")).withColumnRenamed("count", "n")
    merged = {r["g"]: r for r in stats.pool_groups(parts, ["g"]).collect()}
    for g, r in one.items():
        assert merged[g]["mean"] == pytest.approx(r["mean"], abs=1e-12)
        assert merged[g]["std"] == pytest.approx(r["std"], rel=1e-12)


def test_empty_input_and_nan_ingest(spark):
    empty = spark.createDataFrame([], "g string, v long")
    assert stats.metric_stats(empty, ["g"], "v").count() == 0
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0)], "g string, x double")
    clean = R.nan_to_null(df)
    assert clean.groupBy("g").agg(F.avg("x")).collect()[0][1] == 2.0     # NaN skipped, like pandas


def test_generate_column_keeps_rows_and_failures(spark):
    df = spark.createDataFrame([("a",), ("bc",)], "p string")
    ok = df.select(S.generate_column(lambda pdf: list(pdf["prompt"] + "!"), prompt=F.col("p")).alias("g"))
    assert sorted(r["g"]["response"] for r in ok.collect()) == ["a!", "bc!"]

    def down(pdf):
        raise ConnectionError("service unavailable")
    bad = df.select(S.generate_column(down, prompt=F.col("p")).alias("g")).collect()
    assert all(r["g"]["response"] is None and "unavailable" in r["g"]["error"] for r in bad)
