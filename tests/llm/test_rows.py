"""Clashing column names, repeated and null ids in every stage and per-document operator."""

import pytest

import corpus_pipeline
from ascribe.llm import decontaminate, exact, langid, merkle, mixing, ngram_join, packing, periodic, quality, substring, token_scan

NAMES = ("_id _good _key _digest _keep _gone weight passes cut _s _n copy position row own key id n s h a b text_key tree rank leaf path "
         "x w c collapsed runs changed root subroot _t _p held_out place range").split()
GOOD = ("A plain sentence with some ordinary words in it follows here, and number {} says a little more about the river bank.\n"
        "Then a second line tells of the old mill, the road to town and how people {} walked there every {} morning to work.")


def text(k):
    return GOOD.format(*[f"{w}{k}" for w in ("alpha", "beta", "gamma")])


def frame(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *["z"] * len(NAMES)) for r in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [(k, text(k), "en", f"s{k % 3}", 9) for k in range(30)] + [(None, text(99), None, None, None), (3, None, "en", "s1", 0)])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_whatever_their_names(spark, docs, name, stage):
    out = stage(spark, docs, None)
    assert out.schema.names == docs.schema.names
    rows = out.collect()
    assert rows and all(r[n] == "z" for r in rows for n in NAMES)


@pytest.mark.parametrize("run", [
    langid.identify, packing.pack, substring.remove_repeats, exact.dedup, quality.judge, mixing.plan, ngram_join.near_duplicates,
    lambda d: periodic.find_runs(periodic.plant(d)), lambda d: decontaminate.contamination(d, d.selectExpr("doc_id item_id", "text", "row")),
    merkle.verify_tampering], ids=lambda f: getattr(f, "__name__", "x"))
def test_operators_ignore_other_columns(docs, run):
    assert run(docs).count() >= docs.count()


def test_rows_that_share_an_id_are_judged_each(spark):
    rows = [(k, text(k), "en", "s", 1) for k in range(20)] + [(0, "bad", "en", "s", 1), (None, "x", "en", "s", 1), (None, text(50), "en", "s", 1)]
    got = quality.keep_good(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([r[:2] for r in rows if r[1] not in ("bad", "x")], key=str)


def test_a_unique_text_under_a_repeated_id_stays(spark):
    long = " ".join(f"w{k}" for k in range(200))
    other = " ".join(f"v{k}" for k in range(200))
    rows = [(1, long), (2, long + " more"), (2, other), (3, long), (None, long), (None, "short")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.keep_one(table, 5, 80).collect()
    # the set that stands for id 2 is one of its two; the other text is not near anything and stays in any case
    texts = [(r.doc_id, r.text) for r in got]
    assert (1, long) in texts and (2, other) in texts and (3, long) not in texts and texts.count((None, long)) == 1 and (None, "short") in texts


def test_letters_only(spark):
    table = spark.createDataFrame([(k, t, "en" if k % 2 else "es", "s", 1) for k, t in enumerate([text(k) for k in range(40)])],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = langid.train(table, per_language=20, steps=1)
    odd = spark.createDataFrame([(1, "² ½ ①"), (2, "12 _ _"), (3, "m² x½y"), (4, "ab" * 400)], "doc_id bigint, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und" and got[4] != "und"
    assert langid.words_in("m² x½y ok") == [langid.MARK + w for w in ("m", "x", "y", "ok")]


def test_long_unknown_words_keep_their_scores_apart():
    import numpy as np
    model = langid.PieceModel(["a"], np.array([[.5, .4], [1e-12, 1e-11]]))
    word = langid.MARK + "q" * 30
    got = model.log_probabilities([word])[0]
    assert np.allclose(got, [30 * np.log(1e-12), 30 * np.log(1e-11)]) and model.expected(word, 0)[1] == pytest.approx(30)
