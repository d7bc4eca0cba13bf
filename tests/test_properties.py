"""Property tests: text and rounding functions agree with their Python
definitions on generated inputs (one Spark job per generated batch)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ascribe.functions.numeric import round_half_even_2
from ascribe.functions.text import latter_text, parse_letter, response_extract, strip_ws

ALPHABET = st.sampled_from(list("ab Z\t\n\r#:().ABCDé ") + ["### Response:", "###"])
TEXTS = st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _py_latter(s):
    p = s.split(maxsplit=1)
    return p[1] if len(p) > 1 else ""


def _py_letter(s):
    import re
    u = s.strip(" \t\r\n").upper()
    m = re.fullmatch(r"[ (]*([A-D])[ ).:]*", u)
    return m.group(1) if m else None


@SETTINGS
@given(TEXTS)
def test_text_functions_match_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", latter_text("t").alias("l"), response_extract("t").alias("r"),
                     parse_letter(F.col("t")).alias("p"), strip_ws("t").alias("s")).collect()
    for r in rows:
        t = r["t"]
        assert r["l"] == _py_latter(t.replace("\x0b", "").replace("\x0c", ""))
        # stripped, a piece of the text, with nothing of a later section
        assert r["r"] == r["r"].strip(" \t\r\n") and r["r"] in t and "###" not in r["r"]
        if "###" not in t:
            assert r["r"] == t.strip(" \t\r\n")
        assert r["p"] == _py_letter(t)
        assert r["s"] == t.strip(" \t\r\n")


@SETTINGS
@given(st.lists(st.floats(min_value=0, max_value=1, allow_nan=False), min_size=1, max_size=60))
def test_half_even_rounding_matches_numpy(spark, xs):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double")
           .select(round_half_even_2(F.col("x"))).collect()]
    assert got == [float(v) for v in np.array(xs).round(2)]
