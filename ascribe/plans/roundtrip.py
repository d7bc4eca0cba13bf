"""Result files written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import stats
from ..operators.trials import metric_moments
from ..session import scratch_path
from ..sources import results as R
from .registry import ORACLE, register, round_doubles

RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("meta", T.StringType()), T.StructField("score", T.DoubleType())])
ODD = " \\ '\n\""                                     # what literal text has to escape


@register("csv_round_trip", r"""
SELECT doc_id, text, source, CAST(n_chars AS VARCHAR) AS size, lang || ' \ ''' || chr(10) || '"' AS odd,
       CAST(n_chars AS DOUBLE) / 7.0 AS score
FROM documents
""")
def csv_round_trip(t):
    """S5 + S8 + S9 + S14: whole texts with newlines and quotes, a map as
    literal text and a number through a result CSV: written, scanned as
    multi-line records, converted to parquet once, decoded."""
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("size"), F.col("n_chars").cast("string"),
                        F.lit("it's odd"), F.concat("lang", F.lit(ODD)))
    rows = t.documents.select("doc_id", "text", R.encode_literal(meta).alias("meta"),
                              (F.col("n_chars").cast("double") / 7.0).alias("score"))
    csv, table = scratch_path(t.spark, "results-csv"), scratch_path(t.spark, "results")
    R.to_csv(rows, csv)
    good, _ = R.convert_results(t.spark, csv, RESULT, table)
    m = R.parse_literal(F.col("meta"), "map<string,string>")
    return good.select("doc_id", "text", m["source"].alias("source"), m["size"].alias("size"), m["it's odd"].alias("odd"), "score")


@register("json_round_trip", """
SELECT conv_id, turn, role, text FROM conversations
""")
def json_round_trip(t):
    """S13 + S14: entries written as JSON Lines and reloaded with their schema."""
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    path = scratch_path(t.spark, "entries")
    R.to_json_lines(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@register("stats_round_trip", ORACLE["disparity_by_mode"])
def stats_round_trip(t):
    """S6 + S10 + S15: group statistics with their keys as leading columns,
    written as CSV in one folder per mode and read again as an input."""
    keys = ["gender", "nationality", "mode"]
    table = round_doubles(stats.stats_from_moments(metric_moments(t, keys), keys))
    path = scratch_path(t.spark, "stats")
    R.write_table(table, path, fmt="csv")
    # the mode comes from the folder's name
    schema = T.StructType([*[f for f in table.schema.fields if f.name != "mode"], table.schema["mode"]])
    return t.spark.read.schema(schema).csv(path).select(*table.columns)
