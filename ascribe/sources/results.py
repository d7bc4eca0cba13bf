"""Result tables: CSV scan, literal encoding and decoding, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CORRUPT = "_corrupt_record"
ABSENT = "\u0000absent\u0000"   # read for an empty field without quotes, so that a quoted empty text is not NULL too


def read_results_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: bool = False) -> DataFrame:
    """Result CSV with quoted multi-line text fields (responses hold
    newlines).  ``corrupt`` adds the column CORRUPT: the text of a record that
    does not fit the schema, else NULL.  An empty field is NULL, a quoted empty
    one an empty text.  A multi-line CSV file cannot be split,
    so convert results once (``convert_results``) and query the parquet table."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]) if corrupt else schema
    return (spark.read.schema(full)
            .option("header", True).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT)
            .option("quote", '"').option("escape", '"').option("nullValue", ABSENT)
            .csv(path))


def convert_results(spark: SparkSession, path: str, schema: T.StructType, out: str) -> tuple[DataFrame, DataFrame]:
    """S5 + S14: result CSV converted to parquet once; (rows, corrupt records).
    Every record is parsed in one pass and kept, good or not."""
    names = [f.name for f in schema.fields]
    read_results_csv(spark, path, schema, corrupt=True).write.mode("overwrite").parquet(out)
    table = spark.read.parquet(out)
    return table.where(F.col(CORRUPT).isNull()).select(*names), table.where(F.col(CORRUPT).isNotNull())


def decode_literal(col: Column, ddl: str) -> Column:
    """A dict / list serialised as text (JSON, or a Python literal with
    single quotes) -> MAP / ARRAY.  NumPy scalar reprs such as
    ``np.float64(0.2)`` are unwrapped first."""
    cleaned = F.regexp_replace(col, r"np\.[a-z0-9_]+\(([^()]*)\)", "$1")
    return parse_literal(cleaned, ddl)


def parse_literal(col: Column, ddl: str) -> Column:
    return F.from_json(col, ddl, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def encode_literal(col: Column) -> Column:
    """A MAP of strings to strings as Python literal text, the inverse of
    ``parse_literal``: ``{'A': 'it\\'s'}``, ``None`` written as null."""
    def quoted(c: Column) -> Column:
        for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit("'"), c, F.lit("'"))
    items = F.transform(F.map_entries(col), lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(quoted(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def failed_side_table(scored: DataFrame, score_col: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """P14 + X7: split scored rows into (ok, failed); failures keep a reason
    instead of silently shortening the result."""
    ok = scored.filter(F.col(score_col).isNotNull())
    failed = scored.filter(F.col(score_col).isNull()).withColumn("error", reason)
    return ok, failed


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=("mode",),
                fmt: str = "parquet") -> None:
    """S9-S11 + S15: overwrite / append a result table, partitioned by
    mode-like columns (partition pruning replaces per-mode file names)."""
    w = df.write.mode(mode)
    cols = [c for c in partition_by if c in df.columns]
    if cols:
        w = w.partitionBy(*cols)
    w.format(fmt).save(path)


def to_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export, one file per task; maps / arrays / structs are written as
    JSON text, blanks at the ends of a text and empty texts are kept."""
    out = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                      if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(f.name)
                      for f in df.schema.fields])
    (out.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def to_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Entries as JSON Lines."""
    df.write.mode(mode).json(path)


def to_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write once and re-read (a lineage cut that survives executor loss)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def nan_to_null(df: DataFrame, cols=None) -> DataFrame:
    """NaN -> NULL on ingest for floating columns (pandas means skip NaN; SQL
    aggregates skip NULL but would propagate NaN)."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cols = [c for c in (cols or fl) if c in fl]
    return df.select(*[F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])
