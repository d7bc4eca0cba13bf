"""Append-only ledger of finished work: batch folders and a commit manifest.

``<path>/data/batch=<id>`` holds a batch's rows, ``<path>/commits/batch=<id>``
one row that makes them count.  A batch is written whole, then committed by a
file that appears in one step; a run killed in between leaves an uncommitted
folder that nothing reads and the next attempt replaces.  Recording a
committed batch again does nothing, so retries lose and repeat no row.

A ledger has one writer at a time (a run, or a stream's epochs).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet folder; an empty table when it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The committed batches: ``batch, n_rows``."""
    schema = T.StructType([T.StructField("n_rows", T.LongType()), T.StructField(BATCH, T.LongType())])
    return _read(spark, f"{path}/commits", schema).select(BATCH, "n_rows")


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, with_batch: bool = False) -> DataFrame:
    """The rows of all committed batches; none when there is no ledger yet.
    The manifest is small (a row per batch) and prunes the folders that are read."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    rows = _read(spark, f"{path}/data", full).join(commits(spark, path).select(BATCH), BATCH, "left_semi")
    return rows.select(*schema.names, *[BATCH] * with_batch)


def next_id(spark: SparkSession, path: str) -> int:
    """The number after the newest committed batch."""
    newest = commits(spark, path).agg(F.max(BATCH)).first()[0]
    return 0 if newest is None else newest + 1


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """The batch's folder, replacing what a failed attempt left there."""
    rows.write.mode("overwrite").parquet(f"{path}/data/{BATCH}={batch}")


def commit(spark: SparkSession, path: str, batch: int) -> None:
    """Make a written batch count: one row in one file."""
    n = spark.read.parquet(f"{path}/data/{BATCH}={batch}").count()
    (spark.range(1).select(F.lit(n).cast("bigint").alias("n_rows")).coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/commits/{BATCH}={batch}"))


def record(rows: DataFrame, path: str, batch: int) -> bool:
    """Write and commit a batch unless it is committed already."""
    spark = rows.sparkSession
    if commits(spark, path).where(F.col(BATCH) == batch).count():
        return False
    write_batch(rows, path, batch)
    commit(spark, path, batch)
    return True


def append_by(rows: DataFrame, path: str, by: str) -> None:
    """Append many batches in one job, keyed by a column.  Each value's
    folder is replaced as a whole (dynamic partition overwrite, published when
    the job ends), so appending a batch again leaves its rows once."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))
