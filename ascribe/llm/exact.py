"""Exact duplicates through a persistent digest index (operator 6).

The index is a catalog table bucketed and sorted by the text's SHA-256, one
row per distinct text.  New rows are reduced to one digest row per text, the
known ones are removed by a sort-merge anti-join that reads the index bucket
by bucket without a shuffle of it, and the rest is appended.

Defined cases: a null text counts as empty; of equal texts in one load the row
with the largest ``doc_id`` stays (rows that repeat that id too: each repeats
the decision); a null ``doc_id`` loses to any other, and a group of null ids
only keeps a null id; an empty load appends nothing; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGEST = "text_sha256"


def digest(text: str | Column = "text") -> Column:
    """Lower-case hex SHA-256 of the text's UTF-8; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def create_index(spark: SparkSession, table: str, path: str, buckets: int | None = None) -> None:
    """Create the index ``table`` at ``path`` (a folder all machines share), or
    attach to the one that a former session left there.  Without a number, as
    many buckets as the session has shuffle partitions."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {table}
                  ({DIGEST} STRING, keep_id BIGINT, group_size BIGINT) USING parquet
                  CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {int(buckets)} BUCKETS
                  LOCATION '{path}'""")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per distinct text: its digest, the largest key, the number of rows."""
    return (docs.select(F.col(key).cast("bigint").alias("id"), digest(text).alias(DIGEST))
            .groupBy(DIGEST).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def _property(spark: SparkSession, table: str, name: str) -> str:
    return spark.sql(f"DESCRIBE EXTENDED {table}").where(F.col("col_name") == name).first()["data_type"]


def append_new(found: DataFrame, table: str) -> None:
    """Append the groups whose digest the index lacks.  A repeated load finds
    its own digests and appends none."""
    spark = found.sparkSession
    spark.catalog.refreshTable(table)
    fresh = found.join(spark.table(table).select(DIGEST).hint("merge"), DIGEST, "left_anti")
    buckets = int(_property(spark, table, "Num Buckets"))
    (fresh.repartition(buckets, DIGEST).write.mode("append").format("parquet")
     .bucketBy(buckets, DIGEST).sortBy(DIGEST).saveAsTable(table))
    spark.catalog.refreshTable(table)


def read_index(spark: SparkSession, table: str) -> DataFrame:
    """The index as plain files: a join with skewed rows then shuffles both
    sides, which lets Spark split a hot digest's partition; a bucketed read would not."""
    return spark.read.schema(spark.table(table).schema).parquet(_property(spark, table, "Location"))


def resolve(docs: DataFrame, index: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with its group's kept id, size and its own fate.
    The rows of one text may be a third of all; Spark splits such a partition
    in this join, as the index side has one row per text."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), digest(text).alias(DIGEST))
    known = index.select(DIGEST, "keep_id", "group_size")
    return (rows.join(known, DIGEST)
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), DIGEST))


def dedup(docs: DataFrame, table: str | None = None, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Load ``docs`` into the index and return one decision per row.  Without a
    table and path an index of its own is made in the shared folder."""
    from ..session import scratch_path
    spark = docs.sparkSession
    table = table or f"digests_{uuid.uuid4().hex[:12]}"
    create_index(spark, table, path or scratch_path(spark, table), buckets)
    append_new(groups(docs), table)
    return resolve(docs, read_index(spark, table))


def keep_largest(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their
    names.  Only the kept (digest, id) pairs, one per text, are joined to the
    rows; of rows that repeat both the text and the id, one stays."""
    from ..session import scratch_path
    spark = docs.sparkSession
    table = f"digests_{uuid.uuid4().hex[:12]}"
    create_index(spark, table, scratch_path(spark, table))
    append_new(groups(docs), table)
    index = read_index(spark, table)
    rows = docs.select(F.struct("*").alias("row"), digest().alias("own"), F.col("doc_id").cast("bigint").alias("id"))
    same = [rows["own"] == index[DIGEST], rows["id"].eqNullSafe(index["keep_id"])]
    return rows.join(index, same, "left_semi").dropDuplicates(["id", "own"]).select("row.*")
