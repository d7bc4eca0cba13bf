"""Token counts of documents in flat, unindexed token files (operator 4).

A token file is a bare run of fixed-width ids in which an end-of-document id
closes each document; nothing tells where documents lie.  Files are read as
blocks of fixed size, cut without regard to documents; each block is a byte
range that is read by itself, so the blocks of one file are spread over tasks.  In each block a
vectorised search finds the end ids; a prefix scan over the blocks' small
summaries (tokens, ends, place of the last end) gives every block its first
token's place, its first document's number and the length carried into it, so
that documents which cross blocks are put together.  The scan has two levels,
blocks within a stretch and stretches within a file, so one huge file is no
burden to one task.

Defined cases: a file without an end id is one open document; tokens after
the last end id are an open document too (``closed`` false); two end ids in a
row hold an empty document; an empty file has none; a null text is an empty
document; repeated rows are documents each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices
from .tokens import vocabulary_json, worker_tokenizer

END_ID = 49407                 # <|endoftext|> of the default vocabulary
BLOCK_TOKENS = 1 << 19
STRETCH = 1024                 # blocks of a file that one window of the scan holds
TASK_BYTES = 32 << 20          # bytes of token files that one task reads
BLOCKS = "file_id bigint, block bigint, data binary"


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = END_ID,
                      block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenize documents into flat files of raw little-endian 16-bit ids, one
    per task, in the folder ``path``, and return their blocks; no shuffle.
    Spark's text writer puts out bytes as they are, with the end id as its
    line separator."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(vocabulary_json(vocabulary_path))
    arrow = pa.schema([("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(vocabulary.value, plain_specials=True)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = tokenizer.encode(part.column("text"))
                ids = np.asarray(ids).astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())],
                                                 schema=arrow)
    (docs.select("text").mapInArrow(run, "data binary").selectExpr("cast(data as string) value").write.mode("overwrite")
     .option("lineSep", end_id.to_bytes(2, "little").decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path))
    return blocks_of_files(spark, path, 2, block_tokens)


def open_file(path: str):
    """A file of a store that Spark and pyarrow both know, open for reads at any place."""
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    if path.startswith("file://"):
        path = path.removeprefix("file://")
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem().open_input_file(path)
    store, inner = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(inner)


def blocks_of_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of existing flat files; ``file_id`` is a hash of the path.  Spark
    lists paths and lengths only; every block's byte range is read in the task
    that its (path, block) falls to."""
    arrow = pa.schema([("file_id", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
    size = width * block_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, file = None, None
            for row in sorted(batch.to_pylist(), key=lambda r: (r["path"], r["block"])):
                if row["path"] != at:
                    if file is not None:
                        file.close()
                    at, file = row["path"], open_file(row["path"])
                want = min(size, row["length"] - row["block"] * size)
                raw = file.read_at(want, row["block"] * size)
                if len(raw) != want:
                    raise OSError(f"{at}: {len(raw)} of {want} bytes read in block {row['block']}")
                yield pa.RecordBatch.from_arrays([pa.array([row["file_id"]]), pa.array([row["block"]]), pa.array([raw], pa.binary())], schema=arrow)
            if file is not None:
                file.close()
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    blocks = files.select(F.xxhash64("path").alias("file_id"), "path", "length",
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {size}"))).alias("block"))
    return blocks.repartition(tasks, "path", "block").mapInArrow(read, BLOCKS)


def block_ends(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """``file_id, block, n_tokens, ends``: places of the end ids in each block."""
    arrow = pa.schema([("file_id", pa.int64()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in enumerate(batch.column("data")):
                ids = np.frombuffer(value.as_buffer(), dtype) if value.is_valid else np.zeros(0, dtype)
                yield pa.RecordBatch.from_arrays([batch.column("file_id").slice(k, 1), batch.column("block").slice(k, 1),
                                                  pa.array([len(ids)], pa.int64()),
                                                  pa.array([np.flatnonzero(ids == end_id)], pa.list_(pa.int64()))], schema=arrow)
    return blocks.select("file_id", "block", "data").mapInArrow(run, "file_id bigint, block bigint, n_tokens bigint, ends array<bigint>")


def prefix_scan(summary: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Adds to ``file_id, block, n_tokens, n_ends, last_end`` (null without
    ends) what lies before each block of its file: ``tokens_before``,
    ``ends_before`` and ``open_from``, the place after the last end."""
    s = summary.withColumn("_s", F.floor(F.col("block") / stretch))

    def before(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        df = df.withColumn("_t", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).withColumn("_e", F.coalesce(F.sum("n_ends").over(w), F.lit(0)))
        return df.withColumn("_after", F.col("_t") + F.col("last_end") + 1).withColumn("_o", F.max("_after").over(w))
    inner = before(s, ["file_id", "_s"], "block")
    totals = inner.groupBy("file_id", "_s").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_ends").alias("n_ends"),
                                                (F.max("_after") - 1).alias("last_end"))
    outer = before(totals, ["file_id"], "_s").select("file_id", "_s", F.col("_t").alias("_t2"), F.col("_e").alias("_e2"), F.col("_o").alias("_o2"))
    return inner.join(outer, ["file_id", "_s"]).select(
        "file_id", "block", "n_tokens", "n_ends", (F.col("_t") + F.col("_t2")).alias("tokens_before"),
        (F.col("_e") + F.col("_e2")).alias("ends_before"),
        F.coalesce(F.col("_o") + F.col("_t2"), "_o2", F.lit(0)).alias("open_from"))


def document_lengths(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """One row per document: ``file_id, doc_index`` (from 0 in its file),
    ``first_token``, ``n_tokens`` without its end id, and ``closed``."""
    found = materialize(block_ends(blocks, end_id, dtype), "ends")
    summary = found.select("file_id", "block", "n_tokens", F.size("ends").cast("bigint").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last_end"))
    placed = materialize(prefix_scan(summary), "scan")
    both = found.select("file_id", "block", "ends").join(placed, ["file_id", "block"])
    ended = both.select("file_id", "tokens_before", "ends_before", "open_from", "ends", F.posexplode("ends").alias("i", "end"))
    first = F.when(F.col("i") == 0, F.col("open_from")).otherwise(F.col("tokens_before") + F.get("ends", F.col("i") - 1) + 1)
    closed = ended.select("file_id", (F.col("ends_before") + F.col("i")).alias("doc_index"), first.alias("first_token"),
                          (F.col("tokens_before") + F.col("end") - first).alias("n_tokens"), F.lit(True).alias("closed"))
    # the last place of a file against the place after its last end
    tail = (both.groupBy("file_id").agg(F.max(F.col("tokens_before") + F.col("n_tokens")).alias("all"), F.sum("n_ends").alias("n_ends"),
                                        F.max(F.coalesce(F.col("tokens_before") + F.try_element_at("ends", F.lit(-1)) + 1, F.lit(0))).alias("from"))
            .where(F.col("all") > F.col("from")))
    return closed.union(tail.select("file_id", "n_ends", "from", F.col("all") - F.col("from"), F.lit(False)))
