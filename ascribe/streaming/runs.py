"""Resumable, exactly-once incremental runs on Structured Streaming.

Each run reads new files of a table as a stream and keeps everything about
itself in the folder ``run``, which the caller names in the cluster's shared
storage: progress under ``run/*-checkpoint``, results as ledgers
(``sources.ledger``), one batch per epoch.  A second call with the same folder
resumes: it works off what is new and redoes or duplicates nothing.  Without a
folder a fresh one in ``spark.checkpoint.dir`` is used.  A run ends when its
input is worked off, however long that takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import ledger

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STOPPED = "stopped before epoch"


def file_stream(spark: SparkSession, table_path: str, max_files_per_trigger: int | None = None,
                max_bytes_per_trigger: int | None = None) -> DataFrame:
    """A parquet table (file or folder) as a stream; T2: at most so many files,
    or files of so many bytes together, per batch; all that is new without a number.

    A pattern matches a folder as well as a single file, on any store, so the
    path need not be looked at.
    """
    schema = spark.read.parquet(table_path).schema
    head, name = table_path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.parquet(f"{head}/[{name[0]}]{name[1:]}")


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.sum("file_size")).first()[0] or 0


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run_append(stream: DataFrame, out_path: str, ckpt_path: str, processing_time: str | None = None):
    """T1 + T3: process everything available now, append to a file sink.

    The sink's commit log makes each batch visible exactly once; after a crash
    the run restarts from the checkpoint and re-executes only the open batch.
    With ``processing_time`` (T4, e.g. "60 seconds" for a rate-limited remote
    scorer) the query keeps running, one micro-batch per interval, and is
    returned to the caller instead of awaited.
    """
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", out_path).option("checkpointLocation", ckpt_path))
    if processing_time:
        return w.trigger(processingTime=processing_time).start()
    _finish(w.trigger(availableNow=True).start())


def run_epochs(stream: DataFrame, path: str, ckpt_path: str, step: Callable[[DataFrame, int], DataFrame] | None = None,
               mode: str = "append", stop_before: int | None = None) -> bool:
    """Every epoch's rows, after ``step``, recorded as one batch of the
    ledger at ``path``.  An epoch that was recorded but not yet marked in the
    checkpoint is run again and adds nothing.  ``stop_before`` ends the run in
    the middle, as a lost driver would; returns whether it ran to its end."""
    def sink(batch: DataFrame, epoch: int) -> None:
        if stop_before is not None and epoch >= stop_before:
            raise RuntimeError(f"{STOPPED} {epoch}")
        ledger.record(step(batch, epoch) if step else batch, path, epoch)

    query = (stream.writeStream.outputMode(mode).foreachBatch(sink)
             .option("checkpointLocation", ckpt_path).trigger(availableNow=True).start())
    try:
        _finish(query)
    except StreamingQueryException as e:
        if stop_before is None or STOPPED not in str(e):
            raise
        return False
    return True


def resume_stream(spark: SparkSession, work_path: str, earlier: DataFrame, keys, columns=None, run: str | None = None,
                  name: str = "resume", max_bytes_per_trigger: int | None = None, stop_before: int | None = None) -> DataFrame:
    """S12 + T1-T3: stream the work table in bounded epochs, skip keys that an
    ``earlier`` ledger holds, record the rest exactly once.  The earlier keys
    are written once per run, so a restart skips the same ones."""
    run, keys = run or scratch_path(spark, name), list(keys)
    ledger.record(earlier.select(*keys).dropDuplicates(keys), f"{run}/known", 0)
    known = ledger.read_ledger(spark, f"{run}/known", earlier.select(*keys).schema)
    stream = file_stream(spark, work_path, max_bytes_per_trigger=max_bytes_per_trigger)
    stream = stream.select(*columns) if columns else stream
    run_epochs(stream, f"{run}/out", f"{run}/out-checkpoint", lambda batch, _: batch.join(known, keys, "left_anti"),
               stop_before=stop_before)
    return ledger.read_ledger(spark, f"{run}/out", stream.schema)


def split_late(stream: DataFrame, run: str, event_time: str, delay: str) -> None:
    """Deal a stream's rows into the ledgers ``run/on-time`` and ``run/late``.
    A row is late when it lies more than ``delay`` before the newest event time
    of the epochs before its own, or has no event time."""
    spark = stream.sparkSession
    seen = T.StructType([T.StructField("newest", stream.schema[event_time].dataType)])

    def route(batch: DataFrame, epoch: int) -> DataFrame:
        marks = ledger.read_ledger(batch.sparkSession, f"{run}/marks", seen, with_batch=True)
        newest = marks.where(F.col(ledger.BATCH) < epoch).agg(F.max("newest")).first()[0]
        late = F.col(event_time).isNull()
        if newest is not None:
            late = late | (F.col(event_time) < F.lit(newest).cast(seen[0].dataType) - F.expr(f"INTERVAL {delay}"))
        ledger.record(batch.where(late), f"{run}/late", epoch)
        ledger.record(batch.agg(F.max(event_time).alias("newest")), f"{run}/marks", epoch)
        return batch.where(~late)

    run_epochs(stream, f"{run}/on-time", f"{run}/route-checkpoint", route)


def dedup_stream(spark: SparkSession, stream: DataFrame, keys, event_time: str = "ts", delay: str = "2 DAYS",
                 run: str | None = None, name: str = "dedup") -> tuple[DataFrame, DataFrame]:
    """T5: the first row of each key, and the rows that came too late to tell.

    On-time rows pass a keyed state store (RocksDB, one entry per key, dropped
    once the watermark has passed it by ``delay``), so an epoch reads and
    writes state for its own keys only, never the result so far.  Late rows are
    not dropped but kept beside the result.  All rows routed since the last
    call make one epoch: its watermark comes from earlier ones, so no row that
    was on time when it was routed is late here."""
    run, keys = run or scratch_path(spark, name), list(keys)
    split_late(stream, run, event_time, delay)
    accepted = (spark.readStream.schema(stream.schema).parquet(f"{run}/on-time/data/batch=*")
                .withColumn("_time", F.col(event_time).cast("timestamp")))
    first = accepted.withWatermark("_time", delay).dropDuplicatesWithinWatermark(keys).drop("_time")
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        run_epochs(first, f"{run}/out", f"{run}/out-checkpoint")
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    return ledger.read_ledger(spark, f"{run}/out", stream.schema), ledger.read_ledger(spark, f"{run}/late", stream.schema)


def newest_by(rows: DataFrame, keys) -> DataFrame:
    """Per key the row of the newest batch: merges updates into a table.
    A map-side combine keeps one row per key and task."""
    rest = [c for c in rows.columns if c not in (*keys, ledger.BATCH)]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ledger.BATCH).alias("_r"))
    return best.select(*keys, *[f"_r.{c}" for c in rest])


def windowed_stats(spark: SparkSession, stream: DataFrame, keys, value: str, event_time: str = "ts",
                   window: str = "1 day", name: str = "stats", run: str | None = None) -> DataFrame:
    """Running count / sum per (event-time window, keys), update mode: an
    epoch records the windows it touched and no other; readers take each
    window's newest row.

    Windows are taken on the wall-clock (TIMESTAMP_NTZ) event time, so day
    boundaries do not move with the session time zone.  The state holds one
    row per window and key (small).
    """
    run = run or scratch_path(spark, name)
    s = stream.withColumn(event_time, F.col(event_time).cast("timestamp_ntz"))
    agg = (s.groupBy(F.window(event_time, window).alias("w"), *keys)
           .agg(F.count("*").alias("n"), F.sum(value).alias("total_value")))
    run_epochs(agg, f"{run}/out", f"{run}/out-checkpoint", mode="update")
    return newest_by(ledger.read_ledger(spark, f"{run}/out", agg.schema, with_batch=True), ["w", *keys])
