"""Structured Streaming forms of the resumable run (stage 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import ledger
from ..streaming import runs as R
from .incremental import COLUMNS, NEXT_N, STEPS, _IN_ORDER, earlier_run
from .registry import register, round_doubles
from .sql import rnd as _rnd

EPOCHS = 4                  # deliveries, or epochs at least, of a stream query
DELAY = "2 DAYS"            # how far behind the newest event a row is still on time
STRAGGLERS = "05"           # events whose md5 sorts below come with the last delivery (one in fifty)


def delivered(t) -> str:
    """The events as files of about equal size, in time order; their folder."""
    path = scratch_path(t.spark, "delivered")
    n = max(2 * EPOCHS, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    t.events.repartitionByRange(n, "ts").write.parquet(path)
    return path


@register("stream_resume", f"""
SELECT event_id, user_id, event_type, value FROM {_IN_ORDER} e WHERE rn > {STEPS * NEXT_N}
""")
def stream_resume(t):
    """S12 + T1-T3: the work table streamed in epochs bounded by bytes, keys of
    the earlier run's ledger skipped; stopped after the first epoch and
    resumed from the checkpoint, every row is recorded once."""
    work = t.events.select(*COLUMNS)
    earlier = ledger.read_ledger(t.spark, earlier_run(t, work), work.schema)
    path, run = delivered(t), scratch_path(t.spark, "stream-resume")
    some = R.table_bytes(t.spark, path) // EPOCHS + 1
    for stop in (1, None):
        out = R.resume_stream(t.spark, path, earlier, ["event_id"], COLUMNS, run, max_bytes_per_trigger=some, stop_before=stop)
    return out


@register("stream_dedup", f"""
WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
e AS (SELECT user_id, event_type, ts, strftime(ts, '%Y-%m-%d') AS day,
             CASE WHEN md5(CAST(event_id AS VARCHAR)) < '{STRAGGLERS}' THEN {EPOCHS - 1}
                  ELSE {EPOCHS} * (epoch_us(ts) - epoch_us(lo)) // (epoch_us(hi) - epoch_us(lo) + 1) END AS epoch
      FROM events, b),
m AS (SELECT epoch, max(ts) AS newest FROM e GROUP BY epoch),
l AS (SELECT e.*, coalesce(ts < (SELECT max(newest) FROM m WHERE m.epoch < e.epoch) - INTERVAL {DELAY}, false) AS late FROM e)
SELECT 'kept' AS status, user_id, event_type, day, CAST(1 AS BIGINT) AS n FROM l WHERE NOT late GROUP BY ALL
UNION ALL
SELECT 'late' AS status, user_id, event_type, day, count(*) AS n FROM l WHERE late GROUP BY ALL
""")
def stream_dedup(t):
    """T5: the first event of each user, type and day, delivered in time order
    with stragglers at the end; those that are too late are reported."""
    keys = ["user_id", "event_type", "day"]
    rows = t.events.select("user_id", "event_type", "ts", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    lo, hi = rows.agg(F.min("ts")).scalar(), rows.agg(F.max("ts")).scalar()
    since = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    epoch = F.when(F.md5(F.col("event_id").cast("string")) < STRAGGLERS, EPOCHS - 1).otherwise(
        F.floor(F.lit(EPOCHS) * since(lo, F.col("ts")) / (since(lo, hi) + 1)))
    folder, run = scratch_path(t.spark, "watched"), scratch_path(t.spark, "stream-dedup")
    dealt = rows.withColumn("epoch", epoch)
    for k in range(EPOCHS):                             # one delivery, one run
        dealt.where(F.col("epoch") == k).drop("epoch", "event_id").write.mode("append").parquet(folder)
        kept, late = R.dedup_stream(t.spark, R.file_stream(t.spark, folder), keys, delay=DELAY, run=run)
    kept = kept.select(F.lit("kept").alias("status"), *keys, F.lit(1).cast("bigint").alias("n"))
    return kept.unionByName(late.groupBy(*keys).agg(F.count("*").alias("n")).select(F.lit("late").alias("status"), *keys, "n"))


@register("stream_stats", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n,
       {_rnd('sum(value)')} AS total_value
FROM events GROUP BY ALL
""")
def stream_stats(t):
    """Running count and sum per (day window, event type), update mode over several epochs."""
    path = delivered(t)
    s = R.file_stream(t.spark, path, max_bytes_per_trigger=R.table_bytes(t.spark, path) // EPOCHS + 1)
    out = R.windowed_stats(t.spark, s, ["event_type"], "value", name="stream-stats")
    return round_doubles(out.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"),
                                    "event_type", "n", "total_value"))
