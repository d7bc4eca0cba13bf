"""Resumable batch runs over a work table and a stored ledger (stage 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..session import scratch_path
from ..sources import ledger
from .registry import register

NEXT_N = 500                # items a step takes
STEPS = 2                   # steps of the earlier run
COLUMNS = ["event_id", "user_id", "event_type", "value"]

_IN_ORDER = "(SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events)"


def earlier_run(t, work, steps: int = STEPS) -> str:
    """A run's first steps, recorded in a ledger of its own; its path."""
    path = scratch_path(t.spark, "ledger")
    for _ in range(steps):
        I.run_batch(work, path, ["event_id"], ["event_id"], NEXT_N)
    return path


@register("resume_anti", f"""
SELECT event_id, user_id, event_type FROM {_IN_ORDER} e WHERE rn > {STEPS * NEXT_N} AND rn <= {(STEPS + 1) * NEXT_N}
""")
def resume_anti(t):
    """J5 + T1 + U4 + A15 + O2 + S7: the next N work items that the stored
    ledger of an earlier run lacks."""
    work = t.events.select("event_id", "user_id", "event_type")
    done = ledger.read_ledger(t.spark, earlier_run(t, work), work.schema)
    return I.next_batch(I.pending(work, done, ["event_id"]), ["event_id"], NEXT_N)


@register("resume_merge", f"""
SELECT event_id, user_id, event_type, value, CAST((rn - 1) // {NEXT_N} AS BIGINT) AS batch
FROM {_IN_ORDER} e WHERE rn <= {(STEPS + 1) * NEXT_N}
""")
def resume_merge(t):
    """U6 + S12: the ledger after one more step; a step whose write was not
    committed is repeated, a committed one that is repeated adds nothing."""
    work = t.events.select(*COLUMNS)
    path = earlier_run(t, work)
    ledger.write_batch(work.where("event_id % 7 = 0"), path, STEPS)     # a killed step: written, not committed
    batch = I.run_batch(work, path, ["event_id"], ["event_id"], NEXT_N)
    I.run_batch(work, path, ["event_id"], ["event_id"], NEXT_N, batch)
    return ledger.read_ledger(t.spark, path, work.schema, with_batch=True)


@register("append_retry", """
SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events
""")
def append_retry(t):
    """Every event appended by day; the days of one event type's rows are
    appended a second time, and each row is there once."""
    rows = t.events.select(*COLUMNS, F.date_format("ts", "yyyy-MM-dd").alias("day"))
    path = scratch_path(t.spark, "appended")
    ledger.append_by(rows, path, "day")
    ledger.append_by(rows.where(F.dayofmonth("day") % 2 == 0), path, "day")
    # days are text, not dates: the schema keeps partition values as written
    return t.spark.read.schema(rows.schema).parquet(path)
