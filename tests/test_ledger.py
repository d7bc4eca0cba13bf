"""Stored ledgers, retry-safe appends and the streaming runs built on them."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ascribe.operators import incremental as I
from ascribe.sources import ledger as L
from ascribe.streaming import runs as R


class Killed(Exception):
    pass


def killed(*_):
    raise Killed


def test_missing_ledger_reads_empty(spark, tmp_path):
    work = spark.range(3)
    assert L.read_ledger(spark, str(tmp_path / "none"), work.schema).count() == 0 and L.next_id(spark, str(tmp_path / "none")) == 0


def test_kill_between_write_and_commit_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    work, path = spark.range(25).withColumnRenamed("id", "k"), str(tmp_path / "ledger")
    rows = lambda: sorted(r.k for r in L.read_ledger(spark, path, work.schema).collect())
    assert I.run_batch(work, path, ["k"], ["k"], 10) == 0 and rows() == list(range(10))
    monkeypatch.setattr(L, "commit", killed)
    with pytest.raises(Killed):
        I.run_batch(work, path, ["k"], ["k"], 10)
    assert rows() == list(range(10))                        # written, but it does not count
    monkeypatch.undo()
    assert I.run_batch(work, path, ["k"], ["k"], 5) == 1 and rows() == list(range(15))      # the leftover is replaced
    assert I.run_batch(work, path, ["k"], ["k"], 5, 1) == 1 and rows() == list(range(15))   # committed: nothing added
    for batch in (2, 3):
        assert I.run_batch(work, path, ["k"], ["k"], 10) == batch and rows() == list(range(25))
    assert [r.n_rows for r in L.commits(spark, path).orderBy("batch").collect()] == [10, 5, 10, 0]
    # a repeated work row is one item; an empty table adds nothing
    assert I.pending(work.union(work), L.read_ledger(spark, path, work.schema), ["k"]).count() == 0
    I.run_batch(work.limit(0), str(tmp_path / "empty"), ["k"], ["k"], 10)
    assert L.read_ledger(spark, str(tmp_path / "empty"), work.schema).count() == 0


def test_an_empty_retry_replaces_a_killed_write(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), spark.range(4)
    L.write_batch(rows, path, 0)
    assert L.record(rows.where("id > 9"), path, 0) and L.read_ledger(spark, path, rows.schema).count() == 0


def test_append_is_retry_safe(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, day string")
    for part in (rows, rows.where("day = 'a'"), rows.where("day is null"), rows.limit(0)):
        L.append_by(part, path, "day")
    assert sorted((r.k, r.day) for r in spark.read.schema(rows.schema).parquet(path).collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, None)]


def files(folder, frames):
    folder.mkdir(exist_ok=True)
    for name, rows in frames.items():
        pd.DataFrame(rows).to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")


def test_stream_resumes_in_bounded_epochs(spark, tmp_path, monkeypatch):
    files(tmp_path / "work", {f"f{k}": {"k": range(10 * k, 10 * k + 10)} for k in range(6)})
    work, run = str(tmp_path / "work"), str(tmp_path / "run")
    earlier = spark.createDataFrame([(k,) for k in (3, 17, 3, 59)], "k bigint")
    size = R.table_bytes(spark, work)
    go = lambda **how: R.resume_stream(spark, work, earlier, ["k"], run=run, max_bytes_per_trigger=size // 3, **how)
    assert 0 < go(stop_before=1).count() < 57
    done = L.commits(spark, f"{run}/out").count()
    assert done == 1
    # killed after the write of an epoch, before its commit
    real = L.commit
    monkeypatch.setattr(L, "commit", lambda s, p, b: killed() if p.endswith("/out") else real(s, p, b))
    with pytest.raises(Exception, match="Killed"):
        go()
    monkeypatch.undo()
    # the earlier ledger has grown meanwhile; the run keeps to what it started with
    earlier = spark.createDataFrame([(k,) for k in range(60)], "k bigint")
    want = sorted(set(range(60)) - {3, 17, 59})
    assert sorted(r.k for r in go().collect()) == want and L.commits(spark, f"{run}/out").count() >= 3
    assert sorted(r.k for r in go().collect()) == want


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_keyed_state_reports_late_rows(spark, tmp_path):
    folder, run = tmp_path / "in", str(tmp_path / "run")

    def deliver(name, rows):
        files(folder, {name: {"k": [r[0] for r in rows], "ts": [r[1] for r in rows], "v": [r[2] for r in rows]}})
        kept, late = R.dedup_stream(spark, R.file_stream(spark, str(folder)), ["k"], delay="2 DAYS", run=run)
        return sorted((r.k, r.v) for r in kept.collect()), sorted((r.k, r.v) for r in late.collect())
    kept, late = deliver("a", [(1, at(1), "x"), (2, at(2), "x"), (1, at(1), "x"), (9, None, "none")])
    assert kept == [(1, "x"), (2, "x")] and late == [(9, "none")]
    kept, late = deliver("b", [(1, at(1), "again"), (3, at(10), "x")])          # one day behind the newest: on time, a duplicate
    assert kept == [(1, "x"), (2, "x"), (3, "x")] and late == [(9, "none")]
    kept, late = deliver("c", [(4, at(5), "late"), (3, at(9), "again"), (5, at(9), "x")])
    assert kept == [(1, "x"), (2, "x"), (3, "x"), (5, "x")] and late == [(4, "late"), (9, "none")]
    assert deliver("d", [(5, at(9), "again")]) == (kept, late)
    # an epoch wrote its own rows only, not the result so far
    assert [r.n_rows for r in L.commits(spark, f"{run}/out").orderBy("batch").collect() if r.n_rows] == [2, 1, 1]


def test_update_mode_writes_touched_windows_only(spark, tmp_path):
    folder, run = tmp_path / "in", str(tmp_path / "run")

    def deliver(name, rows):
        files(folder, {name: {"ts": [r[0] for r in rows], "kind": [r[1] for r in rows], "v": [float(r[2]) for r in rows]}})
        out = R.windowed_stats(spark, R.file_stream(spark, str(folder)), ["kind"], "v", run=run)
        return sorted((r.w.start.day, r.kind, r.n, r.total_value) for r in out.collect())
    deliver("a", [(at(1), "a", 1), (at(1, 5), "a", 2), (at(2), "a", 4), (at(2), "b", 8)])
    got = deliver("b", [(at(2, 7), "b", 16)])
    assert got == [(1, "a", 2, 3.0), (2, "a", 1, 4.0), (2, "b", 2, 24.0)]
    assert [r.n_rows for r in L.commits(spark, f"{run}/out").orderBy("batch").collect() if r.n_rows] == [3, 1]


def test_pause_between_batches(spark, tmp_path):
    files(tmp_path / "in", {f"f{k}": {"k": [k]} for k in range(3)})
    query = R.run_append(R.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"), "1 second")
    try:
        query.processAllAvailable()
        starts = [pd.Timestamp(p["timestamp"]) for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    assert len(starts) == 3 and min((b - a).total_seconds() for a, b in zip(starts, starts[1:])) > 0.5
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("k") >= 0).count() == 3
