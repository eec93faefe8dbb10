"""Incremental audit state equals the batch state after each micro-batch."""

import datetime as dt

import os

import pytest

from tallyhouse.operators import audit
from tallyhouse.sources import testdata
from tallyhouse.sources.warehouse import POINTER
from tallyhouse.streaming import audit_stream


def test_stream_state_matches_batch(spark, scratch):
    events_dir, state, ckpt = scratch + "/events", scratch + "/state", scratch + "/ckpt"
    t0 = dt.datetime(2026, 5, 3, 10, 0, 0)
    first = audit.event(spark, "r1", "queued", t0).unionByName(
        audit.event(spark, "r1", "running", t0 + dt.timedelta(seconds=1)))
    first.write.mode("append").parquet(events_dir)
    q = audit_stream.start(spark, events_dir, state, ckpt, trigger_once=True)
    q.awaitTermination()
    assert audit_stream.current_runs(spark, state).first().status == "running"

    second = audit.event(spark, "r1", "succeeded", t0 + dt.timedelta(seconds=5.5),
                         row_counts={"orders": 2}).unionByName(
        audit.event(spark, "r2", "queued", t0 + dt.timedelta(minutes=1)))
    second.write.mode("append").parquet(events_dir)
    q = audit_stream.start(spark, events_dir, state, ckpt, trigger_once=True)
    q.awaitTermination()

    cols = ["run_id", "status", "duration_seconds", "row_counts"]
    streamed = sorted(tuple(r) for r in audit_stream.current_runs(spark, state).select(cols).collect())
    batch = sorted(tuple(r) for r in audit.run_state(spark.read.parquet(events_dir)).select(cols).collect())
    assert streamed == batch
    assert dict((r[0], r[1]) for r in streamed) == {"r1": "succeeded", "r2": "queued"}


def test_given_events_in_several_batches(spark, scratch):
    """The given log, dealt into files, folds batch by batch to the batch state."""
    sf = "/root/testdata/sf0.001"
    files = scratch + "/files"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(files)
    cols = ["run_id", "status", "started_at", "completed_at", "duration_seconds", "row_counts", "lake_prefix", "error_summary"]
    rows = lambda df: sorted(map(str, df.select(cols).collect()))
    streamed = audit_stream.fold_files(spark, files, scratch + "/fold", testdata.audit_log, max_files_per_trigger=1)
    assert rows(streamed) == rows(audit.run_state(testdata.audit_events(spark, sf)))


def test_lost_pointer_raises(spark, scratch):
    write = audit_stream.state_writer(scratch + "/state")
    t0 = dt.datetime(2026, 5, 3, 10, 0, 0)
    batch = audit.event(spark, "r1", "queued", t0).groupBy("run_id").agg(*_aggregates())
    write(batch, 0)
    os.remove(f"{scratch}/state/{POINTER}")
    with pytest.raises(RuntimeError, match="is lost"):
        write(batch, 1)


def _aggregates():
    from pyspark.sql import functions as F
    return [F.max_by(F.struct(*audit_stream.LATEST), "event_ts").alias("last"),
            F.min("event_ts").alias("started_at"), F.min("event_ts").alias("queued_at")]
