"""Incremental run-audit state with Structured Streaming.

The pipeline appends audit events (queued / running / succeeded / failed) as
files to an events folder. Instead of recomputing every run's state from the
whole log on each status request, a streaming query keeps the latest event per
run as state and emits changed runs per micro-batch:

    readStream (events folder, declared schema)
      → withWatermark(event_ts, retention)   bounds the state kept per run
      → groupBy(run_id).agg(max_by(event struct, event_ts), min(...))
      → writeStream update mode → foreachBatch

``foreachBatch`` folds the changed runs into a small state table: the previous
snapshot plus the batch, latest event per run (the same ``max_by`` rule as the
batch :func:`tallyhouse.operators.audit.run_state`), written to a folder named
by the batch id and published through the same pointer swap as the warehouse.
Replaying a batch after a failure rewrites the same folder, so the sink is
idempotent; the checkpoint lives in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import EVENT_SCHEMA
from ..sources.warehouse import POINTER, read_text, write_text_atomic

LATEST = ["status", "row_counts", "lake_prefix", "error_summary", "event_ts"]


def run_updates(events: DataFrame, retention: str = "7 days") -> DataFrame:
    """Streaming aggregate: per run, its latest event and first start time."""
    return (events.withWatermark("event_ts", retention)
            .groupBy("run_id")
            .agg(F.max_by(F.struct(*LATEST), "event_ts").alias("last"),
                 F.min(F.when(F.col("status") != "queued", F.col("event_ts"))).alias("started_at"),
                 F.min("event_ts").alias("queued_at")))


def _fold(previous: DataFrame | None, batch: DataFrame) -> DataFrame:
    both = batch if previous is None else previous.unionByName(batch)
    return both.groupBy("run_id").agg(
        F.max_by("last", "last.event_ts").alias("last"),
        F.min("started_at").alias("started_at"),
        F.min("queued_at").alias("queued_at"))


def read_state(spark: SparkSession, state_root: str) -> DataFrame | None:
    version = read_text(spark, f"{state_root}/{POINTER}")
    if not version:
        return None
    return spark.read.parquet(f"{state_root}/{version}")


def state_writer(state_root: str):
    """``foreachBatch`` function folding each micro-batch into the state table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = read_state(spark, state_root)
        if previous is None and batch_id > 0:
            raise RuntimeError(f"the state before batch {batch_id} is lost under {state_root}; "
                               "start with a new checkpoint to fold all events again")
        folded = _fold(previous, batch)
        target = f"batch={batch_id}"
        folded.write.mode("overwrite").parquet(f"{state_root}/{target}")
        write_text_atomic(spark, f"{state_root}/{POINTER}", target)
    return write


def start(spark: SparkSession, events_dir: str, state_root: str, checkpoint: str,
          trigger_once: bool = False, max_files_per_trigger: int | None = None,
          schema=EVENT_SCHEMA, project=None):
    """Start the incremental audit-state query (``availableNow`` when
    ``trigger_once``; it still honours ``max_files_per_trigger``). ``project``
    maps files of another ``schema`` to audit events."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(events_dir)
    if project:
        events = project(events)
    writer = (run_updates(events).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint)
              .foreachBatch(state_writer(state_root)))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_runs(spark: SparkSession, state_root: str) -> DataFrame | None:
    """The folded state in the shape of :func:`operators.audit.run_state`."""
    s = read_state(spark, state_root)
    if s is None:
        return None
    terminal = F.col("last.status").isin("succeeded", "failed")
    completed = F.when(terminal, F.col("last.event_ts"))
    start_ts = F.coalesce(F.col("started_at"), F.col("queued_at"))
    micros = F.unix_micros(completed) - F.unix_micros(start_ts)
    return s.select("run_id", F.col("last.status").alias("status"),
                    start_ts.alias("started_at"), completed.alias("completed_at"),
                    F.round(micros.cast("decimal(20,0)") / F.lit(1_000_000), 1).cast("double")
                    .alias("duration_seconds"),
                    F.col("last.lake_prefix").alias("lake_prefix"),
                    F.coalesce(F.col("last.row_counts"),
                               F.create_map().cast("map<string,bigint>")).alias("row_counts"),
                    F.col("last.error_summary").alias("error_summary"))


def fold_files(spark: SparkSession, path: str, root: str, project, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run state of the event files at ``path``, streamed as they lie there.

    ``project`` maps the files' columns to audit events inside the stream. The
    stream runs in a sibling session (same cluster, own SQL settings) with one
    state partition per core: a streaming aggregate visits a state store per
    shuffle partition in every batch, and the caller's settings stay untouched.
    The result equals the batch :func:`operators.audit.run_state` of the files.
    """
    streaming = spark.newSession()
    streaming.conf.set("spark.sql.shuffle.partitions",
                       str(max(1, spark.sparkContext.defaultParallelism)))
    # a plain path must be a folder for a stream; as a pattern it may be one file
    q = start(streaming, f"{path[:-1]}[{path[-1]}]", f"{root}/state", f"{root}/checkpoint", trigger_once=True,
              max_files_per_trigger=max_files_per_trigger,
              schema=spark.read.parquet(path).schema, project=project)
    q.awaitTermination()
    state = current_runs(spark, f"{root}/state")
    if state is None:  # no file, no batch
        from ..operators.audit import run_state
        return run_state(project(spark.read.parquet(path)))
    return state
