"""Run audit: append-only run events, current run state, pipeline status, and
credential redaction of error text.

The audit is a log of events (queued, started, succeeded, failed, released),
one row each. The state of a run is its latest event (``max_by`` over the
event time per run id); the pipeline status is the newest run plus the newest
succeeded run — a failed newest run does not hide the last success.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ACTIVE_RUN_STATUSES, MAX_SUMMARY_LENGTH, REDACTED, RUN_STATUSES

# --- fixed values: credential patterns (Java regex; RE2-compatible) ---------
CREDENTIAL_PATTERNS = (
    # URI carrying user:password@
    r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s@]*:[^\s@]*@\S*",
    # key=value / key: value whose name implies a secret
    r"(?i)[\w.\-]*(?:password|passwd|secret|token|credential"
    r"|access[_-]?key|api[_-]?key|private[_-]?key)[\w.\-]*\s*[=:]\s*\S+",
    # bare cloud access key ids
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
)
# --- end of fixed values ----------------------------------------------------

# Substrings one of which every match of the pattern at the same index must
# contain (lower-cased text, except for the key ids which are upper case).
# They let the costly backtracking regex run only on texts that can match;
# the result is identical.
_PREFILTERS = (
    ("lower", ("://",)),
    ("lower", ("password", "passwd", "secret", "token", "credential", "access", "api",
               "private")),
    ("exact", ("AKIA", "ASIA")),
)

EVENT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("row_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("lake_prefix", T.StringType()),
    T.StructField("error_summary", T.StringType()),
])


def redact(text: Column) -> Column:
    """Newlines to spaces, trimmed, every credential pattern → ``[redacted]``."""
    out = F.regexp_replace(F.regexp_replace(text, "\n", " "), r"^\s+|\s+$", "")
    lowered = F.lower(text)
    for pattern, (mode, needles) in zip(CREDENTIAL_PATTERNS, _PREFILTERS):
        hay = lowered if mode == "lower" else text
        maybe = None
        for n in needles:
            hit = F.instr(hay, n) > 0
            maybe = hit if maybe is None else (maybe | hit)
        out = F.when(maybe, F.regexp_replace(out, pattern, REDACTED)).otherwise(out)
    return out


def cap(r: Column, limit: int = MAX_SUMMARY_LENGTH) -> Column:
    """``r`` capped at ``limit`` characters, the last one an ellipsis."""
    return F.when(F.length(r) > limit, F.concat(F.substring(r, 1, limit - 1), F.lit("…"))
                  ).otherwise(r)


def summarise(text: Column, limit: int = MAX_SUMMARY_LENGTH) -> Column:
    """Redacted text capped at ``limit`` characters (the last one an ellipsis)."""
    return cap(redact(text), limit)


def error_summaries(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Redact whole texts; report the redacted text, how many secrets were
    replaced, and the capped summary the audit would store."""
    red = messages.select(F.col(id_col), redact(F.col(text_col)).alias("redacted"))
    r = F.col("redacted")
    return red.select(
        F.col(id_col), r,
        ((F.length(r) - F.length(F.replace(r, F.lit(REDACTED), F.lit(""))))
         / len(REDACTED)).cast("long").alias("redactions"),
        F.length(r).cast("long").alias("redacted_length"),
        cap(r).alias("summary"))


def event(spark: SparkSession, run_id: str, status: str, at: _dt.datetime, *,
          row_counts: dict[str, int] | None = None, lake_prefix: str | None = None,
          error: str | None = None) -> DataFrame:
    """One audit event as a one-row frame (append it to the audit table)."""
    if status not in RUN_STATUSES:
        raise ValueError(f"unknown run status {status!r}")
    df = spark.createDataFrame([(run_id, at, status, row_counts, lake_prefix, error)],
                               EVENT_SCHEMA)
    return df.withColumn("error_summary", F.when(F.col("error_summary").isNotNull(),
                                                 summarise(F.col("error_summary"))))


#: Of events at one instant the furthest status is the latest.
_PROGRESS_ORDER = ("queued", "running", "failed", "succeeded")


def _progress() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in _PROGRESS_ORDER]), F.col("status"))


def run_state(events: DataFrame) -> DataFrame:
    """Current row per run: latest status, first event as start, completion
    time for terminal states, duration in seconds (1 dp), counts ({} if none)."""
    per = events.groupBy("run_id").agg(
        F.max_by(F.struct("status", "row_counts", "lake_prefix", "error_summary", "event_ts"),
                 F.struct("event_ts", _progress().alias("progress"))).alias("last"),
        F.min(F.when(F.col("status") != "queued", F.col("event_ts"))).alias("started_at"),
        F.min("event_ts").alias("queued_at"))
    terminal = F.col("last.status").isin("succeeded", "failed")
    completed = F.when(terminal, F.col("last.event_ts"))
    start = F.coalesce(F.col("started_at"), F.col("queued_at"))
    micros = F.unix_micros(completed) - F.unix_micros(start)
    return per.select(
        "run_id", F.col("last.status").alias("status"), start.alias("started_at"),
        completed.alias("completed_at"),
        F.round((micros.cast("decimal(20,0)") / F.lit(1_000_000)), 1).cast("double")
        .alias("duration_seconds"),
        F.col("last.lake_prefix").alias("lake_prefix"),
        F.coalesce(F.col("last.row_counts"), F.create_map().cast("map<string,bigint>"))
        .alias("row_counts"),
        F.col("last.error_summary").alias("error_summary"))


def pipeline_status(events: DataFrame) -> DataFrame:
    """One row: the newest run and the newest succeeded run (either may be null)."""
    s = run_state(events)
    cols = ["run_id", "status", "started_at", "completed_at", "duration_seconds",
            "lake_prefix", "row_counts", "error_summary"]
    run = F.struct(*cols)
    return s.agg(
        F.max_by(run, "started_at").alias("current"),
        F.max_by(F.when(F.col("status") == "succeeded", run),
                 F.when(F.col("status") == "succeeded", F.col("completed_at"))).alias("last_successful"),
        F.count_if(F.col("status").isin(*ACTIVE_RUN_STATUSES)).alias("active_runs"))


def warehouse_status(status: DataFrame) -> DataFrame:
    """Classify the warehouse from the pipeline status row."""
    running = F.col("current.status").isin(*ACTIVE_RUN_STATUSES)
    failed = F.col("current.status") == "failed"
    built = F.col("last_successful.completed_at").isNotNull()
    state = (F.when(running, "running").when(failed, "last_run_failed")
             .when(built, "up_to_date").otherwise("not_built"))
    return status.select(state.alias("state"),
                         F.col("last_successful.completed_at").alias("published_at"))


def active_runs(events: DataFrame) -> DataFrame:
    return run_state(events).agg(
        F.count_if(F.col("status").isin(*ACTIVE_RUN_STATUSES)).cast("long").alias("active_runs"))


def append_events(events: DataFrame, path: str) -> None:
    """Append audit events (the log is append-only)."""
    events.write.mode("append").parquet(path)


def release_stale_runs(events: DataFrame, as_of: _dt.datetime,
                       older_than: _dt.timedelta) -> DataFrame:
    """Failed events for runs still active ('running', or 'queued' and never
    claimed) that started or were queued before ``as_of - older_than`` —
    abandoned runs must not hold the active slot."""
    cutoff = as_of - older_than
    stale = run_state(events).where(F.col("status").isin(*ACTIVE_RUN_STATUSES)
                                    & (F.col("started_at") < F.lit(cutoff)))
    return stale.select(
        "run_id", F.lit(as_of).cast("timestamp").alias("event_ts"),
        F.lit("failed").alias("status"),
        F.lit(None).cast("map<string,bigint>").alias("row_counts"),
        F.col("lake_prefix"),
        F.lit("released: the run stopped reporting progress").alias("error_summary"))
