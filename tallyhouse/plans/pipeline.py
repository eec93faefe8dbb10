"""One warehouse run: extract → lake → star → gate → publish.

    raw = snapshot(...)                      # four operational DataFrames
    extract gate: nulls, orphans, types; any failure → nothing is written
    lake run   <root>/raw/run_date=…/run_id=…/<table>/ + manifest (written last)
    verify     re-hash every lake file against the manifest
    star       built from the lake tables as read back (never from the source)
    version    <root>/warehouse/version=<run_id>/<table>/
    gate       quality_report over the written tables; any failure → the version
               folder is removed and the previous version stays the newest
    publish    metadata table, then the next version of the commit log; a build that
               started before another one committed gets ``CommitConflict``

Every step is a Spark job over the whole tables; the driver only sees row
counts, check rows and file listings.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import EXCLUDED_ORDER_STATUSES, PIPELINE_VERSION, RAW_TABLES, SCHEMA_VERSION
from ..operators import quality
from ..operators.integrity import extract_gate
from ..operators.star import Star, build_star
from ..schemas import RAW, STAR, conform
from ..sources import lake
from ..sources.commit_log import CommitLog
from ..sources.warehouse import Warehouse, delete_tree, open_version, publish_version, table_path


class ExtractError(RuntimeError):
    """The snapshot holds nulls or orphans; ``failures`` maps each check to its rows."""

    def __init__(self, failures: dict[str, int]):
        self.failures = failures
        super().__init__("extract gate failed: " + "; ".join(f"{k}: {n} rows" for k, n in sorted(failures.items())))


class RunResult(NamedTuple):
    run_id: str
    lake_prefix: str
    version_dir: str
    published: bool
    source_counts: dict[str, int]
    warehouse_counts: dict[str, int]
    failures: list[tuple[str, str]]


def new_run_id() -> str:
    return str(uuid.uuid4())


def _write_observed(df: DataFrame, name: str, path: str, by: str | None = None) -> int:
    """Write a table and return its rows, counted by the tasks that write it.

    The count is the last step before the write, so it runs in the job's result
    stage, whose tasks count once each, whatever was repeated after a loss."""
    seen = Observation(name)
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return int(seen.get["rows"])


def write_star(star: Star, version_dir: str) -> dict[str, int]:
    """Write the four star tables; their row counts.

    The fact is range-partitioned on (date_key, order_item_id) — a hot day is
    split across tasks by the second column — sorted the same way, and laid
    out in ``sale_month`` folders, so a windowed read prunes folders and row
    groups and each task writes only the few months of its range."""
    counts = {name: _write_observed(getattr(star, name), name, table_path(version_dir, name))
              for name in ("dim_customer", "dim_product", "dim_date")}
    fact = (star.fact_sales
            .repartitionByRange("date_key", "order_item_id")
            .withColumn("sale_month", (F.col("date_key") / 100).cast("int"))
            .sortWithinPartitions("sale_month", "date_key", "order_item_id"))
    counts["fact_sales"] = _write_observed(fact, "fact_sales", table_path(version_dir, "fact_sales"), by="sale_month")
    return counts


def metadata_frame(spark: SparkSession, *, run_id: str, lake_prefix: str,
                   published_at: str) -> DataFrame:
    rows = [("run_id", run_id), ("lake_prefix", lake_prefix), ("published_at", published_at),
            ("schema_version", SCHEMA_VERSION), ("pipeline_version", PIPELINE_VERSION),
            ("excluded_order_statuses", ",".join(EXCLUDED_ORDER_STATUSES))]
    return spark.createDataFrame(rows, STAR["warehouse_metadata"])


def build_and_publish(spark: SparkSession, raw: dict[str, DataFrame], root: str,
                      run_id: str | None = None, published_at: str | None = None,
                      run_date: str | None = None) -> RunResult:
    run_id = run_id or new_run_id()
    published_at = published_at or _dt.datetime.now(_dt.timezone.utc).isoformat(timespec="seconds")
    run_date = run_date or published_at[:10]
    root = root.rstrip("/")
    base = CommitLog(spark, f"{root}/warehouse").latest()

    # Extract gate: nothing is written when the snapshot itself is broken.
    raw = {t: conform(raw[t], RAW[t]) for t in RAW_TABLES}
    broken = {r["check"]: r["affected"] for r in extract_gate(raw).where("affected > 0").collect()}
    if broken:
        raise ExtractError(broken)

    # Lake: write, manifest, verify, read back.
    lake_run = lake.upload_run(spark, raw, f"{root}/raw", run_date, run_id)
    lake.verify_run(spark, lake_run.prefix)
    staged = lake.read_run(spark, lake_run.prefix)

    # Star into a fresh version folder.
    version_dir = f"{root}/warehouse/version={run_id}"
    counts = write_star(build_star(staged), version_dir)
    wh = open_version(spark, version_dir)

    report = quality.quality_report(wh.dim_customer, wh.dim_product, wh.dim_date,
                                    wh.fact_sales, staged["orders"], staged["order_items"],
                                    rows=counts["fact_sales"])
    failures = quality.failures(report)
    if failures:
        delete_tree(spark, version_dir)  # a rejected build is no version
        return RunResult(run_id, lake_run.prefix, version_dir, False, lake_run.row_counts,
                         counts, failures)

    metadata_frame(spark, run_id=run_id, lake_prefix=lake_run.prefix,
                   published_at=published_at).coalesce(1).write.mode("errorifexists").parquet(
        table_path(version_dir, "warehouse_metadata"))
    publish_version(spark, f"{root}/warehouse", f"version={run_id}", base, run_id=run_id,
                    published_at=published_at, counts=counts)
    return RunResult(run_id, lake_run.prefix, version_dir, True, lake_run.row_counts, counts, [])


def published(spark: SparkSession, root: str, version: int | None = None) -> Warehouse | None:
    from ..sources.warehouse import open_warehouse
    return open_warehouse(spark, f"{root.rstrip('/')}/warehouse", version)


def run_with_audit(spark: SparkSession, raw: dict[str, DataFrame], root: str, audit_dir: str,
                   run_id: str | None = None) -> RunResult:
    """``build_and_publish`` recorded in the append-only run audit.

    Only one run is active at a time: the run claims the slot of ``audit_dir``
    first, and raises ``ConcurrentRun`` when another run holds it. A ``running``
    event is appended next. Then comes ``succeeded`` with the
    source row counts and the lake prefix, or ``failed`` with the error (gate
    failures or the exception), redacted and capped as the audit stores it.
    A failed run leaves the previous warehouse published; the run state is
    the latest event per run (``operators.audit.run_state``).
    """
    from ..operators import audit
    from ..sources import run_slot

    def now() -> _dt.datetime:
        return _dt.datetime.now(_dt.timezone.utc)

    run_id = run_id or new_run_id()
    run_slot.claim(spark, audit_dir, run_id)
    try:
        audit.append_events(audit.event(spark, run_id, "running", now()), audit_dir)
        return _audited(spark, raw, root, audit_dir, run_id, now)
    finally:
        run_slot.release(spark, audit_dir, run_id)


def _audited(spark: SparkSession, raw: dict[str, DataFrame], root: str, audit_dir: str, run_id: str, now) -> RunResult:
    from ..operators import audit
    try:
        result = build_and_publish(spark, raw, root, run_id=run_id)
    except Exception as e:
        audit.append_events(audit.event(spark, run_id, "failed", now(),
                                        error=f"{type(e).__name__}: {e}"), audit_dir)
        raise
    if result.published:
        audit.append_events(audit.event(spark, run_id, "succeeded", now(),
                                        row_counts=result.source_counts,
                                        lake_prefix=result.lake_prefix), audit_dir)
    else:
        detail = "; ".join(f"{name}: {why}" for name, why in result.failures)
        audit.append_events(audit.event(spark, run_id, "failed", now(),
                                        lake_prefix=result.lake_prefix,
                                        error=f"quality gate failed: {detail}"), audit_dir)
    return result
