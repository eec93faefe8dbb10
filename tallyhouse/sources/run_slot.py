"""At most one active run: a slot that a run claims and releases.

The slot is a commit log beside the run audit. A claim is the commit of an
entry that names the run, possible only on top of a released slot; of two
claims made at one moment one conflicts. A run that died keeps the slot until
its claim is older than ``stale_after``; then the next claim takes it over.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import SparkSession

from .commit_log import CommitConflict, CommitLog

MESSAGE = "a run is already queued or running"


class ConcurrentRun(RuntimeError):
    pass


def holder(spark: SparkSession, audit_dir: str) -> str | None:
    """The run that holds the slot."""
    log = CommitLog(spark, audit_dir)
    entry = log.entry(log.latest()) or {}
    return entry.get("run_id") if entry.get("active") else None


def claim(spark: SparkSession, audit_dir: str, run_id: str, stale_after: _dt.timedelta | None = None) -> None:
    log = CommitLog(spark, audit_dir)
    base = log.latest()
    entry = log.entry(base) or {}
    if entry.get("active"):
        since = _dt.datetime.fromisoformat(entry["committed_at"])
        if stale_after is None or _dt.datetime.now(_dt.timezone.utc) - since < stale_after:
            raise ConcurrentRun(f"{MESSAGE}: {entry['run_id']}")
    try:
        log.commit({"run_id": run_id, "active": True}, base)
    except CommitConflict as e:
        raise ConcurrentRun(MESSAGE) from e


def release(spark: SparkSession, audit_dir: str, run_id: str) -> bool:
    """Free the slot if ``run_id`` holds it; False when another run took it over."""
    def attempt(base: int, entry: dict | None) -> dict | None:
        if not entry or not entry.get("active") or entry.get("run_id") != run_id:
            return None
        return {"run_id": run_id, "active": False}
    return CommitLog(spark, audit_dir).retrying(attempt) is not None
