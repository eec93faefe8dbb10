"""Replacing the operational tables with a validated dataset.

The reference replaces its four seed tables inside one transaction. Here a
dataset is written as a new immutable version folder and becomes current with
the same commit log the warehouse uses, so readers see either the old or the
new tables, never a mix, and of two concurrent loads one gets a conflict. It refuses to run in production unless explicitly
allowed, refuses a dataset that fails validation, and never touches the run
audit (which lives elsewhere).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import RAW_TABLES
from ..schemas import RAW
from .commit_log import CommitLog
from .warehouse import publish_version


class LoadRefused(RuntimeError):
    pass


def publish_dataset(spark: SparkSession, tables: dict[str, DataFrame], root: str, *,
                    environment: str = "development", allow_destructive: bool = False,
                    validation: DataFrame | None = None) -> str:
    """Write ``tables`` as a new version and make it current; returns the version."""
    if environment == "production" and not allow_destructive:
        raise LoadRefused("refusing to replace operational tables in production")
    if validation is not None:
        bad = [r["rule"] for r in validation.where("affected > 0").select("rule").collect()]
        if bad:
            raise LoadRefused(f"dataset fails validation: {bad}")
    base = CommitLog(spark, root).latest()
    version = f"version={uuid.uuid4()}"
    for t in RAW_TABLES:
        tables[t].select(*[f.name for f in RAW[t].fields]).write.mode("errorifexists") \
            .parquet(f"{root}/{version}/{t}")
    publish_version(spark, root, version, base)
    return version


def current_tables(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    log = CommitLog(spark, root)
    entry = log.entry(log.latest())
    if not entry or not entry.get("folder"):
        return None
    return {t: spark.read.schema(RAW[t]).parquet(f"{root}/{entry['folder']}/{t}") for t in RAW_TABLES}
