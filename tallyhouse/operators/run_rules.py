"""What must hold of the run rows, and the moments with more than one active run.

Five rules are predicates of one row and share one scan. The sixth, at most one
active run at a time, is an interval sweep: a run is active from its start to
its completion (to the end of time while it has none). Starts count +1, ends -1,
summed per instant; the running total over the instants says how many runs are
active from each instant on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ACTIVE_RUN_STATUSES, RUN_STATUSES
from ..functions.sweep import running_total

SINGLE_ACTIVE = "single_active_run"


def active_counts(runs: DataFrame) -> DataFrame:
    """(moment, active_runs): the runs active from each instant at which a run
    starts or ends. Rows that end before they start are left to their own rule."""
    whole = runs.where("started_at is not null").where("completed_at is null or completed_at >= started_at")
    ends = F.array_compact(F.array(F.struct(F.col("started_at").alias("moment"), F.lit(1).alias("change")),
                                   F.when(F.col("completed_at").isNotNull(), F.struct(F.col("completed_at").alias("moment"), F.lit(-1).alias("change")))))
    per_moment = whole.select(F.explode(ends).alias("e")).groupBy("e.moment").agg(F.sum("e.change").alias("change"))
    return running_total(per_moment, "moment", "change", "active_runs").select("moment", "active_runs")


def concurrent_moments(runs: DataFrame) -> DataFrame:
    """The instants from which more than one run is active."""
    return active_counts(runs).where("active_runs > 1")


def _rules(runs: DataFrame) -> list:
    active = F.col("status").isin(*ACTIVE_RUN_STATUSES)
    if isinstance(runs.schema["row_counts"].dataType, T.StringType):
        counts_bad = F.col("row_counts").isNull() | F.from_json("row_counts", "map<string,string>").isNull()
    else:
        counts_bad = F.col("row_counts").isNull()
    return [
        ("status_known", F.col("status").isNull() | ~F.col("status").isin(*RUN_STATUSES)),
        ("completion_consistent", active != F.col("completed_at").isNull()),
        ("not_backwards", F.col("completed_at") < F.col("started_at")),
        ("error_only_on_failure", F.col("error_summary").isNotNull() & ~F.col("status").eqNullSafe(F.lit("failed"))),
        ("row_counts_is_object", counts_bad)]


def run_constraint_violations(runs: DataFrame) -> DataFrame:
    """(constraint, affected) of the six rules: rows for the first five, moments
    for ``single_active_run``."""
    rules = _rules(runs)
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("constraint"), F.col(name).alias("affected")) for name, _ in rules]))
    per_row = runs.agg(*[F.count_if(bad).cast("long").alias(name) for name, bad in rules]).select(rows.alias("r")).select("r.*")
    moments = concurrent_moments(runs).agg(F.count(F.lit(1)).cast("long").alias("affected"))
    return per_row.unionByName(moments.select(F.lit(SINGLE_ACTIVE).alias("constraint"), "affected"))
