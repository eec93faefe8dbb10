"""Running totals over a global order without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import materialize


def running_total(df: DataFrame, order_col: str, value_col: str, name: str) -> DataFrame:
    """Add ``name`` = sum of ``value_col`` over all rows up to this one.

    ``order_col`` must be unique (aggregate to one row per place first). The
    rows are range-partitioned, so a partition holds one stretch of the order;
    each is summed on its own, and the totals of the partitions before it, a
    table of one row per partition, are added. The dealt rows are written once,
    so a lost executor cannot deal them differently between the two passes.
    """
    dealt = materialize(df.repartitionByRange(order_col).withColumn("_part", F.spark_partition_id()), f"sweep-{name}")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("_part").agg(F.sum(value_col).alias("_sum"))
               .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    inside = F.sum(value_col).over(Window.partitionBy("_part").orderBy(order_col))
    summed = dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
    return summed.select(*[F.col(c) for c in df.columns], (F.col("_before") + F.col("_inside")).cast("long").alias(name))
