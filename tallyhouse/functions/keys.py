"""Stable surrogate keys without funnelling every row through one task.

``row_number() over (order by k)`` is what the key means, but a window without
``partitionBy`` moves the whole table into a single partition. Here the rows
are range-partitioned on ``k`` and sorted inside each partition; the position
inside the partition comes from ``monotonically_increasing_id`` (its low 33
bits), the partition offsets from a per-partition count (one row per
partition, so the broadcast is bounded by the partition count). The ranked
rows — partition id and position included as columns — are first written as
a Parquet table in the shared scratch folder (``spark.checkpoint.dir``) and
read back: that cuts the lineage, so both passes see the same numbering even
if executors are lost in between, and unlike an RDD checkpoint the table is
columnar, compressed and carries size statistics for the planner.

Keys must be unique for the result to be the global row number; the quality
gate checks that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_root

#: A group of more rows is not numbered in one task.
HOT_GROUP = 10_000


def ranked_key(df: DataFrame, order_cols: list[str], key_name: str,
               num_partitions: int | None = None) -> DataFrame:
    """Add ``key_name`` = 1-based rank of each row by ``order_cols`` (bigint)."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/ranked/{key_name}-{uuid.uuid4().hex}"
    # Without an explicit count AQE sizes the range partitions to its advisory
    # size; coalesced range partitions stay contiguous, so the numbering holds.
    parted = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    ranked = (parted
              .sortWithinPartitions(*order_cols)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()
                          - F.col("_part").cast("long") * F.lit(1 << 33)))
    ranked.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    ranked = spark.read.parquet(path)
    offsets = (ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(
                   F.sum("_n").over(Window.orderBy("_part").rowsBetween(
                       Window.unboundedPreceding, -1)), F.lit(0)))
               .select("_part", "_offset"))
    keyed = ranked.join(F.broadcast(offsets), "_part")
    return keyed.select((F.col("_offset") + F.col("_pos") + 1).cast("long").alias(key_name),
                        *[F.col(c) for c in df.columns])


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder (in folders
    of column ``by``, if given) and read it back: a lineage cut whose later
    counts and broadcasts read footers instead of recomputing the plan."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/materialized/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def position_within(df: DataFrame, group_col: str, order_col: str, name: str) -> DataFrame:
    """Add ``name`` = 0-based position of each row inside its ``group_col``
    group, ordered by ``order_col`` (unique within the group).

    Groups of at most ``HOT_GROUP`` rows are numbered by a window: one shuffle,
    no written copy. A window would put a larger group whole into one task, so
    its rows take their global rank over (group, order) from
    :func:`ranked_key`, which range-partitions, and the position is the
    difference to the group's first rank. Rows without a group are left out.
    """
    large = F.col("_n") > HOT_GROUP
    hot = materialize(df.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"))
                      .where(large).select(group_col), "hot-groups")
    columns = [F.col(c) for c in df.columns]
    ordered = Window.partitionBy(group_col).orderBy(order_col)
    place = (F.row_number().over(ordered) - 1).cast("int").alias(name)
    if hot.isEmpty():
        return df.where(F.col(group_col).isNotNull()).select(*columns, place)
    # one row per HOT_GROUP rows of the table at most: a proven broadcast bound
    hot = F.broadcast(hot)
    small = df.where(F.col(group_col).isNotNull()).join(hot, group_col, "left_anti").select(*columns, place)
    ranked = ranked_key(df.join(hot, group_col, "left_semi"), [group_col, order_col], "_rank")
    starts = ranked.groupBy(group_col).agg(F.min("_rank").alias("_first"))
    return small.unionByName(ranked.join(F.broadcast(starts), group_col).select(
        *columns, (F.col("_rank") - F.col("_first")).cast("int").alias(name)))
