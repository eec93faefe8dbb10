"""Exact distinct counts that roll up: one stored set of customers per day,
for the whole business, every category and every city.

Distinct orders add up over days (an order has one date), distinct customers do
not. Customer keys are dense, so a set of them is a bitmap, cut into containers
of 32,768 keys: a container of few customers is stored as its sorted positions,
one of many as its bits (4 KB). Any window or period is then the union of its
days' containers and a count of bits; the facts are not read again.

``totals`` (dim, value, value2, date_key, revenue, orders, units) and
``customers`` (dim, value, value2, date_key, bucket, few, bits) lie in the
folder of the warehouse version they were made from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_text, month_start, week_start
from ..functions.money import count_out, money
from ..sources.commit_log import create_if_absent
from ..sources.warehouse import Warehouse, delete_tree, read_text
from .analytics import window_predicate

#: Positions up to this number take less room than the bits of a container.
FEW = 2048
DIMS = ("all", "category", "city")


def _daily(wh: Warehouse) -> DataFrame:
    """One row per dimension value, day and order with its customer: revenue, units.
    An order has one customer and one date, so orders are counted as rows, and
    one aggregation does."""
    sums = [F.sum("revenue").alias("revenue"), F.sum("quantity").alias("units")]
    f = wh.fact_sales
    per_order = f.groupBy("date_key", "customer_key", "order_id").agg(*sums)
    towns = wh.dim_customer.select("customer_key", "city", "state")
    dims = F.array(F.struct(F.lit("all").alias("dim"), F.lit("").alias("value"), F.lit("").alias("value2")),
                   F.struct(F.lit("city").alias("dim"), F.col("city").alias("value"), F.col("state").alias("value2")))
    by_town = (per_order.join(towns, "customer_key").withColumn("d", F.explode(dims))
               .select("d.dim", "d.value", "d.value2", "date_key", "customer_key", "revenue", "units"))
    kinds = wh.dim_product.select("product_key", F.col("category").alias("value"))
    by_kind = (f.join(kinds, "product_key").groupBy("value", "date_key", "customer_key", "order_id").agg(*sums)
               .select(F.lit("category").alias("dim"), "value", F.lit("").alias("value2"), "date_key", "customer_key", "revenue", "units"))
    return by_town.unionByName(by_kind)


def _containers(daily: DataFrame) -> DataFrame:
    """Each set dealt to one task by its container, at most 32,768 positions, before it is built."""
    keys = ["dim", "value", "value2", "date_key", "bucket"]
    places = daily.select("dim", "value", "value2", "date_key", F.bitmap_bucket_number("customer_key").alias("bucket"),
                          F.bitmap_bit_position("customer_key").alias("bit"))
    built = places.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_set("bit")).alias("few"), F.bitmap_construct_agg("bit").alias("bits"))
    small = F.size("few") <= FEW
    return built.select(*keys, F.when(small, F.col("few")).alias("few"), F.when(~small, F.col("bits")).alias("bits"))


def build(wh: Warehouse) -> str:
    """Write both tables into the version's folder, once; returns their folder."""
    marker = f"{wh.path.rstrip('/')}/rollup.json"
    done = read_text(wh.spark, marker)
    if done:
        return f"{wh.path.rstrip('/')}/{done}"
    name = f"rollup-{uuid.uuid4().hex}"
    folder = f"{wh.path.rstrip('/')}/{name}"
    daily = _daily(wh)
    daily.write.option("compression", "zstd").parquet(f"{folder}/daily")
    daily = wh.spark.read.schema(daily.schema).parquet(f"{folder}/daily")
    (daily.groupBy("dim", "value", "value2", "date_key").agg(F.sum("revenue").cast("decimal(24,2)").alias("revenue"), F.count(F.lit(1)).alias("orders"), F.sum("units").alias("units"))
     .repartitionByRange("dim", "date_key").sortWithinPartitions("dim", "date_key").write.partitionBy("dim").parquet(f"{folder}/totals"))
    (_containers(daily).repartitionByRange("dim", "date_key", "value").sortWithinPartitions("dim", "date_key")
     .write.partitionBy("dim").parquet(f"{folder}/customers"))
    delete_tree(wh.spark, f"{folder}/daily")
    if not create_if_absent(wh.spark, marker, name):  # another session was first
        delete_tree(wh.spark, folder)
        return f"{wh.path.rstrip('/')}/{read_text(wh.spark, marker)}"
    return folder


def _read(wh: Warehouse, table: str, dim: str, from_: str | None, to: str | None) -> DataFrame:
    if dim not in DIMS:
        raise ValueError(f"unknown dimension {dim!r}")
    return (wh.spark.read.parquet(f"{build(wh)}/{table}").where(F.col("dim") == dim)
            .where(window_predicate(from_, to, month=None)))


def _period(granularity: str):
    day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    periods = {"weekly": iso_text(week_start(day)), "monthly": F.date_format(month_start(day), "yyyy-MM"), "daily": iso_text(day), "whole": F.lit("whole")}
    if granularity not in periods:
        raise ValueError(f"unknown granularity {granularity!r}")
    return periods[granularity]


def rolled(wh: Warehouse, dim: str = "all", granularity: str = "whole", from_: str | None = None, to: str | None = None) -> DataFrame:
    """value, value2, date (of the period), revenue, order_count, customer_count,
    units_sold per dimension value and period, from the stored tables alone."""
    group = ["value", "value2", "date"]
    totals = (_read(wh, "totals", dim, from_, to).withColumn("date", _period(granularity)).groupBy(*group)
              .agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"), F.sum("units").alias("units")))
    sets = _read(wh, "customers", dim, from_, to).withColumn("date", _period(granularity))
    few = (sets.where("few is not null").select(*group, "bucket", F.explode("few").alias("bit")).distinct()
           .groupBy(*group, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    many = sets.where("bits is not null").select(*group, "bucket", "bits")
    counts = (few.unionByName(many).groupBy(*group, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
              .groupBy(*group).agg(F.sum(F.bitmap_count("bits")).alias("customers")))
    return totals.join(counts, group).select(*group, money(F.col("revenue")).alias("revenue"), count_out(F.col("orders")).alias("order_count"),
                                             count_out(F.col("customers")).alias("customer_count"), count_out(F.col("units")).alias("units_sold"))
