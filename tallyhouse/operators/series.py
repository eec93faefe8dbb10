"""Series reshaping over the daily sales series and period comparison.

The daily series has one row per day of dim_date in the window, so every
frame here is bounded by the number of calendar days (a few thousand rows per
decade) regardless of the fact size; the facts are only touched through the
aggregates of :mod:`tallyhouse.operators.analytics`.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FLAT_DELTA_BAND, SPARKLINE_POINTS
from ..functions.dates import iso_text, month_start, week_start
from ..functions.money import avg_money, cents, count_out, money
from ..sources.warehouse import Warehouse
from . import analytics as A


def bucket_series(daily: DataFrame, granularity: str) -> DataFrame:
    """Re-bucket the typed daily series into ISO weeks (Monday) or months.

    Revenue and units add up; order counts add up too, which is exact because
    an order has exactly one date (distinct customers would not add up, so they
    are not offered here). ``end_date`` is the last day present in the bucket.
    """
    if granularity == "weekly":
        key = iso_text(week_start(F.col("full_date")))
    elif granularity == "monthly":
        key = F.date_format(month_start(F.col("full_date")), "yyyy-MM")
    elif granularity == "daily":
        key = iso_text(F.col("full_date"))
    else:
        raise ValueError(f"unknown granularity {granularity!r}")
    return (daily.groupBy(key.alias("date"))
            .agg(F.sum("revenue").alias("rev"), F.sum("order_count").alias("orders"),
                 F.sum("units_sold").alias("units"), F.max("full_date").alias("end"))
            .orderBy("date")
            .select("date", iso_text(F.col("end")).alias("end_date"),
                    money(F.col("rev")).alias("revenue"),
                    count_out(F.col("orders")).alias("order_count"),
                    count_out(F.col("units")).alias("units_sold")))


def sales_weekly(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    return bucket_series(A.daily_series(wh, from_, to), "weekly")


def sales_monthly(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    return bucket_series(A.daily_series(wh, from_, to), "monthly")


def downsample(values: DataFrame, order_col: str, value_col: str,
               target: int = SPARKLINE_POINTS) -> DataFrame:
    """Mean of ``target`` equal-width buckets over an ordered series of n points.

    Point i (0-based) falls in bucket floor(((i+1)·target − 1) / n), which is
    the bucket whose [floor(b·n/t), floor((b+1)·n/t)) range holds i. When
    n ≤ target the series is returned as is (bucket = i). The mean is
    sum / count over exact decimal cents. The input is a day series — bounded
    by the calendar — so the position window runs on one small partition.
    """
    w = Window.orderBy(order_col)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    pos = values.select(F.col(value_col).alias("v"),
                        (F.row_number().over(w) - 1).alias("i"), n.alias("n"))
    bucket = F.when(F.col("n") <= target, F.col("i")).otherwise(
        F.floor(((F.col("i") + 1) * target - 1) / F.col("n")))
    return (pos.groupBy(bucket.cast("int").alias("bucket"))
            .agg(F.sum(cents(F.col("v"))).alias("s"), F.count(F.lit(1)).alias("c"))
            .select("bucket", (F.col("s").cast("double") / F.col("c").cast("double") / 100)
                    .alias("value"))
            .orderBy("bucket"))


def sparkline(wh: Warehouse, from_: str | None = None, to: str | None = None,
              target: int = SPARKLINE_POINTS) -> DataFrame:
    """Daily revenue thinned to ``target`` points for the KPI sparkline."""
    return downsample(A.daily_series(wh, from_, to), "full_date", "revenue", target)


def preset_windows(days: int, today: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """Last ``days`` days ending ``today`` (inclusive) and the equal window before it."""
    t = _dt.date.fromisoformat(today)
    cur_from = t - _dt.timedelta(days=days - 1)
    prev_to = cur_from - _dt.timedelta(days=1)
    prev_from = prev_to - _dt.timedelta(days=days - 1)
    return (cur_from.isoformat(), today), (prev_from.isoformat(), prev_to.isoformat())


def delta_ratio(cur, prev) -> F.Column:
    """(cur − prev) / prev as double; null on a zero baseline."""
    c, p = cur.cast("double"), prev.cast("double")
    return F.when(p != 0, (c - p) / p)


def direction(ratio) -> F.Column:
    return (F.when(ratio > FLAT_DELTA_BAND, "up").when(ratio < -FLAT_DELTA_BAND, "down")
            .when(ratio.isNotNull(), "flat"))


def kpi_delta(wh: Warehouse, days: int, today: str) -> DataFrame:
    """KPIs of the last ``days`` days against the equal-length window before.

    One scan of the fact over both windows; facts are reduced per (period,
    customer) with one distinct order count, then one row per period, then one
    row per metric: metric, current, previous, delta, direction.
    """
    (cur_from, cur_to), (prev_from, prev_to) = preset_windows(days, today)
    cur_lo = int(cur_from.replace("-", ""))
    period = F.when(F.col("date_key") >= cur_lo, "current").otherwise("previous")
    f = A.facts(wh, prev_from, cur_to).withColumn("period", period)
    pc = f.groupBy("period", "customer_key").agg(
        F.sum("revenue").alias("rev"), F.count_distinct("order_id").alias("orders"),
        F.sum("quantity").alias("units"))

    def pick(p: str, c: str, zero=F.lit(0)):
        return F.coalesce(F.sum(F.when(F.col("period") == p, F.col(c))), zero)

    def pick_count(p: str):
        return F.count_if(F.col("period") == p)

    t = pc.agg(
        pick("current", "rev").alias("rev_c"), pick("previous", "rev").alias("rev_p"),
        pick("current", "orders").alias("ord_c"), pick("previous", "orders").alias("ord_p"),
        pick_count("current").alias("cus_c"), pick_count("previous").alias("cus_p"),
        pick("current", "units").alias("uni_c"), pick("previous", "units").alias("uni_p"))
    t = t.select(
        money(F.col("rev_c")).alias("revenue_c"), money(F.col("rev_p")).alias("revenue_p"),
        F.col("ord_c").cast("double").alias("orders_c"),
        F.col("ord_p").cast("double").alias("orders_p"),
        F.col("cus_c").cast("double").alias("customers_c"),
        F.col("cus_p").cast("double").alias("customers_p"),
        F.col("uni_c").cast("double").alias("units_c"),
        F.col("uni_p").cast("double").alias("units_p"),
        avg_money(F.col("rev_c"), F.col("ord_c")).alias("aov_c"),
        avg_money(F.col("rev_p"), F.col("ord_p")).alias("aov_p"))
    metrics = [("revenue", "revenue"), ("orders", "orders"), ("customers", "customers"),
               ("units", "units"), ("average_order_value", "aov")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(f"{c}_c").alias("current"),
                 F.col(f"{c}_p").alias("previous")) for name, c in metrics]))
    out = t.select(rows.alias("m")).select("m.*")
    ratio = delta_ratio(F.col("current"), F.col("previous"))
    return out.select("metric", "current", "previous", ratio.alias("delta"),
                      direction(ratio).alias("direction"),
                      F.lit(cur_from).alias("current_from"), F.lit(cur_to).alias("current_to"),
                      F.lit(prev_from).alias("previous_from"), F.lit(prev_to).alias("previous_to"))


def series_table(series: DataFrame, order_col: str = "date", rows: int = 60) -> DataFrame:
    """The first ``rows`` points of a series, for a tabular view of a chart."""
    return series.orderBy(order_col).limit(rows)
