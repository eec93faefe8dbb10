"""Reporting statements over the published star schema.

Every statement takes an optional inclusive date window (either side open).
The window is applied to the fact through ``date_key`` (yyyymmdd, monotone in
the date) and the ``sale_month`` partition column, so it reaches the Parquet
scan as a partition filter plus row-group statistics; no join to dim_date is
needed for filtering because the quality gate guarantees every fact date_key
exists in dim_date (check ``fact_joins_date``).

Exact distinct counts are planned without ``Expand``: an order has exactly one
customer and one date, so facts are first reduced per customer (or per date)
with a single distinct count of orders, and the outer aggregate only sums.
Money stays decimal until the edge.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TOP_N_DEFAULT, TOP_N_MAX
from ..functions.dates import iso_text
from ..functions.joins import one_row
from ..functions.money import avg_money, count_out, money
from ..sources.warehouse import Warehouse


def _key(day: str | None) -> int | None:
    if day is None:
        return None
    return int(_dt.date.fromisoformat(day).strftime("%Y%m%d"))


def check_window(from_: str | None, to: str | None) -> None:
    """Parameter rules: real calendar dates, from ≤ to."""
    for v in (from_, to):
        if v is not None:
            _dt.date.fromisoformat(v)  # raises on 2026-02-30 / bad shape
            if len(v) != 10:
                raise ValueError(f"not a yyyy-MM-dd date: {v!r}")
    if from_ and to and from_ > to:
        raise ValueError("from must not be after to")


def check_top_n(top_n: int) -> int:
    if not isinstance(top_n, int) or not 1 <= top_n <= TOP_N_MAX:
        raise ValueError(f"topN must be an integer in 1..{TOP_N_MAX}")
    return top_n


def window_predicate(from_: str | None, to: str | None, key: str = "date_key",
                     month: str | None = "sale_month"):
    check_window(from_, to)
    cond = F.lit(True)
    lo, hi = _key(from_), _key(to)
    if lo is not None:
        cond = cond & (F.col(key) >= lo)
        if month:
            cond = cond & (F.col(month) >= lo // 100)
    if hi is not None:
        cond = cond & (F.col(key) <= hi)
        if month:
            cond = cond & (F.col(month) <= hi // 100)
    return cond


def facts(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    return wh.fact_sales.where(window_predicate(from_, to))


def dates(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    return wh.dim_date.where(window_predicate(from_, to, month=None))


def _key_to_text(c) -> F.Column:
    return iso_text(F.to_date(c.cast("string"), "yyyyMMdd"))


def range_meta(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Covered window: extent of the facts in range; each empty side echoes the request."""
    f = facts(wh, from_, to)
    return f.agg(F.min("date_key").alias("lo"), F.max("date_key").alias("hi")).select(
        F.coalesce(_key_to_text(F.col("lo")), F.lit(from_).cast("string")).alias("range_from"),
        F.coalesce(_key_to_text(F.col("hi")), F.lit(to).cast("string")).alias("range_to"))


def per_customer(f: DataFrame) -> DataFrame:
    """Facts reduced to one row per customer: revenue, distinct orders, units."""
    return f.groupBy("customer_key").agg(
        F.sum("revenue").alias("revenue"),
        F.count_distinct("order_id").alias("orders"),
        F.sum("quantity").alias("units"))


def revenue_summary(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """KPIs: revenue, distinct orders, distinct customers, units, average order value.

    A global aggregate returns one row even for an empty window (zeros).
    """
    pc = facts(wh, from_, to).groupBy("customer_key").agg(
        F.sum("revenue").alias("revenue"), F.count_distinct("order_id").alias("orders"),
        F.sum("quantity").alias("units"), F.min("date_key").alias("lo"),
        F.max("date_key").alias("hi"))
    totals = pc.agg(F.sum("revenue").alias("rev"), F.sum("orders").alias("orders"),
                    F.count(F.lit(1)).alias("customers"), F.sum("units").alias("units"),
                    F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # one scan: the covered range rides along in the same aggregate
    return totals.select(
        money(F.col("rev")).alias("total_revenue"),
        count_out(F.col("orders")).alias("order_count"),
        count_out(F.col("customers")).alias("customer_count"),
        count_out(F.col("units")).alias("units_sold"),
        avg_money(F.coalesce(F.col("rev"), F.lit(0)),
                  F.coalesce(F.col("orders"), F.lit(0))).alias("average_order_value"),
        F.coalesce(_key_to_text(F.col("lo")), F.lit(from_).cast("string")).alias("range_from"),
        F.coalesce(_key_to_text(F.col("hi")), F.lit(to).cast("string")).alias("range_to"))


def sales_by_category(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Revenue, units and distinct orders per product category, revenue desc."""
    f = facts(wh, from_, to).join(wh.dim_product.select("product_key", "category"), "product_key")
    agg = f.groupBy("category").agg(
        F.sum("revenue").alias("rev"), F.sum("quantity").alias("units"),
        F.count_distinct("order_id").alias("orders"))
    return agg.orderBy(F.col("rev").desc(), F.col("category")).select(
        "category", money(F.col("rev")).alias("revenue"),
        count_out(F.col("units")).alias("units_sold"),
        count_out(F.col("orders")).alias("order_count"))


def product_totals(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Revenue and units per product key (aggregated before any attribute join)."""
    return facts(wh, from_, to).groupBy("product_key").agg(
        F.sum("revenue").alias("rev"), F.sum("quantity").alias("units"))


def top_products(wh: Warehouse, from_: str | None = None, to: str | None = None,
                 top_n: int = TOP_N_DEFAULT) -> DataFrame:
    """The ``top_n`` products by revenue (ties: product_id ascending).

    Aggregated by product key first (one row per product), then the top-k is a
    ``TakeOrderedAndProject`` (per-partition heaps of k rows), and only the k
    winners meet the product attributes.
    """
    check_top_n(top_n)
    # product_key is the rank of product_id, so it breaks ties the same way
    best = product_totals(wh, from_, to).orderBy(F.col("rev").desc(), "product_key").limit(top_n)
    attrs = wh.dim_product.select("product_key", "product_id", "sku", "name", "category")
    # best holds at most TOP_N_MAX rows: a proven broadcast bound
    return attrs.join(F.broadcast(best), "product_key").orderBy(
        F.col("rev").desc(), F.col("product_id")).select(
        "product_id", "sku", "name", "category", money(F.col("rev")).alias("revenue"),
        count_out(F.col("units")).alias("units_sold"))


def top_products_ranked(wh: Warehouse, from_: str | None = None, to: str | None = None,
                        top_n: int = TOP_N_DEFAULT) -> DataFrame:
    """Top products with their 1-based position (over the k rows only)."""
    from pyspark.sql import Window
    top = top_products(wh, from_, to, top_n)
    w = Window.orderBy(F.col("revenue").desc(), F.col("product_id"))
    return top.withColumn("rank", F.row_number().over(w).cast("long"))


def sales_by_city(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Revenue, distinct orders and distinct customers per city and state."""
    pc = per_customer(facts(wh, from_, to)).join(
        wh.dim_customer.select("customer_key", "city", "state"), "customer_key")
    agg = pc.groupBy("city", "state").agg(
        F.sum("revenue").alias("rev"), F.sum("orders").alias("orders"),
        F.count(F.lit(1)).alias("customers"))
    return agg.orderBy(F.col("rev").desc(), "city", "state").select(
        "city", "state", money(F.col("rev")).alias("revenue"),
        count_out(F.col("orders")).alias("order_count"),
        count_out(F.col("customers")).alias("customer_count"))


def city_share_of_leader(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Each city's revenue as a whole percentage of the leading city's (0 if the leader has 0)."""
    cities = sales_by_city(wh, from_, to)
    leader = one_row(cities.agg(F.max("revenue").alias("leader")))["leader"]
    return cities.select(
        "city", "state", "revenue",
        F.when(leader > 0, F.round(F.col("revenue") / leader * 100, 0))
        .otherwise(F.lit(0.0)).cast("long").alias("share_of_leader"))


def daily_totals(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Per sold day: revenue, distinct orders, units (an order has one date)."""
    return facts(wh, from_, to).groupBy("date_key").agg(
        F.sum("revenue").alias("rev"), F.count_distinct("order_id").alias("orders"),
        F.sum("quantity").alias("units"))


def daily_series(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Typed daily series: full_date, revenue (decimal), order_count, units_sold.

    Driven from dim_date with a left join so quiet days are zero rows, never
    missing; a window wider than dim_date is not padded. dim_date is bounded
    by the day span, so the join side is small.
    """
    d = dates(wh, from_, to).select("date_key", "full_date")
    return d.join(daily_totals(wh, from_, to), "date_key", "left").select(
        "full_date",
        F.coalesce(F.col("rev"), F.lit(0).cast("decimal(24,2)")).alias("revenue"),
        F.coalesce(F.col("orders"), F.lit(0)).cast("long").alias("order_count"),
        F.coalesce(F.col("units"), F.lit(0)).cast("long").alias("units_sold"))


def daily_sales(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    s = daily_series(wh, from_, to)
    return s.orderBy("full_date").select(
        iso_text(F.col("full_date")).alias("date"), money(F.col("revenue")).alias("revenue"),
        "order_count", "units_sold")


def daily_aov(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Average order value per day, 0 on days without orders."""
    s = daily_series(wh, from_, to)
    return s.orderBy("full_date").select(
        iso_text(F.col("full_date")).alias("date"),
        avg_money(F.col("revenue"), F.col("order_count")).alias("average_order_value"))


def revenue_flag(wh: Warehouse, from_: str | None = None, to: str | None = None) -> DataFrame:
    """One row: whether any fact in the window earned revenue (false when empty)."""
    return facts(wh, from_, to).agg(
        F.coalesce(F.bool_or(F.col("revenue") > 0), F.lit(False)).alias("has_revenue"))


def warehouse_meta(spark, root: str, from_: str | None = None, to: str | None = None) -> DataFrame:
    """One row: warehouse_ready, generated_at (published_at), range_from, range_to.

    Not ready (no pointer, empty or dangling pointer, missing tables) echoes
    the requested window and never touches the operational tables.
    """
    from ..sources.warehouse import open_warehouse
    check_window(from_, to)
    wh = open_warehouse(spark, root)
    if wh is None:
        return spark.createDataFrame(
            [(False, None, from_, to)],
            "warehouse_ready boolean, generated_at string, range_from string, range_to string")
    return range_meta(wh, from_, to).select(
        F.lit(True).alias("warehouse_ready"), F.lit(wh.published_at()).cast("string")
        .alias("generated_at"), "range_from", "range_to")


_EMPTY = {
    "categories": "category string, revenue double, units_sold bigint, order_count bigint",
    "top_products": "product_id string, sku string, name string, category string, "
                    "revenue double, units_sold bigint",
    "cities": "city string, state string, revenue double, order_count bigint, "
              "customer_count bigint",
    "daily": "date string, revenue double, order_count bigint, units_sold bigint",
}


def report(spark, root: str, kind: str, from_: str | None = None, to: str | None = None,
           top_n: int = TOP_N_DEFAULT) -> DataFrame:
    """A report by name against the published warehouse under ``root``.

    ``summary`` is one row of zeros when the warehouse is not ready; the list
    reports are empty frames with their usual schema.
    """
    from ..sources.warehouse import open_warehouse
    check_window(from_, to)
    wh = open_warehouse(spark, root)
    builders = {"summary": lambda w: revenue_summary(w, from_, to),
                "categories": lambda w: sales_by_category(w, from_, to),
                "top_products": lambda w: top_products(w, from_, to, top_n),
                "cities": lambda w: sales_by_city(w, from_, to),
                "daily": lambda w: daily_sales(w, from_, to)}
    if kind not in builders:
        raise ValueError(f"unknown report {kind!r}")
    if wh is not None:
        return builders[kind](wh)
    if kind == "summary":
        return spark.createDataFrame(
            [(0.0, 0, 0, 0, 0.0, from_, to)],
            "total_revenue double, order_count bigint, customer_count bigint, units_sold bigint, "
            "average_order_value double, range_from string, range_to string")
    return spark.createDataFrame([], _EMPTY[kind])
