"""Shape analytics: the distribution properties a sales dataset is expected to
show — revenue by month with its peak and trough, category revenue shares,
lines per order, status mix by order age, concentration of orders on the top
fifth of customers, and how many cities / categories earned revenue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import one_row
from ..functions.money import money
from ..sources.warehouse import Warehouse


def revenue_by_month(wh: Warehouse) -> DataFrame:
    """Fact revenue per calendar month (``yyyy-MM``), flagging the peak and
    trough months (ties flag every tied month). One row per month, so the
    whole-series max/min window runs over a calendar-bounded frame."""
    m = (wh.fact_sales.groupBy("sale_month").agg(F.sum("revenue").alias("rev"))
         .select(F.format_string("%04d-%02d", (F.col("sale_month") / 100).cast("int"),
                                 F.col("sale_month") % 100).alias("month"), "rev"))
    # One row per calendar month: the unpartitioned window sees a bounded frame.
    w = Window.partitionBy()
    return m.select("month", money(F.col("rev")).alias("revenue"),
                    (F.col("rev") == F.max("rev").over(w)).alias("is_peak"),
                    (F.col("rev") == F.min("rev").over(w)).alias("is_trough"))


def category_share(wh: Warehouse) -> DataFrame:
    """Each category's share of fact revenue (double, one division)."""
    per_product = wh.fact_sales.groupBy("product_key").agg(F.sum("revenue").alias("rev"))
    c = (per_product.join(wh.dim_product.select("product_key", "category"), "product_key")
         .groupBy("category").agg(F.sum("rev").alias("rev")))
    total = one_row(c.agg(F.sum("rev").alias("total")))["total"]
    return c.select(
        "category", money(F.col("rev")).alias("revenue"),
        F.when(total > 0, F.col("rev").cast("double") / total.cast("double"))
        .otherwise(F.lit(0.0)).alias("share"))


def lines_per_order(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Histogram: number of orders per line count (orders without lines → 0)."""
    per = order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"))
    counted = orders.select(F.col("id").alias("order_id")).join(per, "order_id", "left")
    return (counted.groupBy(F.coalesce(F.col("lines"), F.lit(0)).cast("long").alias("lines"))
            .agg(F.count(F.lit(1)).alias("orders")))


def status_by_age(orders: DataFrame, as_of: str, recent_days: int = 21) -> DataFrame:
    """Status mix of recent (≤ ``recent_days`` before ``as_of``) vs settled orders."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("order_date"))
    bucket = F.when(age <= recent_days, "recent").otherwise("settled")
    g = orders.groupBy(bucket.alias("age_bucket"), "status").agg(F.count(F.lit(1)).alias("orders"))
    tot = g.groupBy("age_bucket").agg(F.sum("orders").alias("bucket_orders"))  # ≤ 2 rows
    return g.join(F.broadcast(tot), "age_bucket").select(
        "age_bucket", "status", "orders",
        (F.col("orders").cast("double") / F.col("bucket_orders").cast("double")).alias("share"))


def loyal_share(orders: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Share of orders placed by the top ``fraction`` of ordering customers.

    Exact without ranking customers globally: the per-customer order counts are
    reduced to a histogram (count value → customers having it; its size is
    bounded by the number of distinct count values, at most √(2·orders)), and
    the top-k sum is read off the histogram's cumulative counts from the top.
    Ties do not matter because only the sum of the k largest values is needed.
    """
    per = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    hist = per.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))
    total = one_row(hist.agg(F.sum("customers").alias("ranked"),
                             F.sum(F.col("n") * F.col("customers")).alias("orders")))
    ranked, all_orders = total["ranked"], total["orders"]
    k = F.floor(ranked * fraction + 0.5)  # round half up
    w = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cum = hist.withColumn("before", F.coalesce(F.sum("customers").over(w), F.lit(0)))
    taken = cum.select(
        "n", F.greatest(F.lit(0), F.least(F.col("customers"), k - F.col("before"))).alias("take"))
    # Global aggregate: one row even when no customer ordered.
    return taken.agg(F.sum(F.col("n") * F.col("take")).alias("top_orders")).where(
        ranked.isNotNull()).select(
        ranked.cast("long").alias("customers_with_orders"),
        k.cast("long").alias("top_customers"),
        F.col("top_orders").cast("long").alias("top_orders"),
        all_orders.cast("long").alias("orders"),
        (F.col("top_orders").cast("double") / all_orders.cast("double")).alias("share"))


def category_revenue_positive(wh: Warehouse) -> DataFrame:
    """How many cities and categories earned revenue (HAVING sum > 0)."""
    pairs = wh.fact_sales.groupBy("customer_key", "product_key").agg(F.sum("revenue").alias("rev"))
    per_customer = pairs.groupBy("customer_key").agg(F.sum("rev").alias("rev"))
    per_product = pairs.groupBy("product_key").agg(F.sum("rev").alias("rev"))
    cities = (per_customer.join(wh.dim_customer.select("customer_key", "city"), "customer_key")
              .groupBy("city").agg(F.sum("rev").alias("r")).where(F.col("r") > 0)
              .agg(F.count(F.lit(1)).alias("cities_with_revenue")))
    cats = (per_product.join(wh.dim_product.select("product_key", "category"), "product_key")
            .groupBy("category").agg(F.sum("rev").alias("r")).where(F.col("r") > 0)
            .agg(F.count(F.lit(1)).alias("categories_with_revenue")))
    return cities.select("cities_with_revenue",
                         one_row(cats)["categories_with_revenue"].alias("categories_with_revenue"))
