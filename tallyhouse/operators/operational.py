"""Operational reads over the four operational tables: filtered, paged and
nested listings, point lookups, search.

Pages are ``orderBy(...).offset(o).limit(l)``, planned as a top-k
(``TakeOrderedAndProject``): each task keeps only ``o + l`` rows, so a page
never sorts the table globally. For deep pages pass a keyset cursor instead
of an offset (``after=``), which becomes a pushed-down range predicate. The
total of a listing is a separate count over the same filtered frame.

Lines are attached to a page of orders with one semi join to the page's ids
(no query per order); the nested ``items`` array is built per order, and an
order's lines are bounded by the intake rule (≤ 50 lines).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ORDER_STATUSES, PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX, SEARCH_LIMIT


def check_page(limit: int, offset: int) -> None:
    if not isinstance(limit, int) or not 1 <= limit <= PAGE_LIMIT_MAX:
        raise ValueError(f"limit must be an integer in 1..{PAGE_LIMIT_MAX}")
    if not isinstance(offset, int) or offset < 0:
        raise ValueError("offset must be a non-negative integer")


def _page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    check_page(limit, offset)
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def _after(cols: list[tuple[str, bool]], values: tuple) -> Column:
    """Keyset predicate: rows strictly after ``values`` in the sort order.

    ``cols`` is [(name, descending)], ``values`` the last row's sort values.
    """
    cond = None
    for i in range(len(cols) - 1, -1, -1):
        name, desc = cols[i]
        beyond = F.col(name) < F.lit(values[i]) if desc else F.col(name) > F.lit(values[i])
        cond = beyond if cond is None else (beyond | ((F.col(name) == F.lit(values[i])) & cond))
    return cond


CUSTOMER_ORDER = [("created_at", True), ("id", False)]
PRODUCT_ORDER = [("created_at", True), ("id", False)]
ORDER_ORDER = [("order_date", True), ("created_at", True), ("id", False)]


def _sort(cols: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(n).desc() if d else F.col(n).asc() for n, d in cols]


def customers_page(customers: DataFrame, limit: int = PAGE_LIMIT_DEFAULT, offset: int = 0,
                   after: tuple | None = None) -> DataFrame:
    """Customers, newest first."""
    df = customers.where(_after(CUSTOMER_ORDER, after)) if after else customers
    return _page(df, _sort(CUSTOMER_ORDER), limit, offset)


def filter_products(products: DataFrame, category: str | None = None,
                    active: bool | None = None) -> DataFrame:
    if category is not None:
        products = products.where(F.col("category") == category.strip())
    if active is not None:
        products = products.where(F.col("active") == F.lit(bool(active)))
    return products


def products_page(products: DataFrame, category: str | None = None, active: bool | None = None,
                  limit: int = PAGE_LIMIT_DEFAULT, offset: int = 0,
                  after: tuple | None = None) -> DataFrame:
    """Products, newest first, optionally by category and active flag."""
    df = filter_products(products, category, active)
    if after:
        df = df.where(_after(PRODUCT_ORDER, after))
    return _page(df, _sort(PRODUCT_ORDER), limit, offset)


def by_id(df: DataFrame, key: str, column: str = "id") -> DataFrame:
    """The row of ``key``; an empty frame when it is unknown."""
    return df.where(F.col(column) == key)


def filter_orders(orders: DataFrame, customer_id: str | None = None, status: str | None = None,
                  from_: str | None = None, to: str | None = None) -> DataFrame:
    """Orders by customer, known status and an ordered date range."""
    if status is not None and status not in ORDER_STATUSES:
        raise ValueError(f"unknown order status {status!r}")
    if from_ is not None and to is not None and from_ > to:
        raise ValueError("the first day must not be after the last")
    if customer_id is not None:
        orders = orders.where(F.col("customer_id") == customer_id)
    if status is not None:
        orders = orders.where(F.col("status") == status)
    if from_ is not None:
        orders = orders.where(F.col("order_date") >= F.lit(from_).cast("date"))
    if to is not None:
        orders = orders.where(F.col("order_date") <= F.lit(to).cast("date"))
    return orders


def order_lines(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Every line with its product name and exact line total."""
    return order_items.join(
        products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")),
        "product_id", "left").select(
        "id", "order_id", "product_id", "product_name", "quantity", "unit_price_at_sale",
        (F.col("quantity") * F.col("unit_price_at_sale")).alias("line_total"))


def nest_lines(lines: DataFrame) -> DataFrame:
    """order_id → items (sorted by product name, then id), item_count, total.

    Called only on the lines of one page of orders (≤ 200) or one order; an
    order's array is bounded by the intake limit of 50 lines per order.
    """
    item = F.struct("product_name", "id", "product_id", "quantity", "unit_price_at_sale",
                    "line_total")
    return lines.groupBy("order_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.count(F.lit(1)).alias("item_count"),
        F.sum("line_total").alias("total"))


def orders_page(orders: DataFrame, customers: DataFrame, order_items: DataFrame,
                products: DataFrame, customer_id: str | None = None, status: str | None = None,
                from_: str | None = None, to: str | None = None,
                limit: int = PAGE_LIMIT_DEFAULT, offset: int = 0,
                after: tuple | None = None) -> DataFrame:
    """A page of order headers (with customer name) and their nested lines."""
    df = filter_orders(orders, customer_id, status, from_, to)
    if after:
        df = df.where(_after(ORDER_ORDER, after))
    page = _page(df, _sort(ORDER_ORDER), limit, offset)
    # The page has at most PAGE_LIMIT_MAX rows: a proven broadcast bound.
    page = F.broadcast(page)
    header = page.join(customers.select(F.col("id").alias("customer_id"),
                                        F.col("name").alias("customer_name")),
                       "customer_id", "left")
    ids = page.select(F.col("id").alias("order_id"))
    lines = order_lines(order_items.join(F.broadcast(ids), "order_id", "left_semi"), products)
    nested = nest_lines(lines).withColumnRenamed("order_id", "id")
    return header.join(nested, "id", "left").select(
        "id", "customer_id", "customer_name", "status", "order_date", "created_at",
        F.coalesce(F.col("items"), F.array()).alias("items"),
        F.coalesce(F.col("item_count"), F.lit(0)).cast("long").alias("item_count"),
        F.coalesce(F.col("total"), F.lit(0)).cast("decimal(24,2)").alias("total")
    ).orderBy(*_sort(ORDER_ORDER))


def order_by_id(orders: DataFrame, customers: DataFrame, order_items: DataFrame,
                products: DataFrame, order_id: str) -> DataFrame:
    """One order with its lines; empty frame when the id is unknown."""
    o = orders.where(F.col("id") == order_id)
    header = o.join(customers.select(F.col("id").alias("customer_id"),
                                     F.col("name").alias("customer_name")), "customer_id", "left")
    lines = order_lines(order_items.where(F.col("order_id") == order_id), products)
    nested = nest_lines(lines).withColumnRenamed("order_id", "id")
    return header.join(nested, "id", "left").select(
        "id", "customer_id", "customer_name", "status", "order_date",
        F.coalesce(F.col("items"), F.array()).alias("items"),
        F.coalesce(F.col("item_count"), F.lit(0)).cast("long").alias("item_count"),
        F.coalesce(F.col("total"), F.lit(0)).cast("decimal(24,2)").alias("total"))


def order_totals(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Every order's total and line count (0 for an order without lines)."""
    per = order_items.groupBy("order_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price_at_sale")).alias("total"),
        F.count(F.lit(1)).alias("item_count"))
    return orders.select(F.col("id").alias("order_id")).join(per, "order_id", "left").select(
        "order_id", F.coalesce(F.col("total"), F.lit(0)).cast("decimal(24,2)").alias("total"),
        F.coalesce(F.col("item_count"), F.lit(0)).cast("long").alias("item_count"))


def page_info(total: Column, limit: int, offset: int) -> list[Column]:
    """Page arithmetic on a total: first/last row shown, page number, page count."""
    return [total.cast("long").alias("total"), F.lit(limit).cast("long").alias("limit"),
            F.lit(offset).cast("long").alias("offset"),
            F.when(total > offset, F.lit(offset + 1)).otherwise(F.lit(0)).cast("long")
            .alias("first_row"),
            F.least(total, F.lit(offset + limit)).cast("long").alias("last_row"),
            F.lit(offset // limit + 1).cast("long").alias("page"),
            F.ceil(total / F.lit(limit)).cast("long").alias("page_count")]


def page_total(df: DataFrame, name: str, limit: int, offset: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("listing"), *page_info(F.col("n"), limit, offset))


def customer_search(customers: DataFrame, needle: str | None,
                    limit: int = SEARCH_LIMIT) -> DataFrame:
    """Case-insensitive substring match on name, email or city; first ``limit``
    newest first. A blank needle matches everyone."""
    df = customers
    n = (needle or "").strip().lower()
    if n:
        df = df.where(F.lower("name").contains(n) | F.lower("email").contains(n)
                      | F.lower("city").contains(n))
    return df.orderBy(*_sort(CUSTOMER_ORDER)).limit(limit)


def customer_search_indexed(index, customers: DataFrame, needle: str | None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """:func:`customer_search` over a ``SubstringIndex`` of name, email and city."""
    return index.search(customers, ["name", "email", "city"], needle).orderBy(*_sort(CUSTOMER_ORDER)).limit(limit)


def product_categories(products: DataFrame) -> DataFrame:
    """Distinct categories over all products, sorted."""
    return products.select("category").distinct().orderBy("category")


def order_estimate(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Basket estimate at the *current* catalogue price, per proposed order.

    ``lines``: (order_ref, product_id, quantity). An unknown product adds 0.
    """
    priced = lines.join(products.select(F.col("id").alias("product_id"),
                                        F.col("unit_price").alias("price")),
                        "product_id", "left")
    return priced.groupBy("order_ref").agg(
        F.coalesce(F.sum(F.col("quantity") * F.coalesce(F.col("price"), F.lit(0))),
                   F.lit(0)).alias("estimated_total"),
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("units"))
