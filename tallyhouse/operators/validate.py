"""Dataset validation: 23 rules with affected counts, and 16 statistics.

Input is a *dataset*: customers, products, orders, order_items as delivered
(money as the source number, order_date as text), before the declared types
are applied — a money-scale or date-shape rule run after the cast could never
fail. Every rule is reported with its ``affected`` count, zero included; a
dataset is ok when all counts are zero.

Plan shape: the simple per-row rules of a table fold into one aggregate of that
table, and all uniqueness and reference rules into one ledger of its keys (see
``functions.ledger``), so no rule reads a table again and a hot key collapses
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DATE_PATTERN, EMAIL_PATTERN, ORDER_STATUSES, UUID_V4_PATTERN
from ..functions.joins import one_row
from ..functions.ledger import dangling, entries, ledger, surplus, total
from ..functions.money import round_div_cents

MONEY_MAX = 9_999_999_999.99


def valid_money(v: Column) -> Column:
    """Non-negative, inside numeric(12,2), at most two decimal places.

    Exact: the amount must survive the round trip through decimal(12,2); a
    double has that one nearest two-decimal amount or none."""
    exact = v.try_cast("decimal(12,2)")
    return v.isNotNull() & exact.isNotNull() & (exact >= 0) & (v <= MONEY_MAX) & (exact.cast("double") == v.cast("double"))


def validation_report(ds: dict[str, DataFrame], requested,
                      end_date: str) -> DataFrame:
    c, p, o, i = ds["customers"], ds["products"], ds["orders"], ds["order_items"]
    blank = lambda col: F.when(F.trim(F.col(col)) == "", 1).otherwise(0)
    bad_uuid = lambda col: F.when(~F.col(col).rlike(UUID_V4_PATTERN), 1).otherwise(0)

    cs = c.agg(F.count(F.lit(1)).alias("n"),
               F.sum(bad_uuid("id")).alias("bad_id"),
               F.count_if(~F.col("email").rlike(EMAIL_PATTERN)).alias("bad_email"),
               F.sum(blank("name") + blank("city") + blank("state")).alias("blank"))
    ps = p.agg(F.count(F.lit(1)).alias("n"),
               F.sum(bad_uuid("id")).alias("bad_id"),
               F.sum(blank("sku") + blank("name") + blank("category")).alias("blank"),
               F.count_if(~valid_money(F.col("unit_price"))).alias("bad_money"))
    os_ = o.agg(F.count(F.lit(1)).alias("n"),
                F.sum(bad_uuid("id")).alias("bad_id"),
                F.count_if(~F.col("status").isin(*ORDER_STATUSES) | F.col("status").isNull())
                .alias("bad_status"),
                F.count_if(~F.col("order_date").rlike(DATE_PATTERN) | F.col("order_date").isNull())
                .alias("bad_date"),
                F.count_if(F.col("order_date") > F.lit(end_date)).alias("late"))
    its = i.agg(F.sum(bad_uuid("id")).alias("bad_id"),
                F.count_if(~valid_money(F.col("unit_price_at_sale"))).alias("bad_money"),
                F.count_if(F.col("quantity").isNull() | (F.col("quantity") < 1)).alias("bad_qty"))

    used, held = F.col("used"), F.col("held")
    keys = ledger(
        entries(c, held={"customer_id": F.col("id"), "email": F.lower(F.col("email"))}),
        entries(p, held={"product_id": F.col("id"), "sku": F.col("sku")}, marked=F.when(~F.col("active"), 1).otherwise(0),
                unknown=F.when(F.col("active").isNull(), 1).otherwise(0)),
        entries(o, held={"order_id": F.col("id")}, used={"customer_id": F.col("customer_id")}),
        entries(i, held={"line_id": F.col("id"), "pair": (F.col("order_id"), F.col("product_id"))},
                used={"order_id": F.col("order_id"), "product_id": F.col("product_id")}))
    known = F.col("key").isNotNull()
    totals = keys.agg(
        *[surplus(k).alias(f"surplus_{k}") for k in ("customer_id", "product_id", "order_id", "line_id", "email", "sku", "pair")],
        total(used, "customer_id", dangling()).alias("no_customer"),
        total(used, "order_id", dangling()).alias("no_order"),
        total(held, "order_id", ~known | (used == 0)).alias("no_line"),
        # a product row whose active flag is null counts as absent
        total(F.when(dangling(), used).otherwise(used * F.col("unknown")), "product_id").alias("no_product"),
        total(used * F.col("marked"), "product_id", known).alias("inactive"))
    # One row holds every count: the tables' measures beside the ledger's totals.
    line = totals
    for prefix, frame in (("c", cs), ("p", ps), ("o", os_), ("i", its)):
        got = one_row(frame)
        line = line.select("*", *[F.coalesce(got[x], F.lit(0)).alias(f"{prefix}_{x}") for x in frame.columns])

    def rule(name: str, affected: Column | str, detail: str) -> Column:
        affected = F.col(affected) if isinstance(affected, str) else affected
        return F.struct(F.lit(name).alias("rule"), F.coalesce(affected, F.lit(0)).cast("long").alias("affected"),
                        F.lit(detail).alias("detail"))

    def requested_rule(n: str, name: str, what: str) -> Column:
        """``requested`` maps table → int, or is a one-row frame of counts."""
        if isinstance(requested, DataFrame):
            want = one_row(requested)[what]
        else:
            want = requested.get(what)
            want = None if want is None else F.lit(want)
        affected = F.lit(0) if want is None else F.when(F.col(n) != want, 1).otherwise(0)
        return rule(name, affected, f"generated {what} count differs from the request")

    return line.select(F.inline(F.array(
        requested_rule("c_n", "requested_customer_count", "customers"),
        requested_rule("p_n", "requested_product_count", "products"),
        requested_rule("o_n", "requested_order_count", "orders"),
        rule("unique_customer_id", "surplus_customer_id", "customer id occurs more than once"),
        rule("unique_product_id", "surplus_product_id", "product id occurs more than once"),
        rule("unique_order_id", "surplus_order_id", "order id occurs more than once"),
        rule("unique_order_item_id", "surplus_line_id", "line id occurs more than once"),
        rule("uuid_v4_shape", F.col("c_bad_id") + F.col("p_bad_id") + F.col("o_bad_id") + F.col("i_bad_id"),
             "id has not the form of a version 4 UUID"),
        rule("unique_customer_email", "surplus_email", "e-mail occurs more than once, ignoring case"),
        rule("unique_product_sku", "surplus_sku", "sku occurs more than once"),
        rule("order_customer_exists", "no_customer", "the order's customer is absent"),
        rule("order_item_order_exists", "no_order", "the line's order is absent"),
        rule("order_item_product_exists", "no_product", "the line's product is absent"),
        rule("customer_email_shape", "c_bad_email", "e-mail has no valid shape"),
        rule("blank_text", F.col("c_blank") + F.col("p_blank"), "a text that must be filled is blank"),
        rule("money_scale", F.col("p_bad_money") + F.col("i_bad_money"), "price is not a two-decimal amount"),
        rule("quantity_positive", "i_bad_qty", "quantity is not a positive integer"),
        rule("order_status_known", "o_bad_status", "status is not a known status"),
        rule("order_date_shape", "o_bad_date", "order_date is not YYYY-MM-DD"),
        rule("one_line_per_product", "surplus_pair", "order repeats a product"),
        rule("order_has_items", "no_line", "the order has no line"),
        rule("active_products_only", "inactive", "the line's product is inactive"),
        rule("order_date_within_window", "o_late", f"the order is later than {end_date}"),
    )))


def dataset_statistics(ds: dict[str, DataFrame], end_date: str) -> DataFrame:
    """One row of dataset statistics.

    Revenue counts every line (cancelled orders included); the average order
    value and items per order divide by the orders that have lines.
    """
    c, p, o, i = ds["customers"], ds["products"], ds["orders"], ds["order_items"]
    cs = c.agg(F.count(F.lit(1)).alias("customers"),
               F.count_distinct("city").alias("cities_covered"))
    ps = p.agg(F.count(F.lit(1)).alias("products"),
               F.count_if(F.col("active")).alias("active_products"),
               F.count_distinct("category").alias("categories_covered"))
    os_ = o.agg(F.count(F.lit(1)).alias("orders"),
                F.count_distinct("order_date").alias("distinct_order_days"),
                F.coalesce(F.min("order_date"), F.lit(end_date)).alias("first_order_date"),
                F.coalesce(F.max("order_date"), F.lit(end_date)).alias("last_order_date"))
    cust_with_orders = o.select("customer_id").distinct().agg(
        F.count(F.lit(1)).alias("customers_with_orders"))
    line_cents = F.round(F.col("unit_price_at_sale") * 100).cast("long") * F.col("quantity")
    priced = i.join(p.select(F.col("id").alias("product_id"), F.col("unit_price").alias("cat")),
                    "product_id", "left")
    its = priced.agg(
        F.count(F.lit(1)).alias("order_items"),
        F.coalesce(F.sum(line_cents.cast("decimal(38,0)")), F.lit(0)).alias("rev_cents"),
        F.count_if(F.col("cat").isNull() | (F.col("cat") != F.col("unit_price_at_sale")))
        .alias("discounted"))
    # Lines reduced per order once (map-side partial count): its row count is
    # the number of orders with lines, and the anti join for orders without
    # lines reads it instead of the lines.
    per_order = i.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    paying = per_order.agg(F.count(F.lit(1)).alias("paying"))
    without = o.join(per_order.select(F.col("order_id").alias("id")), "id", "left_anti").agg(
        F.count(F.lit(1)).alias("orders_without_items"))

    # One row: the line aggregate carries the other one-row aggregates as
    # scalar subqueries.
    s = its
    for d in (cs, ps, os_, cust_with_orders, paying, without):
        row = one_row(d)
        s = s.select("*", *[row[c].alias(c) for c in d.columns])

    def per(num: Column, den: Column, scale: int) -> Column:
        return F.when(den > 0, round_div_cents(num * (10 ** scale), den).cast("double")
                      / (10 ** scale)).otherwise(F.lit(0.0))

    return s.select(
        F.col("customers").cast("long").alias("customers"),
        F.col("products").cast("long").alias("products"),
        F.col("active_products").cast("long").alias("active_products"),
        F.col("orders").cast("long").alias("orders"),
        F.col("order_items").cast("long").alias("order_items"),
        F.col("cities_covered").cast("long").alias("cities_covered"),
        F.col("categories_covered").cast("long").alias("categories_covered"),
        F.col("distinct_order_days").cast("long").alias("distinct_order_days"),
        F.col("first_order_date").alias("first_order_date"),
        F.col("last_order_date").alias("last_order_date"),
        (F.col("rev_cents").cast("double") / 100).alias("total_revenue"),
        per(F.col("rev_cents"), F.col("paying"), 0).alias("_aov_cents"),
        per(F.col("order_items"), F.col("paying"), 2).alias("average_items_per_order"),
        F.col("orders_without_items").cast("long").alias("orders_without_items"),
        F.col("customers_with_orders").cast("long").alias("customers_with_orders"),
        per(F.col("discounted"), F.col("order_items"), 3).alias("discounted_line_share"),
    ).withColumn("average_order_value", F.col("_aov_cents") / 100).drop("_aov_cents")


