"""Batch intake of proposed orders and catalogue entries.

Each proposed order is all-or-nothing: any failing rule rejects the whole
order, and every failing rule is reported (not only the first). Rules:

* customer must exist; every product must exist and be active;
* the date defaults to ``as_of`` and must not be after it; the status
  defaults to ``pending`` and must be a known status;
* 1–50 lines, quantity 1–1000 per line;
* no product twice in one order (the first repeated line and the line it
  repeats are named) — or, with ``on_repeat="merge"``, repeats are merged
  into one line with the quantities summed and capped at 1000;
* the sale price is the explicit price, else the catalogue price at intake.

Everything is line-level joins plus one ``groupBy(order_ref)``: no per-order
arrays are collected, so an oversized order is just rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (DEFAULT_ORDER_STATUS, EMAIL_PATTERN, MAX_LINES_PER_ORDER,
                      MAX_QUANTITY_PER_LINE, ORDER_STATUSES)

ISSUE_ORDER = ("customer_not_found", "product_not_found", "product_inactive", "future_date",
               "unknown_status", "line_count", "quantity_out_of_range", "repeated_product")


def merge_repeats(lines: DataFrame) -> DataFrame:
    """One line per (order, product): quantities summed and capped, the first
    position and the first explicit price kept. What the cap and the choice of
    price leave out is reported: ``requested_quantity`` is the whole sum, and
    ``price_conflict`` tells that the merged lines named different prices."""
    return lines.groupBy("order_ref", "product_id").agg(
        F.min("position").alias("position"),
        F.least(F.sum("quantity"), F.lit(MAX_QUANTITY_PER_LINE)).cast("int").alias("quantity"),
        F.min_by("unit_price_at_sale", F.when(F.col("unit_price_at_sale").isNotNull(),
                                              F.col("position"))).alias("unit_price_at_sale"),
        F.sum("quantity").cast("long").alias("requested_quantity"),
        (F.min("unit_price_at_sale") < F.max("unit_price_at_sale")).alias("price_conflict"))


def _issues(flags: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags]))


def order_intake(headers: DataFrame, lines: DataFrame, customers: DataFrame,
                 products: DataFrame, as_of: str, on_repeat: str = "reject") -> DataFrame:
    """One row per proposed order: resolved header, totals, accepted, issues."""
    if on_repeat not in ("reject", "merge"):
        raise ValueError("on_repeat must be 'reject' or 'merge'")
    if on_repeat == "merge":
        lines = merge_repeats(lines)
    catalogue = products.select(F.col("id").alias("product_id"),
                                F.col("unit_price").alias("catalogue_price"), "active")
    # Each line learns the first position of its product in its order from a
    # pre-aggregated (order, product) table: the map-side partial minimum
    # means a hot order or product never lands whole in one task (a window
    # would), and AQE splits a skewed key of the line side of the join. The
    # join is null-safe, so lines group exactly as ``partitionBy`` would.
    # One more join prices the lines, and one groupBy per order folds every
    # line rule, the total and the first repeated line.
    if on_repeat == "merge":
        # merged lines are unique per (order, product): each is its own first
        marked = lines.withColumn("first_pos", F.col("position"))
        extra = [F.coalesce(F.sum(F.col("requested_quantity") - F.col("quantity")), F.lit(0)).alias("clipped"),
                 F.count_if("price_conflict").alias("conflicts")]
    else:
        firsts = (lines.groupBy("order_ref", "product_id")
                  .agg(F.min("position").alias("first_pos"))
                  .select(F.col("order_ref").alias("_o"), F.col("product_id").alias("_p"),
                          "first_pos"))
        extra = []
        marked = lines.join(firsts, lines["order_ref"].eqNullSafe(firsts["_o"])
                            & lines["product_id"].eqNullSafe(firsts["_p"]),
                            "left").drop("_o", "_p")
    repeat_pos = F.when(F.col("position") > F.col("first_pos"), F.col("position"))
    priced = (marked
              .join(catalogue, "product_id", "left")
              .withColumn("price", F.coalesce(F.col("unit_price_at_sale"),
                                              F.col("catalogue_price"))))
    per_order = priced.groupBy("order_ref").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(F.col("catalogue_price").isNull()).alias("missing"),
        F.count_if(F.col("active") == F.lit(False)).alias("inactive"),
        F.count_if(~F.col("quantity").between(1, MAX_QUANTITY_PER_LINE)
                   | F.col("quantity").isNull()).alias("bad_qty"),
        F.sum("quantity").alias("units"),
        F.sum(F.col("quantity") * F.col("price")).alias("total"),
        F.min(repeat_pos).alias("first_repeat"),
        F.min_by("first_pos", repeat_pos).alias("repeat_of"), *extra)

    known = customers.select(F.col("id").alias("customer_id"), F.lit(True).alias("_known"))
    h = (headers.join(known, "customer_id", "left")
         .join(per_order, "order_ref", "left"))
    order_date = F.coalesce(F.col("order_date"), F.lit(as_of).cast("date"))
    status = F.coalesce(F.col("status"), F.lit(DEFAULT_ORDER_STATUS))
    n_lines = F.coalesce(F.col("line_count"), F.lit(0))
    flags = [
        ("customer_not_found", F.col("_known").isNull()),
        ("product_not_found", F.coalesce(F.col("missing"), F.lit(0)) > 0),
        ("product_inactive", F.coalesce(F.col("inactive"), F.lit(0)) > 0),
        ("future_date", order_date > F.lit(as_of).cast("date")),
        ("unknown_status", ~status.isin(*ORDER_STATUSES)),
        ("line_count", ~n_lines.between(1, MAX_LINES_PER_ORDER)),
        ("quantity_out_of_range", F.coalesce(F.col("bad_qty"), F.lit(0)) > 0),
        ("repeated_product", F.col("first_repeat").isNotNull()),
    ]
    issues = _issues(flags)
    return h.select(
        "order_ref", "customer_id", order_date.alias("order_date"), status.alias("status"),
        n_lines.cast("long").alias("line_count"),
        F.coalesce(F.col("units"), F.lit(0)).cast("long").alias("units"),
        F.when(F.col("missing") == 0, F.col("total")).cast("decimal(24,2)").alias("total"),
        (F.size(issues) == 0).alias("accepted"),
        F.array_join(issues, ",").alias("issues"),
        F.col("first_repeat").cast("int").alias("first_repeat"),
        F.col("repeat_of").cast("int").alias("repeat_of"),
        # only a merge clips units or drops a price, and it says so
        *([F.coalesce("clipped", F.lit(0)).cast("long").alias("clipped_units"),
           F.coalesce("conflicts", F.lit(0)).cast("long").alias("price_conflicts")] if on_repeat == "merge" else []))


def accepted_lines(intake: DataFrame, lines: DataFrame, products: DataFrame,
                   on_repeat: str = "reject") -> DataFrame:
    """Lines of accepted orders with the sale price fixed at intake."""
    if on_repeat == "merge":
        lines = merge_repeats(lines)
    ok = intake.where("accepted").select("order_ref")
    catalogue = products.select(F.col("id").alias("product_id"),
                                F.col("unit_price").alias("catalogue_price"))
    return (lines.join(ok, "order_ref", "left_semi").join(catalogue, "product_id", "left")
            .select("order_ref", "position", "product_id", "quantity",
                    F.coalesce(F.col("unit_price_at_sale"), F.col("catalogue_price"))
                    .cast("decimal(12,2)").alias("unit_price_at_sale")))


def _length_between(c: Column, lo: int, hi: int) -> Column:
    return F.length(c).between(lo, hi)


def customer_intake(proposed: DataFrame, customers: DataFrame) -> DataFrame:
    """Proposed customers: trimmed fields, lower-cased e-mail, length and shape
    rules, and e-mail conflicts against existing customers and inside the batch
    (every row sharing an e-mail conflicts)."""
    p = proposed.select(
        "ref", F.trim("name").alias("name"), F.lower(F.trim("email")).alias("email"),
        F.trim("city").alias("city"), F.trim("state").alias("state"))
    existing = customers.select(F.lower("email").alias("email"), F.lit(True).alias("_taken"))
    in_batch = p.groupBy("email").agg(F.count(F.lit(1)).alias("_n"))
    j = p.join(existing.distinct(), "email", "left").join(in_batch, "email", "left")
    flags = [
        ("invalid_name", ~_length_between(F.col("name"), 1, 120) | F.col("name").isNull()),
        ("invalid_email", ~F.col("email").rlike(EMAIL_PATTERN) | (F.length("email") > 200)
         | F.col("email").isNull()),
        ("invalid_city", ~_length_between(F.col("city"), 1, 80) | F.col("city").isNull()),
        ("invalid_state", ~_length_between(F.col("state"), 1, 80) | F.col("state").isNull()),
        ("email_conflict", F.col("_taken").isNotNull() | (F.col("_n") > 1)),
    ]
    issues = _issues(flags)
    return j.select("ref", "name", "email", "city", "state",
                    (F.size(issues) == 0).alias("accepted"),
                    F.array_join(issues, ",").alias("issues"))


def product_intake(proposed: DataFrame, products: DataFrame) -> DataFrame:
    """Proposed products: trimmed fields, lengths, money rule, active default
    true, sku conflicts against the catalogue and inside the batch."""
    from .validate import valid_money
    p = proposed.select(
        "ref", F.trim("sku").alias("sku"), F.trim("name").alias("name"),
        F.trim("category").alias("category"), F.col("unit_price"),
        F.coalesce(F.col("active"), F.lit(True)).alias("active"))
    existing = products.select("sku", F.lit(True).alias("_taken")).distinct()
    in_batch = p.groupBy("sku").agg(F.count(F.lit(1)).alias("_n"))
    j = p.join(existing, "sku", "left").join(in_batch, "sku", "left")
    flags = [
        ("invalid_sku", ~_length_between(F.col("sku"), 1, 40) | F.col("sku").isNull()),
        ("invalid_name", ~_length_between(F.col("name"), 1, 160) | F.col("name").isNull()),
        ("invalid_category", ~_length_between(F.col("category"), 1, 80)
         | F.col("category").isNull()),
        ("invalid_price", ~valid_money(F.col("unit_price"))),
        ("sku_conflict", F.col("_taken").isNotNull() | (F.col("_n") > 1)),
    ]
    issues = _issues(flags)
    return j.select("ref", "sku", "name", "category",
                    F.col("unit_price").try_cast("decimal(12,2)").alias("unit_price"), "active",
                    (F.size(issues) == 0).alias("accepted"),
                    F.array_join(issues, ",").alias("issues"))
