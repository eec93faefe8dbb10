"""Quality gate: the checks a build must pass before it is published.

``quality_report`` returns one row per check (check, passed, affected,
detail) as a single lazy plan that reads the fact twice: one aggregate per day
(measures, dates, the span of its dimension keys), and one ledger of all keys
(see ``functions.ledger``) that answers the uniqueness and count checks. Keys
of a dimension without a gap are all known when their span lies in the
dimension's; only otherwise do the references enter the ledger, which then
counts them exactly.
Spark enforces no keys, so besides the fourteen checks of the specification
the gate also checks every primary / unique key of the star tables.

``assert_quality`` evaluates the report (a few dozen rows) and raises with
every failure, after all checks ran.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EXCLUDED_ORDER_STATUSES
from ..functions.joins import one_row
from ..functions.ledger import dangling, entries, ledger, repeated, total

#: Keys of the fact that one task of the ledger counts.
KEYS_A_TASK = 500_000


class QualityError(RuntimeError):
    def __init__(self, failures: list[tuple[str, str]]):
        self.failures = failures
        super().__init__("quality gate failed: " + "; ".join(f"{n}: {d}" for n, d in failures))


def _row(name: str, affected: Column, detail: Column) -> list[Column]:
    affected = F.coalesce(affected, F.lit(0)).cast("long")
    passed = affected == 0
    return [F.lit(name).alias("check"), passed.alias("passed"), affected.alias("affected"),
            F.when(passed, F.lit("ok")).otherwise(detail).alias("detail")]


def quality_report(dim_customer: DataFrame, dim_product: DataFrame, dim_date: DataFrame,
                   fact_sales: DataFrame, orders: DataFrame, order_items: DataFrame,
                   rows: int | None = None) -> DataFrame:
    """One row per check. ``rows`` of the fact, where known, tell over how many
    tasks its keys are dealt."""
    f = fact_sales
    sold = orders.where(~F.col("status").isin(*EXCLUDED_ORDER_STATUSES))
    spans = {"customer_key": dim_customer, "product_key": dim_product}

    by_day = f.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if(F.col("sale_key").isNull() | F.col("order_id").isNull()
                   | F.col("order_item_id").isNull() | F.col("customer_key").isNull()
                   | F.col("product_key").isNull() | F.col("date_key").isNull()
                   | F.col("quantity").isNull() | F.col("unit_price").isNull()
                   | F.col("revenue").isNull()).alias("null_keys"),
        F.count_if(F.col("revenue") != (F.col("quantity") * F.col("unit_price"))
                   .cast("decimal(14,2)")).alias("bad_revenue"),
        F.count_if(F.col("quantity") <= 0).alias("bad_qty"),
        F.count_if((F.col("unit_price") < 0) | (F.col("revenue") < 0)).alias("bad_price"),
        *[c for k in spans for c in (F.count(k).alias(f"n_{k}"), F.min(k).alias(f"min_{k}"), F.max(k).alias(f"max_{k}"))])
    days = dim_date.select("date_key", F.lit(True).alias("known")).distinct()
    measures = by_day.join(days, "date_key", "left").agg(
        F.sum(F.when(F.col("known").isNull(), F.col("facts"))).alias("missing_date_key"),
        *[F.sum(c).alias(c) for c in ("facts", "null_keys", "bad_revenue", "bad_qty", "bad_price", *[f"n_{k}" for k in spans])],
        *[F.min(f"min_{k}").alias(f"min_{k}") for k in spans], *[F.max(f"max_{k}").alias(f"max_{k}") for k in spans])
    scanned = one_row(measures)

    def all_known(key: str, dim: DataFrame) -> Column:
        """Whether no key of the fact is null or outside a dimension that holds every key of its span."""
        d = one_row(dim.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count_distinct(key).alias("n")))
        return F.coalesce((d["n"] == d["hi"] - d["lo"] + 1) & (scanned[f"n_{key}"] == scanned["facts"])
                          & (scanned[f"min_{key}"] >= d["lo"]) & (scanned[f"max_{key}"] <= d["hi"]), F.lit(False))

    # Lines reduced per order first (map-side partial count), then joined to
    # the sold orders once; the ledger counts them by their day.
    sold_lines = (order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
                  .join(sold.select(F.col("id").alias("order_id"), "order_date"), "order_id")
                  .groupBy("order_date").agg(F.sum("n").alias("n")))
    one, used, held = F.lit(1), F.col("used"), F.col("held")
    named = lambda *names: {k: F.col(k) for k in names}
    keys = ledger(
        entries(f, held=named("order_item_id", "sale_key"), used=named(*spans),
                unless=reduce(Column.__and__, [all_known(k, dim) for k, dim in spans.items()])),
        entries(sold_lines, used={"full_date": F.col("order_date")}, n=F.col("n")),
        entries(dim_customer, held=named("customer_key", "customer_id")),
        entries(dim_product, held=named("product_key", "sku", "product_id")),
        entries(dim_date, held=named("date_key", "full_date")),
        dealt=True, tasks=None if rows is None else 1 + 2 * rows // KEYS_A_TASK)
    day = F.when((F.col("kind") == "full_date") & (held > 0), F.col("key")).cast("date")
    unique = ("customer_id", "sku", "order_item_id", "customer_key", "product_key", "product_id",
              "date_key", "full_date", "sale_key")
    totals = keys.agg(
        total(used, "full_date").alias("expected"),
        *[total(used, k, dangling()).alias(f"missing_{k}") for k in spans],
        total(one, "full_date", (used > 0) & dangling()).alias("absent_days"),
        total(held, "full_date").alias("rows"),
        (F.datediff(F.max(day), F.min(day)) + 1).alias("days"),
        *[repeated(k).alias(f"repeated_{k}") for k in unique])

    def check(name: str, affected: Column | str, detail: Column | str) -> Column:
        return F.struct(*_row(name, F.col(affected) if isinstance(affected, str) else affected,
                              F.lit(detail) if isinstance(detail, str) else detail))

    counted = ("facts", "missing_date_key", "null_keys", "bad_revenue", "bad_qty", "bad_price")
    one_line = totals.select("*", *[F.coalesce(scanned[c], F.lit(0)).alias(c) for c in counted])
    return one_line.select(F.inline(F.array(
        check("fact_sales_not_empty", F.when(F.col("facts") == 0, 1).otherwise(0), "the fact table is empty"),
        check("no_null_keys", "null_keys", "a key or measure of a fact is null"),
        check("revenue_matches_quantity_times_price", "bad_revenue", "revenue differs from units times price"),
        check("positive_quantity", "bad_qty", "a fact sells no units"),
        check("non_negative_price", "bad_price", "a fact has a price or revenue below zero"),
        check("fact_count_matches_source", F.abs(F.col("facts") - F.col("expected")),
              F.format_string("%d facts stand against %d sold source lines", F.col("facts"), F.col("expected"))),
        check("fact_joins_customer", "missing_customer_key", "some facts have no customer row"),
        check("fact_joins_product", "missing_product_key", "some facts have no product row"),
        check("fact_joins_date", "missing_date_key", "some facts have no date row"),
        check("unique_customer_id", "repeated_customer_id", "a customer id has several rows"),
        check("unique_product_sku", "repeated_sku", "a sku has several rows"),
        check("unique_order_item", "repeated_order_item_id", "an order line is in the facts more than once"),
        check("date_dimension_gap_free",
              F.when(F.col("rows") == 0, 0).otherwise(F.abs(F.col("rows") - F.col("days"))),
              F.format_string("%d date rows cover a span of %d days",
                              F.col("rows"), F.coalesce(F.col("days"), F.lit(0)))),
        check("all_sold_days_present", "absent_days", "a sold day has no date row"),
        # Keys Spark does not enforce.
        check("unique_customer_key", "repeated_customer_key", "dim_customer repeats a customer_key"),
        check("unique_product_key", "repeated_product_key", "dim_product repeats a product_key"),
        check("unique_product_id", "repeated_product_id", "dim_product repeats a product_id"),
        check("unique_date_key", "repeated_date_key", "dim_date repeats a date_key"),
        check("unique_full_date", "repeated_full_date", "dim_date repeats a full_date"),
        check("unique_sale_key", "repeated_sale_key", "fact_sales repeats a sale_key"),
    )))


def failures(report: DataFrame) -> list[tuple[str, str]]:
    return [(r["check"], r["detail"]) for r in report.where(~F.col("passed")).collect()]


def assert_quality(report: DataFrame) -> None:
    bad = failures(report)
    if bad:
        raise QualityError(bad)
