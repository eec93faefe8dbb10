"""Snapshot integrity: declared non-null columns, referential checks, the
source CHECK constraints, row counts and a multiset checksum.

Each report is one lazy plan of one-row aggregates stacked with
``unionByName``; per-row predicates of one table share one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EMAIL_PATTERN, ORDER_STATUSES, RAW_TABLES
from ..schemas import RAW


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def schema_violations(raw: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows, and rows with a null in any declared column."""
    out = []
    for t in RAW_TABLES:
        anynull = reduce(lambda a, b: a | b, [F.col(f.name).isNull() for f in RAW[t].fields])
        out.append(raw[t].agg(F.count(F.lit(1)).cast("long").alias("rows"),
                              F.count_if(anynull).cast("long").alias("null_rows"))
                   .select(F.lit(t).alias("table"), "rows", "null_rows"))
    return _stack(out)


def orphans(raw: dict[str, DataFrame]) -> DataFrame:
    """Children whose parent is missing: order→customer, item→order, item→product."""
    c, p, o, i = (raw[t] for t in RAW_TABLES)

    def anti(child: DataFrame, fk: str, parent: DataFrame, name: str) -> DataFrame:
        return (child.select(fk).join(parent.select(F.col("id").alias(fk)), fk, "left_anti")
                .agg(F.count(F.lit(1)).cast("long").alias("affected"))
                .select(F.lit(name).alias("check"), "affected"))
    return _stack([anti(o, "customer_id", c, "order_customer"),
                   anti(i, "order_id", o, "item_order"),
                   anti(i, "product_id", p, "item_product")])


def extract_gate(raw: dict[str, DataFrame]) -> DataFrame:
    """What must hold before anything immutable is written: (check, affected)
    for null values per table and for children without a parent."""
    nulls = schema_violations(raw).select(F.concat(F.lit("nulls_in_"), "table").alias("check"),
                                          F.col("null_rows").alias("affected"))
    return nulls.unionByName(orphans(raw))


def constraint_violations(raw: dict[str, DataFrame]) -> DataFrame:
    """The source table CHECK constraints, counted per constraint."""
    c, p, o, i = (raw[t] for t in RAW_TABLES)

    def blank(col: str):
        return F.trim(F.col(col)) == ""
    rules = {
        "customers": (c, [("customers_name_not_blank", blank("name")),
                          ("customers_city_not_blank", blank("city")),
                          ("customers_state_not_blank", blank("state")),
                          ("customers_email_shape", ~F.col("email").rlike(EMAIL_PATTERN)),
                          ("customers_email_length", F.length("email") > 200)]),
        "products": (p, [("products_sku_not_blank", blank("sku")),
                         ("products_name_not_blank", blank("name")),
                         ("products_category_not_blank", blank("category")),
                         ("products_price_non_negative", F.col("unit_price") < 0)]),
        "orders": (o, [("orders_status_known", ~F.col("status").isin(*ORDER_STATUSES))]),
        "order_items": (i, [("order_items_quantity_positive", F.col("quantity") <= 0),
                            ("order_items_price_non_negative", F.col("unit_price_at_sale") < 0)]),
    }
    out = []
    for _, (df, checks) in rules.items():
        agg = df.agg(*[F.count_if(pred).cast("long").alias(name) for name, pred in checks])
        stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("constraint"),
                                               F.col(name).alias("affected"))
                                      for name, _ in checks]))
        out.append(agg.select(stacked.alias("r")).select("r.constraint", "r.affected"))
    return _stack(out)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack([df.agg(F.count(F.lit(1)).cast("long").alias("rows"))
                   .select(F.lit(name).alias("table"), "rows") for name, df in tables.items()])


#: A row's SHA-256 is added up in eight lanes of 32 bits, each modulo 2**32.
LANES = 8


def row_text(schema: T.StructType) -> Column:
    """One text per row that tells any two different rows apart: each value with
    its length before it, a null as ``~``."""
    def part(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`").cast("string")
        return F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("~"))
    return F.concat(*[part(f) for f in schema.fields])


def _lanes(df: DataFrame) -> list[Column]:
    h = F.sha2(row_text(df.schema), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(12,0)").alias(f"lane{i}") for i in range(LANES)]


def _lane_sums() -> list[Column]:
    return [F.pmod(F.coalesce(F.sum(f"lane{i}"), F.lit(0)), F.lit(1 << 32)).cast("long").alias(f"lane{i}") for i in range(LANES)]


def checksum_text() -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(f"lane{i}")), 8, "0") for i in range(LANES)])


def checksum(df: DataFrame) -> DataFrame:
    """One row: the rows and the multiset checksum of ``df``.

    The sum over the rows of their SHA-256, lane by lane: equal for equal
    multisets whatever their order or files, and additive, so the checksum of a
    union is the sum of the parts' (:func:`combined`). A changed, lost or repeated row
    alters it.
    """
    return (df.select(*_lanes(df)).agg(F.count(F.lit(1)).cast("long").alias("rows"), *_lane_sums()))


def combined(parts: DataFrame) -> DataFrame:
    """The checksum of the union of disjoint parts (rows of :func:`checksum`)."""
    return parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), *_lane_sums())


def file_checksums(df: DataFrame) -> DataFrame:
    """A checksum row per file of a table read from files."""
    return (df.select(F.col("_metadata.file_path").alias("path"), *_lanes(df)).groupBy("path")
            .agg(F.count(F.lit(1)).cast("long").alias("rows"), *_lane_sums()))


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """Order-insensitive checksum per table: table, rows, checksum (64 hex digits)."""
    return _stack([checksum(df).select(F.lit(name).alias("table"), "rows", checksum_text().alias("checksum"))
                   for name, df in tables.items()])
