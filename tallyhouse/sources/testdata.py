"""Adapter: the driver's TPC-H-style tables as the four operational tables.

The test data has no cancelled status, no e-mail and no single-column line id,
so the stand-ins are stated here once; ``tallyhouse.plans.oracle`` states the
same mapping in SQL for the DuckDB comparison.

===============  ==========================================================
customers        customer ⋈ nation ⋈ region: id = c_custkey as text,
                 email = ``c<key>@example.com``, city = n_name, state = r_name
products         part: sku = ``SKU-<key>``, category = p_type,
                 unit_price = p_retailprice as decimal(12,2), active = p_size > 4
orders           status F → delivered, O → confirmed, P → cancelled
order_items      id = orderkey-linenumber-partkey-suppkey-yyyyMMdd(shipdate),
                 unit_price_at_sale = l_extendedprice as decimal(12,2)
===============  ==========================================================

``created_at`` values are deterministic staggers so that "newest first"
listings have a real order that differs from the id order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW, conform

# --- fixed values: status mapping of the source letters ------------------
STATUS_BY_LETTER = {"F": "delivered", "O": "confirmed", "P": "cancelled"}
# --- end of fixed values ----------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _minutes_after(base: str, minutes) -> F.Column:
    return F.expr(f"timestamp_ntz'{base}'") + F.make_dt_interval(
        F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def stg_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region", "r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    joined = c.join(geo, c.c_nationkey == geo.n_nationkey)
    cid = F.col("c_custkey").cast("string")
    return conform(joined.select(
        cid.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("c"), cid, F.lit("@example.com")).alias("email"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        _minutes_after("1994-01-01 00:00:00", (F.col("c_custkey") * 7919) % 525600).alias("created_at"),
    ), RAW["customers"])


def stg_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    return conform(p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price"),
        (F.col("p_size") > 4).alias("active"),
        _minutes_after("1993-01-01 00:00:00", (F.col("p_partkey") * 104729) % 525600).alias("created_at"),
    ), RAW["products"])


def _status(letter: F.Column) -> F.Column:
    expr = None
    for key, value in STATUS_BY_LETTER.items():
        expr = (F.when(letter == key, value) if expr is None else expr.when(letter == key, value))
    return expr


def stg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return conform(o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        _status(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        (F.col("o_orderdate").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0),
                              ((F.col("o_orderkey") * 7919) % 1440).cast("int"), F.lit(0))
         ).alias("created_at"),
    ), RAW["orders"])


def stg_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
              "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    return conform(li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.date_format(F.col("l_shipdate"), "yyyyMMdd")).alias("id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price_at_sale"),
    ), RAW["order_items"])


def snapshot(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four operational tables, lazily, from one test-data directory."""
    return {
        "customers": stg_customers(spark, sf_dir),
        "products": stg_products(spark, sf_dir),
        "orders": stg_orders(spark, sf_dir),
        "order_items": stg_order_items(spark, sf_dir),
    }


def dataset(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four tables as *delivered*, before the declared types: money as the
    source number and order_date as ``yyyy-MM-dd`` text (validator input)."""
    raw = snapshot(spark, sf_dir)
    part = read(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    products = raw["products"].drop("unit_price").join(
        part.select(F.col("p_partkey").cast("string").alias("id"),
                    F.col("p_retailprice").alias("unit_price")), "id")
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
              "l_quantity", "l_extendedprice", "l_shipdate")
    items = li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.date_format(F.col("l_shipdate"), "yyyyMMdd")).alias("id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("unit_price_at_sale"))
    orders = raw["orders"].withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))
    return {"customers": raw["customers"], "products": products, "orders": orders,
            "order_items": items}


def requested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many customers, products and orders the source holds —
    what the extract was asked to deliver."""
    def n(name: str) -> F.Column:
        return read(spark, sf_dir, name).agg(F.count(F.lit(1))).scalar()
    return read(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("customers")).select(
        "customers", n("part").alias("products"), n("orders").alias("orders"))


# --- fixed values: audit status of each event type of the ``events`` table -
RUN_STATUS_BY_EVENT = {"signup": "queued", "view": "running", "click": "running",
                       "purchase": "succeeded", "error": "failed"}
# --- end of fixed values ----------------------------------------------------


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` table as a run-audit event log.

    ``events`` is an append-only log of timestamped events per user, the shape
    of the audit: each user is a pipeline run (``run-<user_id>``), each event
    an audit event whose status follows from its type. A success carries the
    event's JSON ``props`` as the run's row counts and a lake prefix; a failure
    carries an error text, summarised (redacted, capped) as the audit stores it.
    """
    return audit_log(read(spark, sf_dir, "events", "user_id", "ts", "event_type", "props"))


def audit_log(ev: DataFrame) -> DataFrame:
    """Rows of ``events``, read as a table or as a stream, as audit events."""
    from ..operators.audit import summarise

    status = F.lit(None).cast("string")
    for etype, st in reversed(list(RUN_STATUS_BY_EVENT.items())):
        status = F.when(F.col("event_type") == etype, st).otherwise(status)
    run_id = F.concat(F.lit("run-"), F.col("user_id").cast("string"))
    ok = F.col("event_type") == "purchase"
    failed = F.col("event_type") == "error"
    return ev.select(
        run_id.alias("run_id"),
        # the log's wall-clock times are UTC: parsed with an explicit zone, so
        # the instant does not depend on the session time zone
        F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp").alias("event_ts"),
        status.alias("status"),
        F.when(ok, F.from_json("props", "map<string,bigint>")).alias("row_counts"),
        F.when(ok, F.concat(F.lit("raw/run_date="), F.to_date("ts").cast("string"),
                            F.lit("/run_id="), run_id)).alias("lake_prefix"),
        F.when(failed, summarise(F.concat(F.lit("run failed after event "), F.col("props"))))
        .alias("error_summary"))
