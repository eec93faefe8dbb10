"""Registered queries of the commit log, the order store, the run rules, the
roll-ups and the checksums, with their oracle statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.keys import materialize
from ..operators import audit as AU
from ..operators import operational as O
from ..operators import integrity as I
from ..operators import rollup as RU
from ..operators import run_rules as RR
from ..operators.substring_index import SubstringIndex
from ..session import scratch_root
from ..sources import lake, testdata
from ..sources.order_store import OrderStore
from ..sources.sorted_table import SortedTable
from ..sources.warehouse import version_counts
from .catalog import _PROPOSALS, AS_OF, SEARCH, WINDOW, D, TS, _audit_ctes, _audit_events, _dw, _intake_sql, _map_json, proposals, supplier_customers
from .oracle import sql
from .pipeline import build_and_publish
from .registry import register, warehouse

# --------------------------------------------------------------------------
# Versions (SNK-3, SNK-8): a warehouse of the orders before CUT, then of all

CUT = "1996-01-01"


@register("warehouse_versions", sql(f"""
SELECT * FROM (
SELECT CAST(1 AS BIGINT) AS version, CAST(0 AS BIGINT) AS base, t AS "table", n AS recorded, n AS "rows" FROM (
  SELECT 'dim_customer' AS t, count(*) AS n FROM stg_customers UNION ALL SELECT 'dim_product', count(*) FROM stg_products
  UNION ALL SELECT 'dim_date', coalesce(date_diff('day', min(order_date), max(order_date)) + 1, 0) FROM stg_orders WHERE status <> 'cancelled' AND order_date < DATE '{CUT}'
  UNION ALL SELECT 'fact_sales', count(*) FROM fact_sales f JOIN dim_date d ON d.date_key = f.date_key WHERE d.full_date < DATE '{CUT}') a
UNION ALL
SELECT 2, 1, t, n, n FROM (
  SELECT 'dim_customer' AS t, count(*) AS n FROM dim_customer UNION ALL SELECT 'dim_product', count(*) FROM dim_product
  UNION ALL SELECT 'dim_date', count(*) FROM dim_date UNION ALL SELECT 'fact_sales', count(*) FROM fact_sales) b) x"""))
def q_warehouse_versions(spark, sf_dir):
    """Two versions of one warehouse, published after each other, and the rows
    of both: the older one stays readable by its number."""
    raw = testdata.snapshot(spark, sf_dir)
    early = raw["orders"].where(f"order_date < date'{CUT}'")
    lines = raw["order_items"].join(early.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    root = f"{scratch_root(spark)}/versions-{uuid.uuid4().hex}"
    build_and_publish(spark, raw | {"orders": early, "order_items": lines}, root, run_id="early")
    build_and_publish(spark, raw, root, run_id="all")
    return version_counts(spark, f"{root}/warehouse")


# --------------------------------------------------------------------------
# Intake commits (§2.13): existing orders, then two batches, the second sent twice

FIRST_BATCH = "1997-01-01"
SECOND_BATCH = "1998-01-01"
BATCHES = ("batch-1997", "batch-1998")


def _uuid_sql(*place: str) -> str:
    h = f"sha256(concat_ws(':', {', '.join(place)}))"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))")


_BATCH = f"CASE WHEN s.order_date < DATE '{SECOND_BATCH}' THEN '{BATCHES[0]}' ELSE '{BATCHES[1]}' END"
_APPLIED = sql(f"""
SELECT o.id AS order_id, o.customer_id, o.status, strftime(o.order_date, {D}) AS order_date, strftime(o.created_at, {TS}) AS created_at,
       i.id AS order_item_id, i.product_id, CAST(i.quantity AS DOUBLE) AS quantity, CAST(i.unit_price_at_sale AS DOUBLE) AS unit_price_at_sale
FROM stg_orders o LEFT JOIN stg_order_items i ON i.order_id = o.id WHERE o.order_date < DATE '{FIRST_BATCH}'
UNION ALL
SELECT {_uuid_sql('b.batch', 'b.order_ref')}, b.customer_id, b.status, b.order_date, '{AS_OF} 00:00:00',
       {_uuid_sql('b.batch', 'b.order_ref', 'CAST(l.position AS VARCHAR)')}, l.product_id, CAST(l.quantity AS DOUBLE),
       CAST(CAST(coalesce(l.unit_price_at_sale, p.unit_price) AS DECIMAL(12,2)) AS DOUBLE)
FROM batch b JOIN lines l ON l.order_ref = b.order_ref JOIN stg_products p ON p.id = l.product_id""",
               _PROPOSALS, f"""verdicts AS ({_intake_sql('lines')}),
batch AS (SELECT v.*, {_BATCH} AS batch FROM verdicts v JOIN stg_orders s ON s.id = v.order_ref
          WHERE v.issues = '' AND s.order_date >= DATE '{FIRST_BATCH}')""")


@register("intake_applied", _APPLIED)
def q_intake_applied(spark, sf_dir):
    """Orders and lines of the store after two committed batches."""
    raw = testdata.snapshot(spark, sf_dir)
    old = raw["orders"].where(f"order_date < date'{FIRST_BATCH}'")
    store = OrderStore(spark, f"{scratch_root(spark)}/order-store-{uuid.uuid4().hex}")
    store.create(raw | {"orders": old, "order_items": raw["order_items"].join(old.select(F.col("id").alias("order_id")), "order_id", "left_semi")})
    headers, lines, _ = proposals(spark, sf_dir)
    days = raw["orders"].select(F.col("id").alias("order_ref"), F.col("order_date").alias("day"))
    sent = days.select("order_ref", F.expr(f"case when day >= date'{SECOND_BATCH}' then '{BATCHES[1]}' when day >= date'{FIRST_BATCH}' then '{BATCHES[0]}' end").alias("batch"))
    sent = sent.where("batch is not null").distinct()
    # a commit reads its lines several times; their places are worked out once
    lines = materialize(lines.join(sent, "order_ref"), "sent-lines", by="batch")
    for batch in (*BATCHES, BATCHES[1]):
        of = F.col("batch") == batch
        store.apply_orders(batch, headers.join(sent.where(of), "order_ref", "left_semi"), lines.where(of).drop("batch"), AS_OF)
    now = store.tables()
    items = now["order_items"].select(F.col("id").alias("order_item_id"), "order_id", "product_id", F.col("quantity").cast("double").alias("quantity"), "unit_price_at_sale")
    return now["orders"].withColumnRenamed("id", "order_id").join(items, "order_id", "left")


@register("customers_applied", sql(f"""
SELECT id, name, email, city, state, strftime(created_at, {TS}) AS created_at FROM stg_customers
UNION ALL
SELECT {_uuid_sql("'suppliers'", 'ref')}, name, email, city, state, '{AS_OF} 00:00:00' FROM (
  SELECT p.*, count(*) OVER (PARTITION BY p.email) AS cnt FROM (
    SELECT CAST(s.s_suppkey AS VARCHAR) AS ref, trim(s.s_name) AS name, lower('C' || CAST(s.s_suppkey * 37 AS VARCHAR) || '@Example.com') AS email,
           n.n_name AS city, r.r_name AS state
    FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey) p) q
WHERE cnt = 1 AND NOT EXISTS (SELECT 1 FROM stg_customers c WHERE lower(c.email) = q.email)
  AND length(name) BETWEEN 1 AND 120 AND length(city) BETWEEN 1 AND 80 AND length(state) BETWEEN 1 AND 80"""))
def q_customers_applied(spark, sf_dir):
    """Customers of the store after the suppliers were committed as new ones."""
    store = OrderStore(spark, f"{scratch_root(spark)}/order-store-{uuid.uuid4().hex}")
    raw = testdata.snapshot(spark, sf_dir)
    store.create(raw | {"orders": raw["orders"].limit(0), "order_items": raw["order_items"].limit(0)})
    store.apply_customers("suppliers", supplier_customers(spark, sf_dir), AS_OF)
    return store.tables()["customers"]


# --------------------------------------------------------------------------
# Run rules (FLT-9, AGG-15)

_SWEEP = """
run_ends AS (SELECT started_at AS moment, 1 AS change FROM run_state WHERE completed_at IS NULL OR completed_at >= started_at
             UNION ALL SELECT completed_at, -1 FROM run_state WHERE completed_at >= started_at),
run_moments AS (SELECT moment, sum(change) AS change FROM run_ends GROUP BY moment),
run_counts AS (SELECT moment, CAST(sum(change) OVER (ORDER BY moment) AS BIGINT) AS active_runs FROM run_moments)"""


@register("run_constraint_violations", sql("""
SELECT 'status_known' AS "constraint", CAST(count(*) FILTER (WHERE status NOT IN ('queued','running','succeeded','failed')) AS BIGINT) AS affected FROM run_state
UNION ALL SELECT 'completion_consistent', count(*) FILTER (WHERE (status IN ('queued','running')) <> (completed_at IS NULL)) FROM run_state
UNION ALL SELECT 'not_backwards', count(*) FILTER (WHERE completed_at < started_at) FROM run_state
UNION ALL SELECT 'error_only_on_failure', count(*) FILTER (WHERE error_summary IS NOT NULL AND status <> 'failed') FROM run_state
UNION ALL SELECT 'row_counts_is_object', count(*) FILTER (WHERE row_counts IS NULL OR json_type(row_counts) <> 'OBJECT') FROM run_state
UNION ALL SELECT 'single_active_run', count(*) FROM run_counts WHERE active_runs > 1""", _audit_ctes(), _SWEEP))
def q_run_constraint_violations(spark, sf_dir):
    return RR.run_constraint_violations(AU.run_state(_audit_events(spark, sf_dir)))


@register("concurrent_runs", sql("""
SELECT epoch_us(moment) AS moment_us, active_runs FROM run_counts WHERE active_runs > 1""", _audit_ctes(), _SWEEP))
def q_concurrent_runs(spark, sf_dir):
    """Every instant from which more than one run is active, and how many are."""
    return RR.concurrent_moments(AU.run_state(_audit_events(spark, sf_dir))).select(F.unix_micros("moment").alias("moment_us"), "active_runs")


# --------------------------------------------------------------------------
# Roll-ups (AGG-1, 3, 5, 6, 16): distinct customers of any window and period

_MEASURES = """CAST(sum(f.revenue) AS DOUBLE) AS revenue, CAST(count(DISTINCT f.order_id) AS BIGINT) AS order_count,
       CAST(count(DISTINCT f.customer_key) AS BIGINT) AS customer_count, CAST(sum(f.quantity) AS BIGINT) AS units_sold"""


def _rolled_sql(cols: str, group: str, window: tuple[str, str] | None = None) -> str:
    return sql(f"""
SELECT {cols}, {_MEASURES} FROM fact_sales f JOIN dim_date d ON d.date_key = f.date_key
JOIN dim_customer c ON c.customer_key = f.customer_key JOIN dim_product p ON p.product_key = f.product_key
WHERE {_dw(*window) if window else 'TRUE'} GROUP BY {group}""")


_WEEK = f"strftime(date_trunc('week', d.full_date), {D})"


@register("distinct_weekly", _rolled_sql(f"{_WEEK} AS date", _WEEK))
def q_distinct_weekly(spark, sf_dir):
    return RU.rolled(warehouse(spark, sf_dir), "all", "weekly").drop("value", "value2")


@register("distinct_monthly", _rolled_sql("strftime(d.full_date, '%Y-%m') AS date", "strftime(d.full_date, '%Y-%m')"))
def q_distinct_monthly(spark, sf_dir):
    return RU.rolled(warehouse(spark, sf_dir), "all", "monthly").drop("value", "value2")


@register("distinct_by_category_monthly_window", _rolled_sql("p.category AS category, strftime(d.full_date, '%Y-%m') AS date", "p.category, strftime(d.full_date, '%Y-%m')", WINDOW))
def q_distinct_by_category(spark, sf_dir):
    return RU.rolled(warehouse(spark, sf_dir), "category", "monthly", *WINDOW).withColumnRenamed("value", "category").drop("value2")


@register("distinct_by_city_window", _rolled_sql("c.city AS city, c.state AS state", "c.city, c.state", WINDOW))
def q_distinct_by_city(spark, sf_dir):
    return (RU.rolled(warehouse(spark, sf_dir), "city", "whole", *WINDOW)
            .withColumnRenamed("value", "city").withColumnRenamed("value2", "state").drop("date"))


# --------------------------------------------------------------------------
# Checksums (AGG-25)

def _checksum_sql(table: str, columns: list[str], source: str) -> str:
    parts = " || ".join(f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '~')" for c in columns)
    lanes = " || ".join(f"format('{{:08x}}', CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0) % 4294967296 AS BIGINT))" for i in range(I.LANES))
    return f"""SELECT '{table}' AS "table", CAST(count(*) AS BIGINT) AS "rows", {lanes} AS checksum FROM (SELECT sha256({parts}) AS h FROM {source}) x"""


def _text(*names: str) -> list[str]:
    return [f"CAST({n} AS VARCHAR)" for n in names]


def _time(name: str) -> str:
    return f"strftime({name}, {TS})"


@register("table_fingerprint", sql("\nUNION ALL ".join([
    _checksum_sql("dim_customer", [*_text("customer_key", "customer_id", "name", "city", "state"), _time("created_at")], "dim_customer"),
    _checksum_sql("dim_product", _text("product_key", "product_id", "sku", "name", "category", "current_unit_price", "active"), "dim_product"),
    _checksum_sql("dim_date", _text("date_key", "full_date", "day", "month", "month_name", "quarter", "year", "is_weekend"), "dim_date"),
    _checksum_sql("fact_sales", _text("sale_key", "order_id", "order_item_id", "customer_key", "product_key", "date_key", "quantity", "unit_price", "revenue"), "fact_sales")])))
def q_table_fingerprint(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    return I.fingerprint({"dim_customer": wh.dim_customer, "dim_product": wh.dim_product, "dim_date": wh.dim_date,
                          "fact_sales": wh.fact_sales.drop("sale_month")})


@register("lake_checksums", sql("\nUNION ALL ".join([
    _checksum_sql("customers", [*_text("id", "name", "email", "city", "state"), _time("created_at")], "stg_customers"),
    _checksum_sql("products", [*_text("id", "sku", "name", "category", "unit_price", "active"), _time("created_at")], "stg_products"),
    _checksum_sql("orders", [*_text("id", "customer_id", "status", "order_date"), _time("created_at")], "stg_orders"),
    _checksum_sql("order_items", _text("id", "order_id", "product_id", "quantity", "unit_price_at_sale"), "stg_order_items")])))
def q_lake_checksums(spark, sf_dir):
    """Checksum of every table of the lake run, added up over its files."""
    run = lake.read_run(spark, _lake_prefix(spark, sf_dir))
    return I._stack([I.combined(I.file_checksums(df)).select(F.lit(t).alias("table"), "rows", I.checksum_text().alias("checksum")) for t, df in run.items()])


def _lake_prefix(spark, sf_dir) -> str:
    return warehouse(spark, sf_dir).metadata.where(F.col("key") == "lake_prefix").select("value").first()[0]


# --------------------------------------------------------------------------
# What a build writes about itself (SNK-2, SNK-7, SRC-8): its fixed part

@register("lake_runs", sql("""
SELECT CAST(4 AS BIGINT) AS tables, (SELECT count(*) FROM stg_customers) + (SELECT count(*) FROM stg_products)
       + (SELECT count(*) FROM stg_orders) + (SELECT count(*) FROM stg_order_items) AS "rows", TRUE AS date_is_a_day, TRUE AS id_is_a_uuid"""))
def q_lake_runs(spark, sf_dir):
    """The committed lake run behind the warehouse, found by its ``run_date=…/run_id=…`` prefix."""
    from ..config import DATE_PATTERN, UUID_V4_PATTERN
    prefix = _lake_prefix(spark, sf_dir)
    tables = lake.manifest_entries(spark, prefix).agg(F.count_distinct("table")).first()[0]
    return lake.lake_runs(spark, prefix.split("/run_date=")[0]).where(F.col("run_id") == prefix.rsplit("=", 1)[1]).select(
        F.lit(tables).cast("long").alias("tables"), "rows", F.col("run_date").cast("string").rlike(DATE_PATTERN).alias("date_is_a_day"),
        F.col("run_id").rlike(UUID_V4_PATTERN).alias("id_is_a_uuid"))


@register("warehouse_metadata", """
SELECT 'run_id' AS key, 'a run id' AS value UNION ALL SELECT 'lake_prefix', 'the prefix of this run' UNION ALL SELECT 'published_at', 'an instant'
UNION ALL SELECT 'schema_version', '1.0.0' UNION ALL SELECT 'pipeline_version', '0.1.0' UNION ALL SELECT 'excluded_order_statuses', 'cancelled'""")
def q_warehouse_metadata(spark, sf_dir):
    """The stamped keys; generated values are replaced by what they must be."""
    from ..config import UUID_V4_PATTERN
    wh = warehouse(spark, sf_dir)
    run = wh.version.split("=", 1)[1]
    v, k = F.col("value"), F.col("key")
    return wh.metadata.select(k, F.when((k == "run_id") & v.rlike(UUID_V4_PATTERN) & (v == run), "a run id")
                              .when((k == "lake_prefix") & v.endswith(f"run_id={run}"), "the prefix of this run")
                              .when((k == "published_at") & v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"), "an instant")
                              .otherwise(v).alias("value"))


# --------------------------------------------------------------------------
# Deep pages, point lookups, substring search (SRT-2/3/9, FLT-5, FLT-8)

DEEP_LINES, DEEP_ORDERS, DEEP_LIMIT = 50_000, 12_000, 100
LINES = "SELECT id, order_id, product_id, quantity, CAST(unit_price_at_sale AS DOUBLE) AS unit_price_at_sale FROM stg_order_items"


def _sorted_lines(spark, sf_dir) -> SortedTable:
    return SortedTable.build(testdata.stg_order_items(spark, sf_dir), f"{scratch_root(spark)}/sorted-lines-{uuid.uuid4().hex}", [("id", False)])


@register("lines_page_deep", sql(f"{LINES} ORDER BY id LIMIT {DEEP_LIMIT} OFFSET {DEEP_LINES}"))
def q_lines_page_deep(spark, sf_dir):
    """A page far behind the first rows, from the files that hold it."""
    return _sorted_lines(spark, sf_dir).page(DEEP_LIMIT, DEEP_LINES)


@register("orders_page_deep", sql(f"""
SELECT id, customer_id, status, strftime(order_date, {D}) AS order_date, strftime(created_at, {TS}) AS created_at FROM stg_orders
ORDER BY stg_orders.order_date DESC, stg_orders.created_at DESC, id LIMIT {DEEP_LIMIT} OFFSET {DEEP_ORDERS}"""))
def q_orders_page_deep(spark, sf_dir):
    table = SortedTable.build(testdata.stg_orders(spark, sf_dir), f"{scratch_root(spark)}/sorted-orders-{uuid.uuid4().hex}", O.ORDER_ORDER)
    return table.page(DEEP_LIMIT, DEEP_ORDERS)


LINE_PREFIX = "7-1-"


@register("line_by_id", sql(f"{LINES} WHERE id = (SELECT min(id) FROM stg_order_items WHERE id LIKE '{LINE_PREFIX}%')"))
def q_line_by_id(spark, sf_dir):
    """A line looked up by its id (the first line of order 7)."""
    wanted = testdata.stg_order_items(spark, sf_dir).where(F.col("id").startswith(LINE_PREFIX)).agg(F.min("id")).first()[0]
    return _sorted_lines(spark, sf_dir).find(wanted)


@register("customer_search_indexed", sql(f"""
SELECT id, name, email, city, state, strftime(created_at, {TS}) AS created_at FROM stg_customers
WHERE contains(lower(name), '{SEARCH}') OR contains(lower(email), '{SEARCH}') OR contains(lower(city), '{SEARCH}')
ORDER BY stg_customers.created_at DESC, id LIMIT 200"""))
def q_customer_search_indexed(spark, sf_dir):
    customers = testdata.stg_customers(spark, sf_dir)
    index = SubstringIndex.build(customers, f"{scratch_root(spark)}/substrings-{uuid.uuid4().hex}", ["name", "email", "city"])
    return O.customer_search_indexed(index, customers, SEARCH)
