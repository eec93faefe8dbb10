"""The same adapter and star schema stated in plain SQL (DuckDB dialect).

Used only to check results: each registered query has an oracle statement
that recomputes it from the driver's tables with these CTEs, independently of
the Spark plan. Values leave the oracle in the same edge form as the Spark
results: money as DOUBLE, counts as BIGINT, dates as ``yyyy-MM-dd`` text.
"""

from __future__ import annotations

ADAPTER = """
stg_customers AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS id, c.c_name AS name,
         'c' || CAST(c.c_custkey AS VARCHAR) || '@example.com' AS email,
         n.n_name AS city, r.r_name AS state,
         TIMESTAMP '1994-01-01 00:00:00' + to_minutes(CAST((c.c_custkey * 7919) % 525600 AS BIGINT)) AS created_at
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey),
stg_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku,
         p_name AS name, p_type AS category, CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price,
         p_size > 4 AS active,
         TIMESTAMP '1993-01-01 00:00:00' + to_minutes(CAST((p_partkey * 104729) % 525600 AS BIGINT)) AS created_at
  FROM part),
stg_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'confirmed'
                            WHEN 'P' THEN 'cancelled' END AS status,
         CAST(o_orderdate AS DATE) AS order_date,
         CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST((o_orderkey * 7919) % 1440 AS BIGINT)) AS created_at
  FROM orders),
stg_order_items AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   strftime(l_shipdate, '%Y%m%d')) AS id,
         CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(trunc(l_quantity) AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price_at_sale
  FROM lineitem)"""

STAR = """
dim_customer AS (
  SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS customer_key, id AS customer_id,
         name, city, state, created_at FROM stg_customers),
dim_product AS (
  SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS product_key, id AS product_id,
         sku, name, category, unit_price AS current_unit_price, active FROM stg_products),
date_bounds AS (
  SELECT min(order_date) AS first_day, max(order_date) AS last_day
  FROM stg_orders WHERE status NOT IN ('cancelled')),
dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date,
         CAST(dayofmonth(d) AS INTEGER) AS day, CAST(month(d) AS INTEGER) AS month,
         strftime(d, '%B') AS month_name, CAST(quarter(d) AS INTEGER) AS quarter,
         CAST(year(d) AS INTEGER) AS year, isodow(d) >= 6 AS is_weekend
  FROM (SELECT CAST(unnest(generate_series(CAST(first_day AS TIMESTAMP), CAST(last_day AS TIMESTAMP),
                                           INTERVAL 1 DAY)) AS DATE) AS d
        FROM date_bounds WHERE first_day IS NOT NULL)),
fact_sales AS (
  SELECT CAST(row_number() OVER (ORDER BY i.id) AS BIGINT) AS sale_key, o.id AS order_id,
         i.id AS order_item_id, c.customer_key, p.product_key, d.date_key, i.quantity,
         i.unit_price_at_sale AS unit_price,
         CAST(i.quantity * i.unit_price_at_sale AS DECIMAL(14,2)) AS revenue
  FROM stg_order_items i
  JOIN stg_orders o ON o.id = i.order_id
  JOIN dim_customer c ON c.customer_id = o.customer_id
  JOIN dim_product p ON p.product_id = i.product_id
  JOIN dim_date d ON d.full_date = o.order_date
  WHERE o.status NOT IN ('cancelled'))"""


def sql(body: str, *extra_ctes: str) -> str:
    """``WITH`` adapter + star (+ extra CTEs) followed by ``body``."""
    ctes = [ADAPTER.strip(), STAR.strip(), *[c.strip() for c in extra_ctes]]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def avg_money_sql(total: str, count: str) -> str:
    """round(total / count, 2) half-up in integer cents, 0 when count is 0."""
    cents = f"CAST(({total}) * 100 AS HUGEINT)"
    n = f"CAST(({count}) AS HUGEINT)"
    return (f"CASE WHEN ({count}) > 0 THEN CAST({cents} // {n} + "
            f"CASE WHEN 2 * ({cents} % {n}) >= {n} THEN 1 ELSE 0 END AS DOUBLE) / 100 "
            f"ELSE 0.0 END")


def key_window(lo: str | None, hi: str | None, col: str = "date_key") -> str:
    """Inclusive window over a yyyymmdd key column (either side open)."""
    parts = ["TRUE"]
    if lo:
        parts.append(f"{col} >= {int(lo.replace('-', ''))}")
    if hi:
        parts.append(f"{col} <= {int(hi.replace('-', ''))}")
    return " AND ".join(parts)
