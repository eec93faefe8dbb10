"""The registered queries and their oracle statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EMAIL_PATTERN, UUID_V4_PATTERN
from ..operators import analytics as A
from ..operators import audit as AU
from ..operators import integrity as I
from ..operators import intake as N
from ..operators import operational as O
from ..operators import quality
from ..operators import series as S
from ..operators import shape as SH
from ..operators import validate as V
from ..schemas import RAW
from ..sources import testdata
from .oracle import avg_money_sql, key_window, sql
from .registry import register, warehouse

# Fixed report parameters used by the registered variants.
WINDOW = ("1997-01-01", "1997-12-31")
DAILY_WINDOW = ("1998-03-01", "1998-05-31")
EMPTY_WINDOW = ("2030-01-01", "2030-01-31")
TOP_N = 10

TS = "'%Y-%m-%d %H:%M:%S'"
D = "'%Y-%m-%d'"


def _dw(lo: str | None, hi: str | None, col: str = "d.full_date") -> str:
    parts = ["TRUE"]
    if lo:
        parts.append(f"{col} >= DATE '{lo}'")
    if hi:
        parts.append(f"{col} <= DATE '{hi}'")
    return " AND ".join(parts)


# --------------------------------------------------------------------------
# Staging (adapter output, SRC-1/SRC-2/PRJ-1)

@register("stg_customers", sql(f"SELECT id, name, email, city, state, strftime(created_at, {TS}) AS created_at FROM stg_customers"))
def q_stg_customers(spark, sf_dir):
    return testdata.stg_customers(spark, sf_dir)


@register("stg_products", sql(f"SELECT id, sku, name, category, CAST(unit_price AS DOUBLE) AS unit_price, active, strftime(created_at, {TS}) AS created_at FROM stg_products"))
def q_stg_products(spark, sf_dir):
    return testdata.stg_products(spark, sf_dir)


@register("stg_orders", sql(f"SELECT id, customer_id, status, strftime(order_date, {D}) AS order_date, strftime(created_at, {TS}) AS created_at FROM stg_orders"))
def q_stg_orders(spark, sf_dir):
    return testdata.stg_orders(spark, sf_dir)


@register("stg_order_items", sql("SELECT id, order_id, product_id, quantity, CAST(unit_price_at_sale AS DOUBLE) AS unit_price_at_sale FROM stg_order_items"))
def q_stg_order_items(spark, sf_dir):
    return testdata.stg_order_items(spark, sf_dir)


# --------------------------------------------------------------------------
# Star schema (PRJ-2..5, FLT-1, JN-1, AGG-8, WIN-1..3)

@register("dim_customer", sql(f"SELECT customer_key, customer_id, name, city, state, strftime(created_at, {TS}) AS created_at FROM dim_customer"))
def q_dim_customer(spark, sf_dir):
    return warehouse(spark, sf_dir).dim_customer


@register("dim_product", sql("SELECT product_key, product_id, sku, name, category, CAST(current_unit_price AS DOUBLE) AS current_unit_price, active FROM dim_product"))
def q_dim_product(spark, sf_dir):
    return warehouse(spark, sf_dir).dim_product


@register("dim_date", sql(f"SELECT date_key, strftime(full_date, {D}) AS full_date, day, month, month_name, quarter, year, is_weekend FROM dim_date"))
def q_dim_date(spark, sf_dir):
    return warehouse(spark, sf_dir).dim_date


@register("fact_sales", sql("SELECT sale_key, order_id, order_item_id, customer_key, product_key, date_key, quantity, CAST(unit_price AS DOUBLE) AS unit_price, CAST(revenue AS DOUBLE) AS revenue FROM fact_sales"))
def q_fact_sales(spark, sf_dir):
    return warehouse(spark, sf_dir).fact_sales.drop("sale_month")


@register("excluded_items", sql("""
SELECT o.status, CAST(count(*) AS BIGINT) AS items, CAST(sum(i.quantity * i.unit_price_at_sale) AS DOUBLE) AS revenue
FROM stg_order_items i JOIN stg_orders o ON o.id = i.order_id
WHERE o.status IN ('cancelled') GROUP BY o.status"""))
def q_excluded_items(spark, sf_dir):
    """Order lines left out of the facts (cancelled orders): count and value."""
    from ..operators.star import excluded_items
    raw = testdata.snapshot(spark, sf_dir)
    return excluded_items(raw["orders"], raw["order_items"])


# --------------------------------------------------------------------------
# Quality gate (§2.11)

def _dupq(col: str, table: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {col} FROM {table} GROUP BY {col} HAVING count(*) > 1) x)"


_GATE_SQL = sql(f"""
SELECT "check", affected = 0 AS passed, CAST(affected AS BIGINT) AS affected FROM (
SELECT 'fact_sales_not_empty' AS "check", CASE WHEN (SELECT count(*) FROM fact_sales) = 0 THEN 1 ELSE 0 END AS affected
UNION ALL SELECT 'fact_joins_customer', (SELECT count(*) FROM fact_sales f WHERE NOT EXISTS (SELECT 1 FROM dim_customer d WHERE d.customer_key = f.customer_key))
UNION ALL SELECT 'fact_joins_product', (SELECT count(*) FROM fact_sales f WHERE NOT EXISTS (SELECT 1 FROM dim_product d WHERE d.product_key = f.product_key))
UNION ALL SELECT 'fact_joins_date', (SELECT count(*) FROM fact_sales f WHERE NOT EXISTS (SELECT 1 FROM dim_date d WHERE d.date_key = f.date_key))
UNION ALL SELECT 'no_null_keys', (SELECT count(*) FROM fact_sales WHERE sale_key IS NULL OR order_id IS NULL OR order_item_id IS NULL OR customer_key IS NULL OR product_key IS NULL OR date_key IS NULL OR quantity IS NULL OR unit_price IS NULL OR revenue IS NULL)
UNION ALL SELECT 'unique_customer_id', {_dupq('customer_id', 'dim_customer')}
UNION ALL SELECT 'unique_product_sku', {_dupq('sku', 'dim_product')}
UNION ALL SELECT 'unique_order_item', {_dupq('order_item_id', 'fact_sales')}
UNION ALL SELECT 'revenue_matches_quantity_times_price', (SELECT count(*) FROM fact_sales WHERE revenue <> CAST(quantity * unit_price AS DECIMAL(14,2)))
UNION ALL SELECT 'positive_quantity', (SELECT count(*) FROM fact_sales WHERE quantity <= 0)
UNION ALL SELECT 'non_negative_price', (SELECT count(*) FROM fact_sales WHERE unit_price < 0 OR revenue < 0)
UNION ALL SELECT 'fact_count_matches_source', abs((SELECT count(*) FROM fact_sales) - (SELECT count(*) FROM stg_order_items i JOIN stg_orders o ON o.id = i.order_id WHERE o.status NOT IN ('cancelled')))
UNION ALL SELECT 'date_dimension_gap_free', (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE abs(count(*) - (date_diff('day', min(full_date), max(full_date)) + 1)) END FROM dim_date)
UNION ALL SELECT 'all_sold_days_present', (SELECT count(*) FROM (SELECT DISTINCT o.order_date FROM stg_orders o WHERE o.status NOT IN ('cancelled') AND EXISTS (SELECT 1 FROM stg_order_items i WHERE i.order_id = o.id)) s WHERE s.order_date NOT IN (SELECT full_date FROM dim_date))
UNION ALL SELECT 'unique_customer_key', {_dupq('customer_key', 'dim_customer')}
UNION ALL SELECT 'unique_product_key', {_dupq('product_key', 'dim_product')}
UNION ALL SELECT 'unique_product_id', {_dupq('product_id', 'dim_product')}
UNION ALL SELECT 'unique_date_key', {_dupq('date_key', 'dim_date')}
UNION ALL SELECT 'unique_full_date', {_dupq('full_date', 'dim_date')}
UNION ALL SELECT 'unique_sale_key', {_dupq('sale_key', 'fact_sales')}) t""")


@register("quality_report", _GATE_SQL)
def q_quality_report(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    raw = testdata.snapshot(spark, sf_dir)
    return quality.quality_report(wh.dim_customer, wh.dim_product, wh.dim_date, wh.fact_sales,
                                  raw["orders"], raw["order_items"]).select(
        "check", "passed", "affected")


# --------------------------------------------------------------------------
# Analytics (AGG-1..7, JN-2/3/6, SRT-5..7, WIN-4/5)

def _kpi_sql(lo, hi):
    return sql(f"""
SELECT CAST(coalesce(sum(f.revenue), 0) AS DOUBLE) AS total_revenue,
       CAST(count(DISTINCT f.order_id) AS BIGINT) AS order_count,
       CAST(count(DISTINCT f.customer_key) AS BIGINT) AS customer_count,
       CAST(coalesce(sum(f.quantity), 0) AS BIGINT) AS units_sold,
       {avg_money_sql('coalesce(sum(f.revenue), 0)', 'count(DISTINCT f.order_id)')} AS average_order_value,
       coalesce(strftime(min(d.full_date), {D}), {f"'{lo}'" if lo else 'NULL'}) AS range_from,
       coalesce(strftime(max(d.full_date), {D}), {f"'{hi}'" if hi else 'NULL'}) AS range_to
FROM fact_sales f JOIN dim_date d ON d.date_key = f.date_key
WHERE {_dw(lo, hi)}""")


@register("revenue_summary", _kpi_sql(None, None))
def q_revenue_summary(spark, sf_dir):
    return A.revenue_summary(warehouse(spark, sf_dir))


@register("revenue_summary_window", _kpi_sql(*WINDOW))
def q_revenue_summary_window(spark, sf_dir):
    return A.revenue_summary(warehouse(spark, sf_dir), *WINDOW)


@register("revenue_summary_empty", _kpi_sql(*EMPTY_WINDOW))
def q_revenue_summary_empty(spark, sf_dir):
    return A.revenue_summary(warehouse(spark, sf_dir), *EMPTY_WINDOW)


@register("range_meta", sql(f"""
SELECT coalesce(strftime(min(d.full_date), {D}), '{WINDOW[0]}') AS range_from,
       coalesce(strftime(max(d.full_date), {D}), '{WINDOW[1]}') AS range_to
FROM fact_sales f JOIN dim_date d ON d.date_key = f.date_key WHERE {_dw(*WINDOW)}"""))
def q_range_meta(spark, sf_dir):
    return A.range_meta(warehouse(spark, sf_dir), *WINDOW)


@register("sales_by_category", sql(f"""
SELECT p.category, CAST(sum(f.revenue) AS DOUBLE) AS revenue,
       CAST(sum(f.quantity) AS BIGINT) AS units_sold,
       CAST(count(DISTINCT f.order_id) AS BIGINT) AS order_count
FROM fact_sales f JOIN dim_product p ON p.product_key = f.product_key
JOIN dim_date d ON d.date_key = f.date_key
GROUP BY p.category ORDER BY sum(f.revenue) DESC, p.category"""))
def q_sales_by_category(spark, sf_dir):
    return A.sales_by_category(warehouse(spark, sf_dir))


@register("sales_by_category_window", sql(f"""
SELECT p.category, CAST(sum(f.revenue) AS DOUBLE) AS revenue,
       CAST(sum(f.quantity) AS BIGINT) AS units_sold,
       CAST(count(DISTINCT f.order_id) AS BIGINT) AS order_count
FROM fact_sales f JOIN dim_product p ON p.product_key = f.product_key
JOIN dim_date d ON d.date_key = f.date_key
WHERE d.full_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'
GROUP BY p.category ORDER BY sum(f.revenue) DESC, p.category"""))
def q_sales_by_category_window(spark, sf_dir):
    return A.sales_by_category(warehouse(spark, sf_dir), *WINDOW)


_TOP_SQL = f"""
SELECT p.product_id, p.sku, p.name, p.category, CAST(sum(f.revenue) AS DOUBLE) AS revenue,
       CAST(sum(f.quantity) AS BIGINT) AS units_sold
FROM fact_sales f JOIN dim_product p ON p.product_key = f.product_key
JOIN dim_date d ON d.date_key = f.date_key
GROUP BY p.product_id, p.sku, p.name, p.category
ORDER BY sum(f.revenue) DESC, p.product_id LIMIT {TOP_N}"""


@register("top_products", sql(_TOP_SQL))
def q_top_products(spark, sf_dir):
    return A.top_products(warehouse(spark, sf_dir), top_n=TOP_N)


@register("top_products_ranked", sql(f"""
SELECT *, CAST(row_number() OVER (ORDER BY revenue DESC, product_id) AS BIGINT) AS rank
FROM ({_TOP_SQL}) t"""))
def q_top_products_ranked(spark, sf_dir):
    return A.top_products_ranked(warehouse(spark, sf_dir), top_n=TOP_N)


_CITY_SQL = """
SELECT c.city, c.state, CAST(sum(f.revenue) AS DOUBLE) AS revenue,
       CAST(count(DISTINCT f.order_id) AS BIGINT) AS order_count,
       CAST(count(DISTINCT f.customer_key) AS BIGINT) AS customer_count
FROM fact_sales f JOIN dim_customer c ON c.customer_key = f.customer_key
JOIN dim_date d ON d.date_key = f.date_key
GROUP BY c.city, c.state"""


@register("sales_by_city", sql(_CITY_SQL))
def q_sales_by_city(spark, sf_dir):
    return A.sales_by_city(warehouse(spark, sf_dir))


@register("top_products_until", sql(_TOP_SQL.replace(
    "GROUP BY", f"WHERE d.full_date <= DATE '{WINDOW[1]}'\nGROUP BY", 1)))
def q_top_products_until(spark, sf_dir):
    """A window without a start."""
    return A.top_products(warehouse(spark, sf_dir), None, WINDOW[1], top_n=TOP_N)


@register("sales_by_city_since", sql(_CITY_SQL.replace(
    "GROUP BY", f"WHERE f.date_key >= {WINDOW[0].replace('-', '')}\nGROUP BY", 1)))
def q_sales_by_city_since(spark, sf_dir):
    """A window without an end."""
    return A.sales_by_city(warehouse(spark, sf_dir), WINDOW[0], None)


@register("city_share_of_leader", sql(f"""
SELECT city, state, revenue,
       CAST(CASE WHEN max(revenue) OVER () > 0 THEN round(revenue / max(revenue) OVER () * 100, 0) ELSE 0 END AS BIGINT) AS share_of_leader
FROM ({_CITY_SQL}) t"""))
def q_city_share(spark, sf_dir):
    return A.city_share_of_leader(warehouse(spark, sf_dir))


def _daily_sql(lo, hi):
    return f"""
SELECT strftime(d.full_date, {D}) AS date, CAST(coalesce(sum(f.revenue), 0) AS DOUBLE) AS revenue,
       CAST(count(DISTINCT f.order_id) AS BIGINT) AS order_count,
       CAST(coalesce(sum(f.quantity), 0) AS BIGINT) AS units_sold
FROM dim_date d LEFT JOIN fact_sales f ON f.date_key = d.date_key
WHERE {_dw(lo, hi)} GROUP BY d.full_date ORDER BY d.full_date"""


@register("daily_sales", sql(_daily_sql(None, None)))
def q_daily_sales(spark, sf_dir):
    return A.daily_sales(warehouse(spark, sf_dir))


@register("daily_sales_window", sql(_daily_sql(*DAILY_WINDOW)))
def q_daily_sales_window(spark, sf_dir):
    return A.daily_sales(warehouse(spark, sf_dir), *DAILY_WINDOW)


@register("revenue_flag_window", sql(f"""
SELECT coalesce(bool_or(revenue > 0), false) AS has_revenue FROM fact_sales
WHERE {key_window(*DAILY_WINDOW)}"""))
def q_revenue_flag_window(spark, sf_dir):
    return A.revenue_flag(warehouse(spark, sf_dir), *DAILY_WINDOW)


@register("revenue_flag_empty", sql(f"""
SELECT coalesce(bool_or(revenue > 0), false) AS has_revenue FROM fact_sales
WHERE {key_window(*EMPTY_WINDOW)}"""))
def q_revenue_flag_empty(spark, sf_dir):
    return A.revenue_flag(warehouse(spark, sf_dir), *EMPTY_WINDOW)


@register("daily_aov", sql(f"""
SELECT date, {avg_money_sql('revenue', 'order_count')} AS average_order_value
FROM (SELECT strftime(d.full_date, {D}) AS date, coalesce(sum(f.revenue), 0) AS revenue,
             count(DISTINCT f.order_id) AS order_count
      FROM dim_date d LEFT JOIN fact_sales f ON f.date_key = d.date_key GROUP BY d.full_date) t"""))
def q_daily_aov(spark, sf_dir):
    return A.daily_aov(warehouse(spark, sf_dir))



# --------------------------------------------------------------------------
# Series (AGG-16/17/18/19)

_DAILY_TYPED = """
SELECT d.full_date, coalesce(sum(f.revenue), 0) AS rev, count(DISTINCT f.order_id) AS orders,
       coalesce(sum(f.quantity), 0) AS units
FROM dim_date d LEFT JOIN fact_sales f ON f.date_key = d.date_key GROUP BY d.full_date"""


def _bucket_sql(key: str) -> str:
    return sql(f"""
SELECT {key} AS date, strftime(max(full_date), {D}) AS end_date, CAST(sum(rev) AS DOUBLE) AS revenue,
       CAST(sum(orders) AS BIGINT) AS order_count, CAST(sum(units) AS BIGINT) AS units_sold
FROM ({_DAILY_TYPED}) t GROUP BY 1""")


@register("sales_weekly", _bucket_sql(f"strftime(date_trunc('week', full_date), {D})"))
def q_sales_weekly(spark, sf_dir):
    return S.sales_weekly(warehouse(spark, sf_dir))


@register("sales_monthly", _bucket_sql("strftime(full_date, '%Y-%m')"))
def q_sales_monthly(spark, sf_dir):
    return S.sales_monthly(warehouse(spark, sf_dir))


@register("sparkline", sql(f"""
SELECT CAST(bucket AS INTEGER) AS bucket,
       CAST(sum(CAST(rev * 100 AS HUGEINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 100 AS value
FROM (SELECT rev, CASE WHEN n <= 28 THEN i ELSE floor(((i + 1) * 28 - 1) / n) END AS bucket
      FROM (SELECT rev, row_number() OVER (ORDER BY full_date) - 1 AS i, count(*) OVER () AS n
            FROM ({_DAILY_TYPED}) t) u) v
GROUP BY bucket"""))
def q_sparkline(spark, sf_dir):
    return S.sparkline(warehouse(spark, sf_dir))


KPI_DAYS, KPI_TODAY = 90, "1998-06-30"


def _kpi_delta_sql() -> str:
    (cf, ct), (pf, pt) = S.preset_windows(KPI_DAYS, KPI_TODAY)

    def win(lo, hi, tag):
        return f"""{tag} AS (SELECT coalesce(sum(revenue), 0) AS rev, count(DISTINCT order_id) AS ord,
                   count(DISTINCT customer_key) AS cus, coalesce(sum(quantity), 0) AS uni
            FROM fact_sales WHERE date_key BETWEEN {lo.replace('-', '')} AND {hi.replace('-', '')})"""
    metrics = [("revenue", "CAST(c.rev AS DOUBLE)", "CAST(p.rev AS DOUBLE)"),
               ("orders", "CAST(c.ord AS DOUBLE)", "CAST(p.ord AS DOUBLE)"),
               ("customers", "CAST(c.cus AS DOUBLE)", "CAST(p.cus AS DOUBLE)"),
               ("units", "CAST(c.uni AS DOUBLE)", "CAST(p.uni AS DOUBLE)"),
               ("average_order_value", avg_money_sql("c.rev", "c.ord"), avg_money_sql("p.rev", "p.ord"))]
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {cur} AS current, {prev} AS previous FROM cur c, prev p"
        for m, cur, prev in metrics)
    return sql(f"""
SELECT metric, current, previous, CASE WHEN previous <> 0 THEN (current - previous) / previous END AS delta,
       CASE WHEN previous = 0 THEN NULL WHEN (current - previous) / previous > 0.0005 THEN 'up'
            WHEN (current - previous) / previous < -0.0005 THEN 'down' ELSE 'flat' END AS direction,
       '{cf}' AS current_from, '{ct}' AS current_to, '{pf}' AS previous_from, '{pt}' AS previous_to
FROM ({rows}) m""", win(cf, ct, "cur"), win(pf, pt, "prev"))


@register("kpi_delta", _kpi_delta_sql())
def q_kpi_delta(spark, sf_dir):
    return S.kpi_delta(warehouse(spark, sf_dir), KPI_DAYS, KPI_TODAY)


# --------------------------------------------------------------------------
# Operational reads (FLT-3/4/5/6/8, JN-9/10, AGG-13/14/20/26, SRT-2/3/4/9)

PAGE = dict(limit=50, offset=100)
PRODUCT_FILTER = dict(category="PROMO", active=True, limit=50, offset=0)
ORDER_FILTER = dict(status="delivered", from_="1997-01-01", to="1997-12-31", limit=50, offset=50)
ORDER_ID = "7"
SEARCH = "nation_1"
AS_OF = "2000-01-01"


def _raw(spark, sf_dir):
    return testdata.snapshot(spark, sf_dir)


def _flat_orders(df):
    return df.select("id", "customer_id", "customer_name", "status", "order_date",
                     "item_count", "total",
                     F.array_join(F.transform("items", lambda x: x["id"]), ",").alias("item_ids"))


@register("customers_page", sql(f"""
SELECT id, name, email, city, state, strftime(created_at, {TS}) AS created_at FROM stg_customers
ORDER BY created_at DESC, id LIMIT {PAGE['limit']} OFFSET {PAGE['offset']}"""))
def q_customers_page(spark, sf_dir):
    return O.customers_page(_raw(spark, sf_dir)["customers"], **PAGE)


@register("products_page", sql(f"""
SELECT id, sku, name, category, CAST(unit_price AS DOUBLE) AS unit_price, active,
       strftime(created_at, {TS}) AS created_at
FROM stg_products WHERE category = 'PROMO' AND active
ORDER BY created_at DESC, id LIMIT 50 OFFSET 0"""))
def q_products_page(spark, sf_dir):
    return O.products_page(_raw(spark, sf_dir)["products"], **PRODUCT_FILTER)


_ORDERS_FILTER_SQL = ("o.status = 'delivered' AND o.order_date >= DATE '1997-01-01' "
                      "AND o.order_date <= DATE '1997-12-31'")

_NESTED_SQL = """
SELECT p.id, p.customer_id, c.name AS customer_name, p.status, strftime(p.order_date, '%Y-%m-%d') AS order_date,
       CAST(coalesce(l.item_count, 0) AS BIGINT) AS item_count, CAST(coalesce(l.total, 0) AS DOUBLE) AS total,
       coalesce(l.item_ids, '') AS item_ids
FROM page p LEFT JOIN stg_customers c ON c.id = p.customer_id
LEFT JOIN (SELECT i.order_id, count(*) AS item_count, sum(i.quantity * i.unit_price_at_sale) AS total,
                  string_agg(i.id, ',' ORDER BY pr.name, i.id) AS item_ids
           FROM stg_order_items i LEFT JOIN stg_products pr ON pr.id = i.product_id
           WHERE i.order_id IN (SELECT id FROM page) GROUP BY i.order_id) l ON l.order_id = p.id"""


@register("orders_page", sql(_NESTED_SQL, f"""page AS (SELECT * FROM stg_orders o WHERE {_ORDERS_FILTER_SQL}
  ORDER BY o.order_date DESC, o.created_at DESC, o.id LIMIT 50 OFFSET 50)"""))
def q_orders_page(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return _flat_orders(O.orders_page(r["orders"], r["customers"], r["order_items"],
                                      r["products"], **ORDER_FILTER))


@register("order_by_id", sql(_NESTED_SQL, f"page AS (SELECT * FROM stg_orders WHERE id = '{ORDER_ID}')"))
def q_order_by_id(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return _flat_orders(O.order_by_id(r["orders"], r["customers"], r["order_items"],
                                      r["products"], ORDER_ID))


LOOKUP_ID = "7"


@register("customer_by_id", sql(f"""
SELECT id, name, email, city, state, strftime(created_at, {TS}) AS created_at FROM stg_customers WHERE id = '{LOOKUP_ID}'"""))
def q_customer_by_id(spark, sf_dir):
    return O.by_id(_raw(spark, sf_dir)["customers"], LOOKUP_ID)


@register("product_by_id", sql(f"""
SELECT id, sku, name, category, CAST(unit_price AS DOUBLE) AS unit_price, active,
       strftime(created_at, {TS}) AS created_at FROM stg_products WHERE id = '{LOOKUP_ID}'"""))
def q_product_by_id(spark, sf_dir):
    return O.by_id(_raw(spark, sf_dir)["products"], LOOKUP_ID)


@register("page_totals", sql(f"""
SELECT listing, total, CAST(l AS BIGINT) AS "limit", CAST(o AS BIGINT) AS "offset",
       CAST(CASE WHEN total > o THEN o + 1 ELSE 0 END AS BIGINT) AS first_row,
       CAST(least(total, o + l) AS BIGINT) AS last_row, CAST(o // l + 1 AS BIGINT) AS page,
       CAST(ceil(total / l) AS BIGINT) AS page_count
FROM (SELECT 'customers' AS listing, count(*) AS total, 50 AS l, 100 AS o FROM stg_customers
      UNION ALL SELECT 'products', count(*), 50, 0 FROM stg_products WHERE category = 'PROMO' AND active
      UNION ALL SELECT 'orders', count(*), 50, 50 FROM stg_orders o WHERE {_ORDERS_FILTER_SQL}) t"""))
def q_page_totals(spark, sf_dir):
    r = _raw(spark, sf_dir)
    pf = {k: v for k, v in PRODUCT_FILTER.items() if k in ("category", "active")}
    of = {k: v for k, v in ORDER_FILTER.items() if k not in ("limit", "offset")}
    return (O.page_total(r["customers"], "customers", PAGE["limit"], PAGE["offset"])
            .unionByName(O.page_total(O.filter_products(r["products"], **pf), "products",
                                      PRODUCT_FILTER["limit"], PRODUCT_FILTER["offset"]))
            .unionByName(O.page_total(O.filter_orders(r["orders"], **of), "orders",
                                      ORDER_FILTER["limit"], ORDER_FILTER["offset"])))


@register("order_lines", sql("""
SELECT i.id, i.order_id, i.product_id, p.name AS product_name, i.quantity,
       CAST(i.unit_price_at_sale AS DOUBLE) AS unit_price_at_sale,
       CAST(i.quantity * i.unit_price_at_sale AS DOUBLE) AS line_total
FROM stg_order_items i LEFT JOIN stg_products p ON p.id = i.product_id"""))
def q_order_lines(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return O.order_lines(r["order_items"], r["products"])


@register("order_totals", sql("""
SELECT o.id AS order_id, CAST(coalesce(sum(i.quantity * i.unit_price_at_sale), 0) AS DOUBLE) AS total,
       CAST(count(i.id) AS BIGINT) AS item_count
FROM stg_orders o LEFT JOIN stg_order_items i ON i.order_id = o.id GROUP BY o.id"""))
def q_order_totals(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return O.order_totals(r["orders"], r["order_items"])


@register("customer_search", sql(f"""
SELECT id, name, email, city, state, strftime(created_at, {TS}) AS created_at FROM stg_customers
WHERE contains(lower(name), '{SEARCH}') OR contains(lower(email), '{SEARCH}') OR contains(lower(city), '{SEARCH}')
ORDER BY created_at DESC, id LIMIT 200"""))
def q_customer_search(spark, sf_dir):
    return O.customer_search(_raw(spark, sf_dir)["customers"], SEARCH)


@register("product_categories", sql("SELECT DISTINCT category FROM stg_products"))
def q_product_categories(spark, sf_dir):
    return O.product_categories(_raw(spark, sf_dir)["products"])


@register("order_estimate", sql("""
SELECT i.order_id AS order_ref, CAST(coalesce(sum(i.quantity * coalesce(p.unit_price, 0)), 0) AS DOUBLE) AS estimated_total,
       CAST(coalesce(sum(i.quantity), 0) AS BIGINT) AS units
FROM stg_order_items i LEFT JOIN stg_products p ON p.id = i.product_id GROUP BY i.order_id"""))
def q_order_estimate(spark, sf_dir):
    r = _raw(spark, sf_dir)
    lines = r["order_items"].select(F.col("order_id").alias("order_ref"), "product_id", "quantity")
    return O.order_estimate(lines, r["products"])


# --------------------------------------------------------------------------
# Extract integrity (SRC-2, JN-7, FLT-9, AGG-9, AGG-25, SNK-5, SNK-7)

@register("schema_violations", sql("""
SELECT 'customers' AS "table", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE id IS NULL OR name IS NULL OR email IS NULL OR city IS NULL OR state IS NULL OR created_at IS NULL) AS BIGINT) AS null_rows FROM stg_customers
UNION ALL SELECT 'products', count(*), count(*) FILTER (WHERE id IS NULL OR sku IS NULL OR name IS NULL OR category IS NULL OR unit_price IS NULL OR active IS NULL OR created_at IS NULL) FROM stg_products
UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE id IS NULL OR customer_id IS NULL OR status IS NULL OR order_date IS NULL OR created_at IS NULL) FROM stg_orders
UNION ALL SELECT 'order_items', count(*), count(*) FILTER (WHERE id IS NULL OR order_id IS NULL OR product_id IS NULL OR quantity IS NULL OR unit_price_at_sale IS NULL) FROM stg_order_items"""))
def q_schema_violations(spark, sf_dir):
    return I.schema_violations(_raw(spark, sf_dir))


@register("orphans", sql("""
SELECT 'order_customer' AS "check", CAST(count(*) AS BIGINT) AS affected FROM stg_orders o WHERE NOT EXISTS (SELECT 1 FROM stg_customers c WHERE c.id = o.customer_id)
UNION ALL SELECT 'item_order', count(*) FROM stg_order_items i WHERE NOT EXISTS (SELECT 1 FROM stg_orders o WHERE o.id = i.order_id)
UNION ALL SELECT 'item_product', count(*) FROM stg_order_items i WHERE NOT EXISTS (SELECT 1 FROM stg_products p WHERE p.id = i.product_id)"""))
def q_orphans(spark, sf_dir):
    return I.orphans(_raw(spark, sf_dir))


_NULLS_SQL = "".join(
    f"SELECT 'nulls_in_{t}' AS \"check\", CAST(count(*) FILTER (WHERE {' OR '.join(f.name + ' IS NULL' for f in RAW[t].fields)}) AS BIGINT) AS affected FROM stg_{t}\nUNION ALL "
    for t in RAW)


@register("extract_gate", sql(_NULLS_SQL + """
SELECT 'order_customer', CAST(count(*) AS BIGINT) FROM stg_orders o LEFT JOIN stg_customers c ON c.id = o.customer_id WHERE c.id IS NULL
UNION ALL SELECT 'item_order', count(*) FROM stg_order_items i LEFT JOIN stg_orders o ON o.id = i.order_id WHERE o.id IS NULL
UNION ALL SELECT 'item_product', count(*) FROM stg_order_items i LEFT JOIN stg_products p ON p.id = i.product_id WHERE p.id IS NULL"""))
def q_extract_gate(spark, sf_dir):
    return I.extract_gate(_raw(spark, sf_dir))


_EMAIL_RE = EMAIL_PATTERN.replace("'", "''")


@register("constraint_violations", sql(f"""
SELECT "constraint", CAST(affected AS BIGINT) AS affected FROM (
SELECT 'customers_name_not_blank' AS "constraint", count(*) FILTER (WHERE trim(name) = '') AS affected FROM stg_customers
UNION ALL SELECT 'customers_city_not_blank', count(*) FILTER (WHERE trim(city) = '') FROM stg_customers
UNION ALL SELECT 'customers_state_not_blank', count(*) FILTER (WHERE trim(state) = '') FROM stg_customers
UNION ALL SELECT 'customers_email_shape', count(*) FILTER (WHERE NOT regexp_matches(email, '{_EMAIL_RE}')) FROM stg_customers
UNION ALL SELECT 'customers_email_length', count(*) FILTER (WHERE length(email) > 200) FROM stg_customers
UNION ALL SELECT 'products_sku_not_blank', count(*) FILTER (WHERE trim(sku) = '') FROM stg_products
UNION ALL SELECT 'products_name_not_blank', count(*) FILTER (WHERE trim(name) = '') FROM stg_products
UNION ALL SELECT 'products_category_not_blank', count(*) FILTER (WHERE trim(category) = '') FROM stg_products
UNION ALL SELECT 'products_price_non_negative', count(*) FILTER (WHERE unit_price < 0) FROM stg_products
UNION ALL SELECT 'orders_status_known', count(*) FILTER (WHERE status NOT IN ('pending','confirmed','shipped','delivered','cancelled')) FROM stg_orders
UNION ALL SELECT 'order_items_quantity_positive', count(*) FILTER (WHERE quantity <= 0) FROM stg_order_items
UNION ALL SELECT 'order_items_price_non_negative', count(*) FILTER (WHERE unit_price_at_sale < 0) FROM stg_order_items) t"""))
def q_constraint_violations(spark, sf_dir):
    return I.constraint_violations(_raw(spark, sf_dir))


@register("row_counts", sql("""
SELECT 'customers' AS "table", CAST(count(*) AS BIGINT) AS rows FROM stg_customers
UNION ALL SELECT 'products', count(*) FROM stg_products
UNION ALL SELECT 'orders', count(*) FROM stg_orders
UNION ALL SELECT 'order_items', count(*) FROM stg_order_items
UNION ALL SELECT 'dim_customer', count(*) FROM dim_customer
UNION ALL SELECT 'dim_product', count(*) FROM dim_product
UNION ALL SELECT 'dim_date', count(*) FROM dim_date
UNION ALL SELECT 'fact_sales', count(*) FROM fact_sales"""))
def q_row_counts(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    tables = dict(_raw(spark, sf_dir))
    tables.update({t: getattr(wh, t) for t in ("dim_customer", "dim_product", "dim_date",
                                               "fact_sales")})
    return I.row_counts(tables)


@register("manifest_row_counts", sql("""
SELECT 'customers' AS "table", CAST(count(*) AS BIGINT) AS row_count FROM stg_customers
UNION ALL SELECT 'products', count(*) FROM stg_products
UNION ALL SELECT 'orders', count(*) FROM stg_orders
UNION ALL SELECT 'order_items', count(*) FROM stg_order_items"""))
def q_manifest_row_counts(spark, sf_dir):
    """Row counts per table as recorded, file by file, in the lake manifest."""
    from ..sources import lake
    wh = warehouse(spark, sf_dir)
    prefix = wh.metadata.where(F.col("key") == "lake_prefix").select("value").first()[0]
    return (lake.manifest_entries(spark, prefix)
            .groupBy("table").agg(F.sum("row_count").cast("long").alias("row_count")))


# --------------------------------------------------------------------------
# Dataset validation and statistics (§2.12, AGG-22)

VALIDATION_END = "2000-12-31"

_DATASET = """
ds_products AS (SELECT s.id, s.sku, s.name, s.category, p.p_retailprice AS unit_price, s.active
                FROM stg_products s JOIN part p ON CAST(p.p_partkey AS VARCHAR) = s.id),
ds_items AS (SELECT id, order_id, product_id, quantity, l_extendedprice AS unit_price_at_sale
             FROM (SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                          CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS id,
                          CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
                          CAST(trunc(l_quantity) AS INTEGER) AS quantity, l_extendedprice FROM lineitem) x),
ds_orders AS (SELECT id, customer_id, status, strftime(order_date, '%Y-%m-%d') AS order_date FROM stg_orders)"""

_UUID = UUID_V4_PATTERN
_MONEY_OK = "({v} IS NOT NULL AND {v} >= 0 AND {v} <= 9999999999.99 AND regexp_full_match(CAST({v} AS VARCHAR), '[0-9]+([.][0-9]{{1,2}})?'))"


def _dup_sql(expr: str, table: str) -> str:
    return f"(SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM {table} GROUP BY {expr}) d)"


@register("validation_report", sql(f"""
SELECT rule, CAST(affected AS BIGINT) AS affected FROM (
SELECT 'requested_customer_count' AS rule, CASE WHEN (SELECT count(*) FROM stg_customers) <> (SELECT count(*) FROM customer) THEN 1 ELSE 0 END AS affected
UNION ALL SELECT 'requested_product_count', CASE WHEN (SELECT count(*) FROM ds_products) <> (SELECT count(*) FROM part) THEN 1 ELSE 0 END
UNION ALL SELECT 'requested_order_count', CASE WHEN (SELECT count(*) FROM ds_orders) <> (SELECT count(*) FROM orders) THEN 1 ELSE 0 END
UNION ALL SELECT 'unique_customer_id', {_dup_sql('id', 'stg_customers')}
UNION ALL SELECT 'unique_product_id', {_dup_sql('id', 'ds_products')}
UNION ALL SELECT 'unique_order_id', {_dup_sql('id', 'ds_orders')}
UNION ALL SELECT 'unique_order_item_id', {_dup_sql('id', 'ds_items')}
UNION ALL SELECT 'uuid_v4_shape', (SELECT count(*) FILTER (WHERE NOT regexp_matches(id, '{_UUID}')) FROM stg_customers)
   + (SELECT count(*) FILTER (WHERE NOT regexp_matches(id, '{_UUID}')) FROM ds_products)
   + (SELECT count(*) FILTER (WHERE NOT regexp_matches(id, '{_UUID}')) FROM ds_orders)
   + (SELECT count(*) FILTER (WHERE NOT regexp_matches(id, '{_UUID}')) FROM ds_items)
UNION ALL SELECT 'unique_customer_email', {_dup_sql('lower(email)', 'stg_customers')}
UNION ALL SELECT 'unique_product_sku', {_dup_sql('sku', 'ds_products')}
UNION ALL SELECT 'order_customer_exists', (SELECT count(*) FROM ds_orders o WHERE NOT EXISTS (SELECT 1 FROM stg_customers c WHERE c.id = o.customer_id))
UNION ALL SELECT 'order_item_order_exists', (SELECT count(*) FROM ds_items i WHERE NOT EXISTS (SELECT 1 FROM ds_orders o WHERE o.id = i.order_id))
UNION ALL SELECT 'order_item_product_exists', (SELECT count(*) FROM ds_items i WHERE NOT EXISTS (SELECT 1 FROM ds_products p WHERE p.id = i.product_id))
UNION ALL SELECT 'customer_email_shape', (SELECT count(*) FILTER (WHERE NOT regexp_matches(email, '{_EMAIL_RE}')) FROM stg_customers)
UNION ALL SELECT 'blank_text', (SELECT count(*) FILTER (WHERE trim(name) = '') + count(*) FILTER (WHERE trim(city) = '') + count(*) FILTER (WHERE trim(state) = '') FROM stg_customers)
   + (SELECT count(*) FILTER (WHERE trim(sku) = '') + count(*) FILTER (WHERE trim(name) = '') + count(*) FILTER (WHERE trim(category) = '') FROM ds_products)
UNION ALL SELECT 'money_scale', (SELECT count(*) FILTER (WHERE NOT {_MONEY_OK.format(v='unit_price')}) FROM ds_products)
   + (SELECT count(*) FILTER (WHERE NOT {_MONEY_OK.format(v='unit_price_at_sale')}) FROM ds_items)
UNION ALL SELECT 'quantity_positive', (SELECT count(*) FILTER (WHERE quantity IS NULL OR quantity < 1) FROM ds_items)
UNION ALL SELECT 'order_status_known', (SELECT count(*) FILTER (WHERE status IS NULL OR status NOT IN ('pending','confirmed','shipped','delivered','cancelled')) FROM ds_orders)
UNION ALL SELECT 'order_date_shape', (SELECT count(*) FILTER (WHERE order_date IS NULL OR NOT regexp_matches(order_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')) FROM ds_orders)
UNION ALL SELECT 'one_line_per_product', {_dup_sql('order_id, product_id', 'ds_items')}
UNION ALL SELECT 'order_has_items', (SELECT count(*) FROM ds_orders o WHERE NOT EXISTS (SELECT 1 FROM ds_items i WHERE i.order_id = o.id))
UNION ALL SELECT 'active_products_only', (SELECT count(*) FROM ds_items i WHERE i.product_id IN (SELECT id FROM ds_products WHERE NOT active))
UNION ALL SELECT 'order_date_within_window', (SELECT count(*) FILTER (WHERE order_date > '{VALIDATION_END}') FROM ds_orders)
) t""", _DATASET))
def q_validation_report(spark, sf_dir):
    return V.validation_report(testdata.dataset(spark, sf_dir),
                               testdata.requested_counts(spark, sf_dir),
                               VALIDATION_END).select("rule", "affected")


def _round_div_sql(num: str, den: str, scale: int) -> str:
    n = f"CAST(({num}) * {10 ** scale} AS HUGEINT)"
    d = f"CAST(({den}) AS HUGEINT)"
    return (f"CASE WHEN ({den}) > 0 THEN CAST({n} // {d} + CASE WHEN 2 * ({n} % {d}) >= {d} "
            f"THEN 1 ELSE 0 END AS DOUBLE) / {10 ** scale} ELSE 0.0 END")


@register("dataset_statistics", sql(f"""
SELECT CAST(cs.customers AS BIGINT) AS customers, CAST(ps.products AS BIGINT) AS products,
       CAST(ps.active_products AS BIGINT) AS active_products, CAST(os.orders AS BIGINT) AS orders,
       CAST(its.order_items AS BIGINT) AS order_items, CAST(cs.cities_covered AS BIGINT) AS cities_covered,
       CAST(ps.categories_covered AS BIGINT) AS categories_covered,
       CAST(os.distinct_order_days AS BIGINT) AS distinct_order_days,
       os.first_order_date, os.last_order_date,
       CAST(its.rev_cents AS DOUBLE) / 100 AS total_revenue,
       {_round_div_sql('its.rev_cents', 'pay.paying', 0)} / 100 AS average_order_value,
       {_round_div_sql('its.order_items', 'pay.paying', 2)} AS average_items_per_order,
       CAST(wo.n AS BIGINT) AS orders_without_items, CAST(cwo.n AS BIGINT) AS customers_with_orders,
       {_round_div_sql('its.discounted', 'its.order_items', 3)} AS discounted_line_share
FROM (SELECT count(*) AS customers, count(DISTINCT city) AS cities_covered FROM stg_customers) cs,
     (SELECT count(*) AS products, count(*) FILTER (WHERE active) AS active_products,
             count(DISTINCT category) AS categories_covered FROM ds_products) ps,
     (SELECT count(*) AS orders, count(DISTINCT order_date) AS distinct_order_days,
             coalesce(min(order_date), '{VALIDATION_END}') AS first_order_date,
             coalesce(max(order_date), '{VALIDATION_END}') AS last_order_date FROM ds_orders) os,
     (SELECT count(*) AS order_items,
             coalesce(sum(CAST(CAST(round(i.unit_price_at_sale * 100) AS BIGINT) * i.quantity AS HUGEINT)), 0) AS rev_cents,
             count(*) FILTER (WHERE p.unit_price IS NULL OR p.unit_price <> i.unit_price_at_sale) AS discounted
      FROM ds_items i LEFT JOIN ds_products p ON p.id = i.product_id) its,
     (SELECT count(DISTINCT order_id) AS paying FROM ds_items) pay,
     (SELECT count(*) AS n FROM ds_orders o WHERE NOT EXISTS (SELECT 1 FROM ds_items i WHERE i.order_id = o.id)) wo,
     (SELECT count(DISTINCT customer_id) AS n FROM ds_orders) cwo""", _DATASET))
def q_dataset_statistics(spark, sf_dir):
    return V.dataset_statistics(testdata.dataset(spark, sf_dir), VALIDATION_END)


# --------------------------------------------------------------------------
# Shape analytics (AGG-23/24, WIN-7)

STATUS_AS_OF = "2001-08-01"


@register("revenue_by_month", sql("""
SELECT month, CAST(rev AS DOUBLE) AS revenue, rev = max(rev) OVER () AS is_peak, rev = min(rev) OVER () AS is_trough
FROM (SELECT printf('%04d-%02d', (date_key // 100) // 100, (date_key // 100) % 100) AS month, sum(revenue) AS rev
      FROM fact_sales GROUP BY 1) t"""))
def q_revenue_by_month(spark, sf_dir):
    return SH.revenue_by_month(warehouse(spark, sf_dir))


@register("category_share", sql("""
SELECT category, CAST(rev AS DOUBLE) AS revenue,
       CASE WHEN total > 0 THEN CAST(rev AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS share
FROM (SELECT p.category, sum(f.revenue) AS rev, sum(sum(f.revenue)) OVER () AS total
      FROM fact_sales f JOIN dim_product p ON p.product_key = f.product_key GROUP BY p.category) t"""))
def q_category_share(spark, sf_dir):
    return SH.category_share(warehouse(spark, sf_dir))


@register("lines_per_order", sql("""
SELECT CAST(lines AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS orders
FROM (SELECT o.id, count(i.id) AS lines FROM stg_orders o LEFT JOIN stg_order_items i ON i.order_id = o.id GROUP BY o.id) t
GROUP BY lines"""))
def q_lines_per_order(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return SH.lines_per_order(r["orders"], r["order_items"])


@register("status_by_age", sql(f"""
SELECT age_bucket, status, CAST(n AS BIGINT) AS orders,
       CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY age_bucket) AS DOUBLE) AS share
FROM (SELECT CASE WHEN date_diff('day', order_date, DATE '{STATUS_AS_OF}') <= 21 THEN 'recent' ELSE 'settled' END AS age_bucket,
             status, count(*) AS n FROM stg_orders GROUP BY 1, 2) t"""))
def q_status_by_age(spark, sf_dir):
    return SH.status_by_age(_raw(spark, sf_dir)["orders"], STATUS_AS_OF)


@register("loyal_share", sql("""
SELECT CAST(count(*) AS BIGINT) AS customers_with_orders, CAST(max(k) AS BIGINT) AS top_customers,
       CAST(sum(n) FILTER (WHERE rk <= k) AS BIGINT) AS top_orders, CAST(sum(n) AS BIGINT) AS orders,
       CAST(sum(n) FILTER (WHERE rk <= k) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS share
FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS rk, floor(count(*) OVER () * 0.2 + 0.5) AS k
      FROM (SELECT customer_id, count(*) AS n FROM stg_orders GROUP BY customer_id) pc) r"""))
def q_loyal_share(spark, sf_dir):
    return SH.loyal_share(_raw(spark, sf_dir)["orders"])


@register("category_revenue_positive", sql("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT c.city FROM fact_sales f JOIN dim_customer c ON c.customer_key = f.customer_key GROUP BY c.city HAVING sum(f.revenue) > 0) a) AS cities_with_revenue,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT p.category FROM fact_sales f JOIN dim_product p ON p.product_key = f.product_key GROUP BY p.category HAVING sum(f.revenue) > 0) b) AS categories_with_revenue"""))
def q_category_revenue_positive(spark, sf_dir):
    return SH.category_revenue_positive(warehouse(spark, sf_dir))


# --------------------------------------------------------------------------
# Intake (§2.13): the source orders re-proposed as an intake batch

def proposals(spark, sf_dir):
    """Headers and lines of a proposed batch derived from the source orders:
    cancelled orders come without date and status (defaults apply); every
    second line omits its price (catalogue price applies)."""
    from ..functions.keys import position_within
    r = _raw(spark, sf_dir)
    o = r["orders"]
    cancelled = F.col("status") == "cancelled"
    headers = o.select(F.col("id").alias("order_ref"), "customer_id",
                       F.when(~cancelled, F.col("order_date")).alias("order_date"),
                       F.when(~cancelled, F.col("status")).alias("status"))
    items = position_within(r["order_items"].select(
        "id", "order_id", "product_id", "quantity", "unit_price_at_sale"),
        "order_id", "id", "position")
    lines = items.select(
        F.col("order_id").alias("order_ref"), "position", "product_id",
        "quantity", "unit_price_at_sale").withColumn(
        "unit_price_at_sale", F.when(F.col("position") % 2 == 0, F.col("unit_price_at_sale")))
    return headers, lines, r


_PROPOSALS = """
headers AS (SELECT id AS order_ref, customer_id, CASE WHEN status <> 'cancelled' THEN order_date END AS order_date,
                   CASE WHEN status <> 'cancelled' THEN status END AS status FROM stg_orders),
lines0 AS (SELECT order_id AS order_ref, CAST(row_number() OVER (PARTITION BY order_id ORDER BY id) - 1 AS INTEGER) AS position,
                  product_id, quantity, unit_price_at_sale FROM stg_order_items),
lines AS (SELECT order_ref, position, product_id, quantity,
                 CASE WHEN position % 2 = 0 THEN unit_price_at_sale END AS unit_price_at_sale FROM lines0)"""

_MERGED = """
mlines AS (SELECT order_ref, product_id, min(position) AS position, CAST(least(sum(quantity), 1000) AS INTEGER) AS quantity,
                  arg_min(unit_price_at_sale, position) FILTER (WHERE unit_price_at_sale IS NOT NULL) AS unit_price_at_sale,
                  greatest(sum(quantity) - 1000, 0) AS clipped, count(DISTINCT unit_price_at_sale) > 1 AS conflict
           FROM lines GROUP BY order_ref, product_id)"""


def _intake_sql(lines_table: str) -> str:
    return f"""
SELECT h.order_ref, h.customer_id, strftime(coalesce(h.order_date, DATE '{AS_OF}'), '%Y-%m-%d') AS order_date,
       coalesce(h.status, 'pending') AS status, CAST(coalesce(a.line_count, 0) AS BIGINT) AS line_count,
       CAST(coalesce(a.units, 0) AS BIGINT) AS units,
       CASE WHEN a.missing = 0 THEN CAST(a.total AS DOUBLE) END AS total,
       concat_ws(',', CASE WHEN c.id IS NULL THEN 'customer_not_found' END,
                      CASE WHEN coalesce(a.missing, 0) > 0 THEN 'product_not_found' END,
                      CASE WHEN coalesce(a.inactive, 0) > 0 THEN 'product_inactive' END,
                      CASE WHEN coalesce(h.order_date, DATE '{AS_OF}') > DATE '{AS_OF}' THEN 'future_date' END,
                      CASE WHEN coalesce(h.status, 'pending') NOT IN ('pending','confirmed','shipped','delivered','cancelled') THEN 'unknown_status' END,
                      CASE WHEN coalesce(a.line_count, 0) NOT BETWEEN 1 AND 50 THEN 'line_count' END,
                      CASE WHEN coalesce(a.bad_qty, 0) > 0 THEN 'quantity_out_of_range' END,
                      CASE WHEN r.first_repeat IS NOT NULL THEN 'repeated_product' END) AS issues,
       CAST(r.first_repeat AS DOUBLE) AS first_repeat, CAST(r.repeat_of AS DOUBLE) AS repeat_of
FROM headers h
LEFT JOIN stg_customers c ON c.id = h.customer_id
LEFT JOIN (SELECT l.order_ref, count(*) AS line_count, count(*) FILTER (WHERE p.id IS NULL) AS missing,
                  count(*) FILTER (WHERE p.active = FALSE) AS inactive,
                  count(*) FILTER (WHERE l.quantity IS NULL OR l.quantity NOT BETWEEN 1 AND 1000) AS bad_qty,
                  sum(l.quantity) AS units, sum(l.quantity * coalesce(l.unit_price_at_sale, p.unit_price)) AS total
           FROM {lines_table} l LEFT JOIN stg_products p ON p.id = l.product_id GROUP BY l.order_ref) a ON a.order_ref = h.order_ref
LEFT JOIN (SELECT l.order_ref, min(l.position) AS first_repeat, arg_min(f.first_pos, l.position) AS repeat_of
           FROM {lines_table} l JOIN (SELECT order_ref, product_id, min(position) AS first_pos FROM {lines_table} GROUP BY 1, 2) f
             ON f.order_ref = l.order_ref AND f.product_id = l.product_id
           WHERE l.position > f.first_pos GROUP BY l.order_ref) r ON r.order_ref = h.order_ref"""


def _intake_out(df):
    """Line positions are null for orders without a repeat; they leave as
    double so both engines carry the null the same way (NaN), not as a
    nullable integer that one side renders as float and the other as int."""
    return (df.withColumn("first_repeat", F.col("first_repeat").cast("double"))
            .withColumn("repeat_of", F.col("repeat_of").cast("double")))


@register("order_intake", sql(f"SELECT *, issues = '' AS accepted FROM ({_intake_sql('lines')}) t", _PROPOSALS))
def q_order_intake(spark, sf_dir):
    headers, lines, r = proposals(spark, sf_dir)
    return _intake_out(N.order_intake(headers, lines, r["customers"], r["products"], AS_OF))


@register("order_intake_merged", sql(f"""SELECT t.*, issues = '' AS accepted, CAST(coalesce(m.clipped, 0) AS BIGINT) AS clipped_units,
       CAST(coalesce(m.conflicts, 0) AS BIGINT) AS price_conflicts
FROM ({_intake_sql('mlines')}) t
LEFT JOIN (SELECT order_ref, sum(clipped) AS clipped, count(*) FILTER (WHERE conflict) AS conflicts FROM mlines GROUP BY order_ref) m USING (order_ref)""",
                                     _PROPOSALS, _MERGED))
def q_order_intake_merged(spark, sf_dir):
    headers, lines, r = proposals(spark, sf_dir)
    return _intake_out(N.order_intake(headers, lines, r["customers"], r["products"], AS_OF,
                                      on_repeat="merge"))


@register("catalogue_intake", sql("""
SELECT ref, name, email, city, state,
       concat_ws(',', CASE WHEN name IS NULL OR length(name) NOT BETWEEN 1 AND 120 THEN 'invalid_name' END,
                      CASE WHEN email IS NULL OR NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') OR length(email) > 200 THEN 'invalid_email' END,
                      CASE WHEN city IS NULL OR length(city) NOT BETWEEN 1 AND 80 THEN 'invalid_city' END,
                      CASE WHEN state IS NULL OR length(state) NOT BETWEEN 1 AND 80 THEN 'invalid_state' END,
                      CASE WHEN taken OR cnt > 1 THEN 'email_conflict' END) AS issues
FROM (SELECT p.*, EXISTS (SELECT 1 FROM stg_customers c WHERE lower(c.email) = p.email) AS taken,
             count(*) OVER (PARTITION BY p.email) AS cnt
      FROM (SELECT CAST(s.s_suppkey AS VARCHAR) AS ref, trim(' ' || s.s_name || ' ') AS name,
                   lower(trim('C' || CAST(s.s_suppkey * 37 AS VARCHAR) || '@Example.com')) AS email,
                   trim(n.n_name) AS city, trim(r.r_name) AS state
            FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey) p) q"""))
def q_catalogue_intake(spark, sf_dir):
    return N.customer_intake(supplier_customers(spark, sf_dir), _raw(spark, sf_dir)["customers"]).drop("accepted")


def supplier_customers(spark, sf_dir):
    """Suppliers proposed as new customers (e-mail derived from the supplier
    key, so some collide with existing customers)."""
    s = testdata.read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = testdata.read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = testdata.read(spark, sf_dir, "region", "r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey)
    return s.join(geo, s.s_nationkey == geo.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("ref"),
        F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("name"),
        F.concat(F.lit("C"), (F.col("s_suppkey") * 37).cast("string"), F.lit("@Example.com"))
        .alias("email"),
        F.col("n_name").alias("city"), F.col("r_name").alias("state"))


@register("product_intake", sql("""
SELECT ref, sku, name, category, CAST(CAST(unit_price AS DECIMAL(12,2)) AS DOUBLE) AS unit_price, active,
       concat_ws(',', CASE WHEN sku IS NULL OR length(sku) NOT BETWEEN 1 AND 40 THEN 'invalid_sku' END,
                      CASE WHEN name IS NULL OR length(name) NOT BETWEEN 1 AND 160 THEN 'invalid_name' END,
                      CASE WHEN category IS NULL OR length(category) NOT BETWEEN 1 AND 80 THEN 'invalid_category' END,
                      CASE WHEN NOT regexp_full_match(CAST(unit_price AS VARCHAR), '[0-9]+([.][0-9]{1,2}0*)?') THEN 'invalid_price' END,
                      CASE WHEN EXISTS (SELECT 1 FROM stg_products s WHERE s.sku = q.sku) OR cnt > 1 THEN 'sku_conflict' END) AS issues
FROM (SELECT t.*, count(*) OVER (PARTITION BY sku) AS cnt FROM (
      SELECT CAST(p_partkey AS VARCHAR) AS ref, 'SKU-' || CAST((p_partkey * 3) // 2 AS VARCHAR) AS sku, trim(p_name) AS name, p_type AS category,
             CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(14,4)) + CASE WHEN p_partkey % 7 = 0 THEN 0.001 ELSE 0 END AS unit_price,
             p_size > 4 AS active FROM part) t) q"""))
def q_product_intake(spark, sf_dir):
    """Parts proposed as new products: sku numbers move by half, so some meet
    the catalogue, and every seventh price has a third decimal place."""
    p = testdata.read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_retailprice", "p_size")
    price = (F.col("p_retailprice").cast("decimal(12,2)").cast("decimal(14,4)")
             + F.when(F.col("p_partkey") % 7 == 0, F.lit("0.001")).otherwise(F.lit("0")).cast("decimal(4,3)"))
    proposed = p.select(
        F.col("p_partkey").cast("string").alias("ref"),
        F.concat(F.lit("SKU-"), F.expr("(p_partkey * 3) div 2").cast("string")).alias("sku"),
        F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        price.alias("unit_price"), (F.col("p_size") > 4).alias("active"))
    return N.product_intake(proposed, _raw(spark, sf_dir)["products"]).drop("accepted")


# --------------------------------------------------------------------------
# Redaction (§2.10) over whole document texts

def _redact_sql(expr: str) -> str:
    out = f"regexp_replace(replace({expr}, chr(10), ' '), '^\\s+|\\s+$', '', 'g')"
    for pat in AU.CREDENTIAL_PATTERNS:
        out = f"regexp_replace({out}, '{pat}', '[redacted]', 'g')"
    return out


@register("redact_errors", sql(f"""
SELECT doc_id, red AS redacted,
       CAST((length(red) - length(replace(red, '[redacted]', ''))) // 10 AS BIGINT) AS redactions,
       CAST(length(red) AS BIGINT) AS redacted_length,
       CASE WHEN length(red) > 500 THEN substring(red, 1, 499) || '…' ELSE red END AS summary
FROM (SELECT doc_id, {_redact_sql('text')} AS red FROM documents) t"""))
def q_redact_errors(spark, sf_dir):
    docs = testdata.read(spark, sf_dir, "documents", "doc_id", "text")
    return AU.error_summaries(docs, "doc_id", "text")


# --------------------------------------------------------------------------
# Run audit (SNK-10, PRJ-8, PRJ-10, FLT-7, AGG-15, SRT-8) over the audit log
# the adapter derives from the driver's ``events`` table.

# Stale-run release parameters: runs still running that started a week before
# the end of the log are released.
RELEASE_AS_OF = "2024-01-31 00:00:00"
RELEASE_OLDER_THAN_DAYS = 7

AUDIT_CTES = f"""
audit_events AS (
  SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, ts AS event_ts,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
                         WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded'
                         WHEN 'error' THEN 'failed' END AS status,
         CASE WHEN event_type = 'purchase' THEN CAST(json(props) AS VARCHAR) END AS row_counts,
         CASE WHEN event_type = 'purchase' THEN 'raw/run_date=' || strftime(ts, {D})
              || '/run_id=run-' || CAST(user_id AS VARCHAR) END AS lake_prefix,
         CASE WHEN event_type = 'error' THEN
           (SELECT CASE WHEN length(r) > 500 THEN substring(r, 1, 499) || '…' ELSE r END
            FROM (SELECT {{redact}} AS r)) END AS error_summary
  FROM events),
run_last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_ts DESC) AS rn
                 FROM audit_events) WHERE rn = 1),
run_first AS (
  SELECT run_id, min(event_ts) FILTER (WHERE status <> 'queued') AS started,
         min(event_ts) AS queued
  FROM audit_events GROUP BY run_id),
run_state AS (
  SELECT l.run_id, l.status, coalesce(f.started, f.queued) AS started_at,
         CASE WHEN l.status IN ('succeeded', 'failed') THEN l.event_ts END AS completed_at,
         l.lake_prefix, coalesce(l.row_counts, '{{}}') AS row_counts, l.error_summary
  FROM run_last l JOIN run_first f ON f.run_id = l.run_id),
run_state_out AS (
  SELECT run_id, status, started_at, completed_at,
         CAST((epoch_us(completed_at) - epoch_us(started_at) + 50000) // 100000 AS DOUBLE) / 10
           AS duration_seconds,
         lake_prefix, row_counts, error_summary
  FROM run_state),
run_current AS (SELECT * FROM run_state_out ORDER BY started_at DESC LIMIT 1),
run_last_ok AS (SELECT * FROM run_state_out WHERE status = 'succeeded'
                ORDER BY completed_at DESC LIMIT 1),
run_active AS (SELECT CAST(count(*) FILTER (WHERE status IN ('queued', 'running')) AS BIGINT)
                 AS active_runs FROM run_state)"""


def _audit_ctes() -> str:
    return AUDIT_CTES.replace(
        "{redact}", _redact_sql("'run failed after event ' || props"))


def _audit_events(spark, sf_dir):
    return testdata.audit_events(spark, sf_dir)


def _map_json(c: str):
    return F.to_json(F.col(c))


_RUN_STATE_SQL = sql(f"""
SELECT run_id, status, strftime(started_at, {TS}) AS started_at,
       strftime(completed_at, {TS}) AS completed_at, duration_seconds, lake_prefix,
       row_counts, error_summary
FROM run_state_out""", _audit_ctes())


@register("run_audit_state", _RUN_STATE_SQL)
def q_run_audit_state(spark, sf_dir):
    s = AU.run_state(_audit_events(spark, sf_dir))
    return s.withColumn("row_counts", _map_json("row_counts"))


RUN_ID = "run-3"


@register("run_by_id", sql(f"""
SELECT run_id, status, strftime(started_at, {TS}) AS started_at,
       strftime(completed_at, {TS}) AS completed_at, duration_seconds, lake_prefix,
       row_counts, error_summary
FROM run_state_out WHERE run_id = '{RUN_ID}'""", _audit_ctes()))
def q_run_by_id(spark, sf_dir):
    s = O.by_id(AU.run_state(_audit_events(spark, sf_dir)), RUN_ID, "run_id")
    return s.withColumn("row_counts", _map_json("row_counts"))


@register("run_audit_state_stream", _RUN_STATE_SQL)
def q_run_audit_state_stream(spark, sf_dir):
    """The same run state, built incrementally by Structured Streaming."""
    import uuid
    from ..session import scratch_root
    from ..streaming import audit_stream
    root = f"{scratch_root(spark)}/audit-stream-{uuid.uuid4().hex}"
    s = audit_stream.fold_files(spark, f"{sf_dir}/events.parquet", root, testdata.audit_log)
    return s.withColumn("row_counts", _map_json("row_counts"))


def _status_row(spark, sf_dir):
    return AU.pipeline_status(_audit_events(spark, sf_dir))


@register("pipeline_status", sql(f"""
SELECT c.run_id AS current_run_id, c.status AS current_status,
       strftime(c.started_at, {TS}) AS current_started_at,
       strftime(c.completed_at, {TS}) AS current_completed_at,
       c.duration_seconds AS current_duration_seconds, c.row_counts AS current_row_counts,
       c.error_summary AS current_error_summary,
       s.run_id AS last_successful_run_id,
       strftime(s.completed_at, {TS}) AS last_successful_completed_at,
       s.duration_seconds AS last_successful_duration_seconds,
       s.lake_prefix AS last_successful_lake_prefix,
       s.row_counts AS last_successful_row_counts, a.active_runs
FROM run_active a LEFT JOIN run_current c ON TRUE LEFT JOIN run_last_ok s ON TRUE""",
                                    _audit_ctes()))
def q_pipeline_status(spark, sf_dir):
    p = _status_row(spark, sf_dir)
    return p.select(
        F.col("current.run_id").alias("current_run_id"),
        F.col("current.status").alias("current_status"),
        F.col("current.started_at").alias("current_started_at"),
        F.col("current.completed_at").alias("current_completed_at"),
        F.col("current.duration_seconds").alias("current_duration_seconds"),
        F.to_json("current.row_counts").alias("current_row_counts"),
        F.col("current.error_summary").alias("current_error_summary"),
        F.col("last_successful.run_id").alias("last_successful_run_id"),
        F.col("last_successful.completed_at").alias("last_successful_completed_at"),
        F.col("last_successful.duration_seconds").alias("last_successful_duration_seconds"),
        F.col("last_successful.lake_prefix").alias("last_successful_lake_prefix"),
        F.to_json("last_successful.row_counts").alias("last_successful_row_counts"),
        F.col("active_runs").cast("long").alias("active_runs"))


@register("warehouse_status", sql(f"""
SELECT CASE WHEN c.status IN ('queued', 'running') THEN 'running'
            WHEN c.status = 'failed' THEN 'last_run_failed'
            WHEN s.completed_at IS NOT NULL THEN 'up_to_date' ELSE 'not_built' END AS state,
       strftime(s.completed_at, {TS}) AS published_at
FROM run_active a LEFT JOIN run_current c ON TRUE LEFT JOIN run_last_ok s ON TRUE""",
                                     _audit_ctes()))
def q_warehouse_status(spark, sf_dir):
    return AU.warehouse_status(_status_row(spark, sf_dir))


@register("active_runs", sql("SELECT active_runs FROM run_active", _audit_ctes()))
def q_active_runs(spark, sf_dir):
    return AU.active_runs(_audit_events(spark, sf_dir))


@register("released_runs", sql(f"""
SELECT run_id, strftime(TIMESTAMP '{RELEASE_AS_OF}', {TS}) AS event_ts, 'failed' AS status,
       CAST(NULL AS VARCHAR) AS row_counts, lake_prefix,
       'released: the run stopped reporting progress' AS error_summary
FROM run_state
WHERE status IN ('queued', 'running')
  AND started_at < TIMESTAMP '{RELEASE_AS_OF}' - INTERVAL {RELEASE_OLDER_THAN_DAYS} DAY""",
                                  _audit_ctes()))
def q_released_runs(spark, sf_dir):
    import datetime as dt
    as_of = dt.datetime.fromisoformat(RELEASE_AS_OF).replace(tzinfo=dt.timezone.utc)
    rel = AU.release_stale_runs(_audit_events(spark, sf_dir), as_of,
                                dt.timedelta(days=RELEASE_OLDER_THAN_DAYS))
    return rel.withColumn("row_counts", _map_json("row_counts"))
