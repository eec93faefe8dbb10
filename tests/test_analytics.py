"""Fixture F2: analytics statements with hand-computed golden values."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import analytics as A
from tallyhouse.operators import series as S
from tallyhouse.schemas import STAR
from tallyhouse.sources.warehouse import open_version, table_path

TS = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def wh(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("f2"))
    rows = {
        "dim_customer": [(1, "c-pune", "Asha", "Pune", "Maharashtra", TS),
                         (2, "c-kochi", "Ravi", "Kochi", "Kerala", TS)],
        "dim_product": [(1, "p-elec", "ELEC-0001", "Phone", "Electronics", D("1000.00"), True),
                        (2, "p-groc", "GROC-0001", "Tea", "Grocery & Gourmet", D("250.50"), True)],
        "dim_date": [(20260301 + i, dt.date(2026, 3, 1 + i), 1 + i, 3, "March", 1, 2026, i == 0)
                     for i in range(3)],
        "fact_sales": [(1, "o-1", "i-1", 1, 1, 20260301, 2, D("1000.00"), D("2000.00")),
                       (2, "o-1", "i-2", 1, 2, 20260301, 1, D("250.50"), D("250.50")),
                       (3, "o-2", "i-3", 2, 1, 20260303, 3, D("900.00"), D("2700.00")),
                       (4, "o-2", "i-4", 2, 2, 20260303, 4, D("200.00"), D("800.00"))],
        "warehouse_metadata": [("published_at", "2026-03-04T00:00:00+00:00")],
    }
    for name, data in rows.items():
        df = spark.createDataFrame(data, STAR[name])
        if name == "fact_sales":
            df = df.withColumn("sale_month", (F.col("date_key") / 100).cast("int"))
            df.write.partitionBy("sale_month").parquet(table_path(root, name))
        else:
            df.write.parquet(table_path(root, name))
    return open_version(spark, root)


def one(df):
    return df.first().asDict()


def test_kpi_all(wh):
    r = one(A.revenue_summary(wh))
    assert r == {"total_revenue": 5750.50, "order_count": 2, "customer_count": 2,
                 "units_sold": 10, "average_order_value": 2875.25,
                 "range_from": "2026-03-01", "range_to": "2026-03-03"}


def test_kpi_from(wh):
    r = one(A.revenue_summary(wh, "2026-03-03"))
    assert (r["total_revenue"], r["order_count"], r["units_sold"]) == (3500.00, 1, 7)


def test_kpi_empty_day_is_zero(wh):
    r = one(A.revenue_summary(wh, "2026-03-02", "2026-03-02"))
    assert (r["total_revenue"], r["order_count"], r["customer_count"], r["units_sold"],
            r["average_order_value"]) == (0.0, 0, 0, 0, 0.0)
    assert (r["range_from"], r["range_to"]) == ("2026-03-02", "2026-03-02")


def test_categories(wh):
    rows = [tuple(r) for r in A.sales_by_category(wh).collect()]
    assert rows == [("Electronics", 4700.00, 5, 2), ("Grocery & Gourmet", 1050.50, 5, 2)]


def test_top_n_limits_products_only(wh):
    assert A.top_products(wh, top_n=1).count() == 1
    assert A.sales_by_category(wh).count() == 2
    with pytest.raises(ValueError):
        A.top_products(wh, top_n=101)


def test_cities(wh):
    rows = [tuple(r) for r in A.sales_by_city(wh).collect()]
    assert rows == [("Kochi", "Kerala", 3500.00, 1, 1), ("Pune", "Maharashtra", 2250.50, 1, 1)]
    shares = {r.city: r.share_of_leader for r in A.city_share_of_leader(wh).collect()}
    assert shares == {"Kochi": 100, "Pune": 64}


def test_daily_keeps_quiet_days(wh):
    rows = [tuple(r) for r in A.daily_sales(wh).collect()]
    assert rows == [("2026-03-01", 2250.50, 1, 3), ("2026-03-02", 0.0, 0, 0),
                    ("2026-03-03", 3500.00, 1, 7)]
    # a wider request is not padded beyond dim_date
    assert A.daily_sales(wh, "2026-02-01", "2026-04-30").count() == 3


def test_reconciliation(wh):
    total = one(A.revenue_summary(wh))["total_revenue"]
    assert sum(r.revenue for r in A.daily_sales(wh).collect()) == total
    assert sum(r.revenue for r in A.sales_by_category(wh).collect()) == total


def test_bad_window_rejected(wh):
    with pytest.raises(ValueError):
        A.revenue_summary(wh, "2026-02-30")
    with pytest.raises(ValueError):
        A.revenue_summary(wh, "2026-03-03", "2026-03-01")


def test_kpi_delta_windows():
    cur, prev = S.preset_windows(7, "2026-08-18")
    assert cur == ("2026-08-12", "2026-08-18") and prev == ("2026-08-05", "2026-08-11")
