"""Fixture F1: star build, keys, gate mutations, publish/not-ready behaviour."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixtures_f1 import F1, raw_frames
from tallyhouse.operators import quality
from tallyhouse.operators.star import build_star
from tallyhouse.plans.pipeline import build_and_publish, published


def test_star_rows_and_revenue(spark, f1):
    star = build_star(f1)
    assert star.dim_customer.count() == 2
    assert star.dim_product.count() == 2
    facts = star.fact_sales.collect()
    assert len(facts) == 3  # the cancelled line is absent
    assert sum(r.revenue for r in facts) == Decimal("5050.00")
    groc = [r for r in facts if r.order_item_id == "i-2"][0]
    assert groc.unit_price == Decimal("200.00")  # historic price, catalogue is 250.50
    assert star.dim_product.where("product_id = 'p-groc'").first().current_unit_price == Decimal("250.50")


def test_dim_date(spark, f1):
    d = build_star(f1).dim_date.orderBy("full_date").collect()
    assert [r.full_date for r in d] == [dt.date(2026, 3, i) for i in range(1, 5)]
    first = d[0]
    assert (first.date_key, first.day, first.month, first.month_name, first.quarter,
            first.year, first.is_weekend) == (20260301, 1, 3, "March", 1, 2026, True)


def test_keys_stable_on_rebuild(spark, f1):
    a = {r.order_item_id: r.sale_key for r in build_star(f1).fact_sales.collect()}
    b = {r.order_item_id: r.sale_key for r in build_star(raw_frames(spark, F1)).fact_sales.collect()}
    assert a == b == {"i-1": 1, "i-2": 2, "i-3": 3}


def test_retired_product_keeps_its_sale(spark, f1):
    star = build_star(f1)
    key = star.dim_product.where("product_id = 'p-groc'").first().product_key
    assert star.fact_sales.where(F.col("product_key") == key).count() == 1


def _report(star, raw):
    return {r.check: r for r in quality.quality_report(
        star.dim_customer, star.dim_product, star.dim_date, star.fact_sales,
        raw["orders"], raw["order_items"]).collect()}


def test_gate_passes(spark, f1):
    rep = _report(build_star(f1), f1)
    assert all(r.passed for r in rep.values()), [r for r in rep.values() if not r.passed]
    assert len(rep) == 20


@pytest.mark.parametrize("mutation,check", [
    ("revenue_plus_one", "revenue_matches_quantity_times_price"),
    ("drop_day", "date_dimension_gap_free"),
    ("drop_fact", "fact_count_matches_source"),
    ("negative_quantity", "positive_quantity"),
    ("drop_customer", "fact_joins_customer"),
    ("duplicate_item", "unique_order_item"),
])
def test_gate_mutations(spark, f1, mutation, check):
    s = build_star(f1)
    dc, dp, dd, f = s.dim_customer, s.dim_product, s.dim_date, s.fact_sales
    if mutation == "revenue_plus_one":
        f = f.withColumn("revenue", F.when(F.col("sale_key") == 1, F.col("revenue") + 1)
                         .otherwise(F.col("revenue")).cast("decimal(14,2)"))
    elif mutation == "drop_day":
        dd = dd.where("full_date <> date'2026-03-02'")
    elif mutation == "drop_fact":
        f = f.where("sale_key <> 2")
    elif mutation == "negative_quantity":
        f = f.withColumn("quantity", F.when(F.col("sale_key") == 1, F.lit(-1))
                         .otherwise(F.col("quantity")))
    elif mutation == "drop_customer":
        dc = dc.where("customer_id <> 'c-kochi'")
    elif mutation == "duplicate_item":
        f = f.unionByName(f.where("sale_key = 1"))
    rep = _report(type(s)(dc, dp, dd, f), f1)
    assert not rep[check].passed
    assert rep[check].affected > 0


def test_publish_and_failed_build_keeps_previous(spark, scratch, f1):
    first = build_and_publish(spark, f1, scratch, run_id="run-1")
    assert first.published and first.warehouse_counts["fact_sales"] == 3
    wh = published(spark, scratch)
    assert wh.version == "version=run-1"
    meta = {r.key: r.value for r in wh.metadata.collect()}
    assert meta["run_id"] == "run-1" and meta["excluded_order_statuses"] == "cancelled"

    empty = dict(f1)
    empty["order_items"] = f1["order_items"].limit(0)
    second = build_and_publish(spark, empty, scratch, run_id="run-2")
    assert not second.published
    assert "fact_sales_not_empty" in [n for n, _ in second.failures]
    assert published(spark, scratch).version == "version=run-1"


def test_not_ready_without_pointer(spark, scratch):
    assert published(spark, scratch) is None


def test_reports_not_ready(spark, scratch):
    import os
    from tallyhouse.operators import analytics as A
    root = scratch + "/warehouse"

    def check():
        meta = A.warehouse_meta(spark, root, "2026-03-01", "2026-03-31").first()
        assert (meta.warehouse_ready, meta.range_from, meta.range_to) == (False, "2026-03-01", "2026-03-31")
        s = A.report(spark, root, "summary", "2026-03-01", "2026-03-31").first()
        assert (s.total_revenue, s.order_count, s.average_order_value) == (0.0, 0, 0.0)
        assert A.report(spark, root, "categories").count() == 0
        assert A.report(spark, root, "daily").count() == 0

    check()                                   # nothing published
    os.makedirs(root, exist_ok=True)
    open(os.path.join(root, "_CURRENT"), "w").close()
    check()                                   # zero-byte pointer
    with open(os.path.join(root, "_CURRENT"), "w") as fh:
        fh.write("version=garbage\n")
    check()                                   # dangling pointer


def test_reports_ready(spark, scratch, f1):
    from tallyhouse.operators import analytics as A
    build_and_publish(spark, f1, scratch, run_id="run-r", published_at="2026-03-05T00:00:00+00:00")
    meta = A.warehouse_meta(spark, scratch + "/warehouse").first()
    assert meta.warehouse_ready and meta.generated_at == "2026-03-05T00:00:00+00:00"
    assert (meta.range_from, meta.range_to) == ("2026-03-01", "2026-03-04")
    assert A.report(spark, scratch + "/warehouse", "summary").first().total_revenue == 5050.0


def test_freshness_after_swap(spark, scratch):
    """Fixture F3: a second publish is visible to the next report."""
    from decimal import Decimal as D
    from fixtures_f1 import TS, raw_frames
    from tallyhouse.operators import analytics as A
    base = {
        "customers": [("c1", "Asha", "asha@example.com", "Pune", "Maharashtra", TS)],
        "products": [("p1", "SKU-1", "Lamp", "Home", D("500.00"), True, TS)],
        "orders": [("o1", "c1", "delivered", dt.date(2026, 5, 1), TS),
                   ("o2", "c1", "delivered", dt.date(2026, 5, 2), TS)],
        "order_items": [("i1", "o1", "p1", 4, D("500.00")), ("i2", "o2", "p1", 1, D("250.00"))],
    }
    build_and_publish(spark, raw_frames(spark, base), scratch, run_id="a")
    s = A.report(spark, scratch + "/warehouse", "summary").first()
    assert (s.total_revenue, s.order_count, s.units_sold, s.average_order_value) == (2250.0, 2, 5, 1125.0)
    base["order_items"][0] = ("i1", "o1", "p1", 9, D("500.00"))
    build_and_publish(spark, raw_frames(spark, base), scratch, run_id="b")
    s = A.report(spark, scratch + "/warehouse", "summary").first()
    assert (s.total_revenue, s.units_sold) == (4750.0, 10)


def test_page_parameters(spark, f1):
    from tallyhouse.operators import operational as O
    for bad in (dict(limit=0), dict(limit=201), dict(offset=-1)):
        with pytest.raises(ValueError):
            O.customers_page(f1["customers"], **bad)
    assert O.customers_page(f1["customers"], limit=200).count() == 2


def test_run_with_audit_records_success_then_failure(spark, scratch, f1):
    from tallyhouse.operators import audit
    from tallyhouse.plans.pipeline import run_with_audit
    log = scratch + "/audit"
    ok = run_with_audit(spark, f1, scratch, log, run_id="run-a")
    assert ok.published
    empty = dict(f1)
    empty["order_items"] = f1["order_items"].limit(0)
    bad = run_with_audit(spark, empty, scratch, log, run_id="run-b")
    assert not bad.published
    events = spark.read.schema(audit.EVENT_SCHEMA).parquet(log)
    state = {r.run_id: r for r in audit.run_state(events).collect()}
    assert state["run-a"].status == "succeeded" and state["run-b"].status == "failed"
    assert dict(state["run-a"].row_counts) == ok.source_counts
    assert state["run-a"].lake_prefix == ok.lake_prefix
    assert state["run-b"].error_summary.startswith("quality gate failed: fact_sales_not_empty")
    st = audit.pipeline_status(events).first()
    assert st.current.run_id == "run-b" and st.last_successful.run_id == "run-a"
    assert audit.warehouse_status(audit.pipeline_status(events)).first().state == "last_run_failed"
    assert published(spark, scratch).version == "version=run-a"
