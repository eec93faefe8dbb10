"""Every gate check and every dataset rule fails on a change made for it, and only those named do."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import quality, validate
from tallyhouse.operators.star import build_star


@pytest.fixture(scope="module")
def star(spark):
    from fixtures_f1 import F1, raw_frames
    raw = raw_frames(spark, F1)
    built = build_star(raw)
    return type(built)(*[spark.createDataFrame(d.collect(), d.schema) for d in built]), raw


def _set(df, where, **values):
    types = dict(df.dtypes)
    return df.select(*[F.when(F.expr(where), F.expr(values[c])).otherwise(F.col(c)).cast(types[c]).alias(c)
                       if c in values else F.col(c) for c in df.columns])


def _twice(df, where, **values):
    return df.unionByName(_set(df.where(where), "true", **values))


# change of one table → the checks that fail, with their counts
GATE = {
    "no facts": ("fact", lambda f: f.where("false"), {"fact_sales_not_empty": 1, "fact_count_matches_source": 3}),
    "null measure": ("fact", lambda f: _set(f, "sale_key = 1", unit_price="null"), {"no_null_keys": 1}),
    "null reference": ("fact", lambda f: _set(f, "sale_key = 1", customer_key="null"),
                       {"no_null_keys": 1, "fact_joins_customer": 1}),
    "revenue": ("fact", lambda f: _set(f, "sale_key = 1", revenue="revenue + 1"), {"revenue_matches_quantity_times_price": 1}),
    "quantity": ("fact", lambda f: _set(f, "sale_key = 1", quantity="0", revenue="0"), {"positive_quantity": 1}),
    "price": ("fact", lambda f: _set(f, "sale_key = 1", unit_price="-unit_price", revenue="-revenue"), {"non_negative_price": 1}),
    "lost fact": ("fact", lambda f: f.where("sale_key <> 2"), {"fact_count_matches_source": 1}),
    "line twice": ("fact", lambda f: _twice(f, "sale_key = 1", sale_key="99"),
                   {"unique_order_item": 1, "fact_count_matches_source": 1}),
    "sale key twice": ("fact", lambda f: _set(f, "sale_key = 2", sale_key="1"), {"unique_sale_key": 1}),
    "lost customer": ("customer", lambda d: d.where("customer_id <> 'c-kochi'"), {"fact_joins_customer": 1}),
    "customer id twice": ("customer", lambda d: _twice(d, "customer_id = 'c-kochi'", customer_key="99"), {"unique_customer_id": 1}),
    "customer key twice": ("customer", lambda d: _twice(d, "customer_id = 'c-kochi'", customer_id="'new'"), {"unique_customer_key": 1}),
    "lost product": ("product", lambda d: d.where("product_id <> 'p-elec'"), {"fact_joins_product": 2}),
    "sku twice": ("product", lambda d: _twice(d, "product_id = 'p-elec'", product_key="99", product_id="'new'"),
                  {"unique_product_sku": 1}),
    "product key twice": ("product", lambda d: _twice(d, "product_id = 'p-elec'", sku="'new'", product_id="'new'"),
                          {"unique_product_key": 1}),
    "product id twice": ("product", lambda d: _twice(d, "product_id = 'p-elec'", product_key="99", sku="'new'"),
                         {"unique_product_id": 1}),
    "gap": ("date", lambda d: d.where("day <> 2"), {"date_dimension_gap_free": 1}),
    "lost sold day": ("date", lambda d: d.where("day <> 4"), {"all_sold_days_present": 1, "fact_joins_date": 1}),
    "date key twice": ("date", lambda d: _set(d, "day = 3", date_key="20260302"), {"unique_date_key": 1}),
    "day twice": ("date", lambda d: _twice(d, "day = 2", date_key="99"), {"unique_full_date": 1, "date_dimension_gap_free": 1}),
}


@pytest.mark.parametrize("name", GATE)
def test_gate_check_fails(spark, star, name):
    s, raw = star
    table, change, want = GATE[name]
    frames = {"customer": s.dim_customer, "product": s.dim_product, "date": s.dim_date, "fact": s.fact_sales}
    frames[table] = change(frames[table])
    rows = quality.quality_report(frames["customer"], frames["product"], frames["date"], frames["fact"],
                                  raw["orders"], raw["order_items"]).collect()
    assert len(rows) == 20
    assert {r.check: r.affected for r in rows if not r.passed} == want
    assert all((r.detail == "ok") == r.passed for r in rows)


def test_every_gate_check_is_covered():
    assert len({c for _, _, want in GATE.values() for c in want}) == 20


def test_gate_reads_the_fact_twice(spark, star, scratch, capsys):
    s, raw = star
    s.fact_sales.write.parquet(f"{scratch}/fact")
    report = quality.quality_report(s.dim_customer, s.dim_product, s.dim_date, spark.read.parquet(f"{scratch}/fact"),
                                    raw["orders"], raw["order_items"])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a static plan shows what is reused
    try:
        report.explain("formatted")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert capsys.readouterr().out.count(f"{scratch}/fact]") == 2


def _id(n):
    return f"00000000-0000-4000-8000-{n:012d}"


@pytest.fixture(scope="module")
def dataset(spark):
    return {
        "customers": spark.createDataFrame([(_id(1), "A", "a@x.io", "Pune", "MH"), (_id(2), "B", "b@x.io", "Kochi", "KL")],
                                           "id string, name string, email string, city string, state string"),
        "products": spark.createDataFrame([(_id(3), "S1", "N", "Cat", 10.0, True), (_id(4), "S2", "M", "Cat", 5.25, False)],
                                          "id string, sku string, name string, category string, unit_price double, active boolean"),
        "orders": spark.createDataFrame([(_id(5), _id(1), "pending", "2026-01-01"), (_id(6), _id(2), "pending", "2026-01-02")],
                                        "id string, customer_id string, status string, order_date string"),
        "order_items": spark.createDataFrame([(_id(7), _id(5), _id(3), 1, 10.0), (_id(8), _id(6), _id(3), 2, 9.5)],
                                             "id string, order_id string, product_id string, quantity int, unit_price_at_sale double"),
    }


C, P, O, I = "customers", "products", "orders", "order_items"
RULES = {
    "nothing": (C, lambda d: d, {}),
    "customer more": (C, lambda d: _twice(d, f"id = '{_id(2)}'", id=f"'{_id(20)}'", email="'c@x.io'"), {"requested_customer_count": 1}),
    "product more": (P, lambda d: _twice(d, f"id = '{_id(4)}'", id=f"'{_id(20)}'", sku="'S3'"), {"requested_product_count": 1}),
    "order more": (O, lambda d: _twice(d, f"id = '{_id(6)}'", id=f"'{_id(20)}'"), {"requested_order_count": 1, "order_has_items": 1}),
    "customer twice": (C, lambda d: _twice(d, f"id = '{_id(2)}'", email="'c@x.io'"), {"unique_customer_id": 1, "requested_customer_count": 1}),
    "product twice": (P, lambda d: _twice(d, f"id = '{_id(3)}'", sku="'S3'"), {"unique_product_id": 1, "requested_product_count": 1}),
    "order twice": (O, lambda d: _twice(d, f"id = '{_id(6)}'"), {"unique_order_id": 1, "requested_order_count": 1}),
    "line twice": (I, lambda d: _twice(d, f"id = '{_id(7)}'", order_id=f"'{_id(6)}'"), {"unique_order_item_id": 1, "one_line_per_product": 1}),
    "id shape": (I, lambda d: _set(d, f"id = '{_id(7)}'", id="'x'"), {"uuid_v4_shape": 1}),
    "e-mail twice": (C, lambda d: _set(d, f"id = '{_id(2)}'", email="'A@X.io'"), {"unique_customer_email": 1}),
    "sku twice": (P, lambda d: _set(d, f"id = '{_id(4)}'", sku="'S1'"), {"unique_product_sku": 1}),
    "no customer": (O, lambda d: _set(d, f"id = '{_id(6)}'", customer_id=f"'{_id(99)}'"), {"order_customer_exists": 1}),
    "null customer": (O, lambda d: _set(d, f"id = '{_id(6)}'", customer_id="null"), {"order_customer_exists": 1}),
    "no order": (I, lambda d: _twice(d, f"id = '{_id(8)}'", id=f"'{_id(20)}'", order_id=f"'{_id(99)}'"), {"order_item_order_exists": 1}),
    "no product": (I, lambda d: _set(d, f"id = '{_id(8)}'", product_id=f"'{_id(99)}'"), {"order_item_product_exists": 1}),
    "e-mail shape": (C, lambda d: _set(d, f"id = '{_id(2)}'", email="'nobody'"), {"customer_email_shape": 1}),
    "blank": (C, lambda d: _set(d, f"id = '{_id(2)}'", city="'  '"), {"blank_text": 1}),
    "money": (P, lambda d: _set(d, f"id = '{_id(3)}'", unit_price="10.001"), {"money_scale": 1}),
    "quantity": (I, lambda d: _set(d, f"id = '{_id(8)}'", quantity="null"), {"quantity_positive": 1}),
    "status": (O, lambda d: _set(d, f"id = '{_id(6)}'", status="'lost'"), {"order_status_known": 1}),
    "date": (O, lambda d: _set(d, f"id = '{_id(6)}'", order_date="'2026-1-2'"), {"order_date_shape": 1}),
    "late": (O, lambda d: _set(d, f"id = '{_id(6)}'", order_date="'2027-01-02'"), {"order_date_within_window": 1}),
    "inactive": (I, lambda d: _set(d, f"id = '{_id(8)}'", product_id=f"'{_id(4)}'"), {"active_products_only": 1}),
}


@pytest.mark.parametrize("name", RULES)
def test_dataset_rule_fails(dataset, name):
    table, change, want = RULES[name]
    rows = validate.validation_report(dataset | {table: change(dataset[table])}, {C: 2, P: 2, O: 2}, "2026-12-31").collect()
    assert len(rows) == 23
    assert {r.rule: r.affected for r in rows if r.affected} == want


def test_every_rule_is_covered():
    assert len({r for _, _, want in RULES.values() for r in want}) == 23


def test_build_counts_are_those_of_the_written_tables(spark, scratch):
    from fixtures_f1 import F1, raw_frames
    from tallyhouse.plans.pipeline import build_and_publish, published
    raw = raw_frames(spark, F1)
    counts = build_and_publish(spark, raw, scratch, run_id="r").warehouse_counts
    wh = published(spark, scratch)
    assert counts == {t: getattr(wh, t).count() for t in ("dim_customer", "dim_product", "dim_date", "fact_sales")}
    empty = build_and_publish(spark, raw | {"order_items": raw["order_items"].limit(0)}, scratch, run_id="s")
    assert not empty.published and empty.warehouse_counts["fact_sales"] == 0
