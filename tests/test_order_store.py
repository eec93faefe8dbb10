"""Committed intake: what is written, what is not, repeats and conflicts."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhouse.config import UUID_V4_PATTERN
from tallyhouse.sources.commit_log import CommitConflict
from tallyhouse.sources.order_store import OrderStore

HEAD = "order_ref string, customer_id string, order_date date, status string"
LINE = "order_ref string, position int, product_id string, quantity int, unit_price_at_sale decimal(12,2)"


def batch(spark, heads, lines):
    return spark.createDataFrame(heads, HEAD), spark.createDataFrame(lines, LINE)


def counts(store, version=None):
    return {t: df.count() for t, df in store.tables(version).items()}


@pytest.fixture()
def store(spark, scratch, f1):
    s = OrderStore(spark, scratch + "/store", buckets=4)
    s.create(f1)
    return s


def test_accepted_orders_are_written_with_the_price_of_intake(spark, store):
    heads, lines = batch(spark, [("a", "c-pune", None, None), ("b", "nobody", None, None), ("c", "c-kochi", dt.date(2026, 3, 9), "shipped"),
                                 ("d", "c-pune", None, None)],
                         [("a", 0, "p-elec", 2, None), ("b", 0, "p-elec", 1, None), ("c", 0, "p-elec", 1, D("900.00")), ("d", 0, "p-groc", 1, None)])
    done = store.apply_orders("batch-1", heads, lines, "2026-04-01")
    assert done.version == 2
    assert {r.order_ref: r.issues for r in done.verdict.collect()} == {"a": "", "b": "customer_not_found", "c": "", "d": "product_inactive"}
    assert counts(store) == {"customers": 2, "products": 2, "orders": 5, "order_items": 6} and counts(store, 1)["orders"] == 3
    new = {(r.customer_id, r.status): r for r in store.tables()["orders"].join(store.tables(1)["orders"].select("id"), "id", "left_anti").collect()}
    assert (new[("c-pune", "pending")].order_date, new[("c-kochi", "shipped")].order_date) == (dt.date(2026, 4, 1), dt.date(2026, 3, 9))
    items = {r.order_id: r for r in store.tables()["order_items"].collect()}
    a, c = items[new[("c-pune", "pending")].id], items[new[("c-kochi", "shipped")].id]
    assert (a.quantity, a.unit_price_at_sale, c.unit_price_at_sale) == (2, D("1000.00"), D("900.00"))
    assert store.tables()["orders"].where(F.col("id").rlike(UUID_V4_PATTERN)).count() == 2


def test_a_batch_sent_twice_is_applied_once(spark, store):
    heads, lines = batch(spark, [("a", "c-pune", None, None)], [("a", 0, "p-elec", 1, None)])
    assert store.apply_orders("b1", heads, lines, "2026-04-01").version == 2
    again = store.apply_orders("b1", heads, lines, "2026-04-01")
    assert again.version is None and store.log.latest() == 2 and counts(store)["orders"] == 4
    assert store.apply_orders("b2", heads, lines, "2026-04-01").version == 3 and counts(store)["orders"] == 5


def test_only_touched_buckets_are_rewritten(spark, store):
    before = store.log.entry(1)["layout"]
    heads, lines = batch(spark, [("a", "c-pune", None, None)], [("a", 0, "p-elec", 1, None)])
    store.apply_orders("b1", heads, lines, "2026-04-01")
    after = store.log.entry(2)["layout"]
    assert after["customers"] == before["customers"] and after["products"] == before["products"]
    for t in ("orders", "order_items"):
        assert len([b for b in after[t] if after[t][b] != before[t].get(b)]) == 1


def test_rows_of_a_known_key_are_replaced(spark, store):
    old = store.tables()["products"].where("id = 'p-elec'")
    layout = store.log.entry(1)["layout"]["products"]
    merged = store._merge("products", layout, old.withColumn("unit_price", F.lit("5.00").cast("decimal(12,2)")), "t")
    rows = {r.id: r.unit_price for r in store._read("products", list(merged.values())).collect()}
    assert rows == {"p-elec": D("5.00"), "p-groc": D("250.50")}


def test_concurrent_batches_both_arrive(spark, store):
    def send(i):
        heads, lines = batch(spark, [(f"o{i}", "c-pune", None, None)], [(f"o{i}", 0, "p-elec", i + 1, None)])
        return store.apply_orders(f"batch-{i}", heads, lines, "2026-04-01", tries=12).version
    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(send, range(3))) == [2, 3, 4]
    assert counts(store)["orders"] == 6
    assert sorted(r.quantity for r in store.tables()["order_items"].join(store.tables(1)["order_items"].select("id"), "id", "left_anti").collect()) == [1, 2, 3]


def test_one_batch_sent_by_two_writers_is_applied_once(spark, store):
    heads, lines = batch(spark, [("a", "c-pune", None, None)], [("a", 0, "p-elec", 1, None)])
    with ThreadPoolExecutor(2) as pool:
        got = [f.result().version for f in [pool.submit(store.apply_orders, "same", heads, lines, "2026-04-01") for _ in range(2)]]
    assert sorted(map(str, got)) == ["2", "None"] and counts(store)["orders"] == 4


def test_customers_and_products_and_then_an_order_for_them(spark, store):
    who = spark.createDataFrame([("x", " Mira ", "Mira@Example.com", "Pune", "MH"), ("y", "Dup", "asha@EXAMPLE.com", "Pune", "MH")], "ref string, name string, email string, city string, state string")
    assert [r.issues for r in store.apply_customers("cust", who, "2026-04-01").verdict.orderBy("ref").collect()] == ["", "email_conflict"]
    what = spark.createDataFrame([("p", "NEW-1", "Lamp", "Home", D("9.99"), None)], "ref string, sku string, name string, category string, unit_price decimal(12,2), active boolean")
    store.apply_products("prod", what, "2026-04-01")
    c = store.tables()["customers"].where("email = 'mira@example.com'").first()
    p = store.tables()["products"].where("sku = 'NEW-1'").first()
    assert c.name == "Mira" and p.active is True
    heads, lines = batch(spark, [("a", c.id, None, None)], [("a", 0, p.id, 3, None)])
    assert store.apply_orders("b", heads, lines, "2026-04-01").verdict.first().accepted
    assert store.tables()["order_items"].where(F.col("product_id") == p.id).first().unit_price_at_sale == D("9.99")


def test_a_batch_without_an_accepted_row_is_still_recorded(spark, store):
    heads, lines = batch(spark, [("a", "nobody", None, None)], [("a", 0, "p-elec", 1, None)])
    assert store.apply_orders("b", heads, lines, "2026-04-01").version == 2 and counts(store) == counts(store, 1)
    assert store.apply_orders("b", heads, lines, "2026-04-01").version is None


def test_store_limits(spark, scratch, store, f1):
    with pytest.raises(CommitConflict):
        store.create(f1)
    assert counts(store)["orders"] == 3
    with pytest.raises(LookupError):
        OrderStore(spark, scratch + "/none").tables()
    heads, lines = batch(spark, [("a", "c-pune", None, None)], [("a", 0, "p-elec", 1, None)])
    with pytest.raises(ValueError):
        OrderStore(spark, store.root, buckets=8).apply_orders("b", heads, lines, "2026-04-01")
    store.apply_orders("b", heads, lines, "2026-04-01")
    before = counts(store)
    assert store.expire(keep=1) >= 1 and counts(store) == before
