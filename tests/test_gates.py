"""Extract gate, atomic pointer, readiness, exact money, clipped merges."""

import os

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import intake
from tallyhouse.operators.validate import valid_money
from tallyhouse.plans.pipeline import ExtractError, build_and_publish, published
from tallyhouse.sources.warehouse import delete_tree, read_text, write_text_atomic


def test_extract_gate_refuses_nulls_and_orphans(spark, f1, scratch):
    broken = dict(f1, customers=f1["customers"].withColumn("name", F.lit(None).cast("string")))
    with pytest.raises(ExtractError) as e:
        build_and_publish(spark, broken, scratch)
    assert e.value.failures["nulls_in_customers"] == 2
    orphan = f1["orders"].limit(1).withColumn("id", F.lit("o-x")).withColumn("customer_id", F.lit("nobody"))
    with pytest.raises(ExtractError) as e:
        build_and_publish(spark, dict(f1, orders=f1["orders"].union(orphan)), scratch)
    assert e.value.failures == {"order_customer": 1}
    assert os.listdir(scratch) == []  # nothing was written


def test_pointer_is_replaced_in_one_step(spark, scratch, monkeypatch):
    path = f"{scratch}/pointer"
    write_text_atomic(spark, path, "one")
    write_text_atomic(spark, path, "two")
    assert read_text(spark, path) == "two"
    monkeypatch.setattr("os.urandom", lambda n: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        write_text_atomic(spark, path, "three")
    assert read_text(spark, path) == "two"


def test_ready_needs_every_table(spark, f1, scratch):
    result = build_and_publish(spark, f1, scratch)
    assert published(spark, scratch) is not None
    delete_tree(spark, f"{result.version_dir}/dim_date")
    assert published(spark, scratch) is None


def test_money_is_exact(spark):
    rows = [(147771641.42, True), (9999999999.99, True), (10.001, False), (0.0, True), (-1.0, False), (1e11, False), (None, False)]
    df = spark.createDataFrame(rows, "v double, ok boolean")
    assert df.where(F.coalesce(valid_money(F.col("v")), F.lit(False)) != F.col("ok")).count() == 0


def test_merge_reports_what_it_leaves_out(spark):
    lines = spark.createDataFrame([("o", 0, "p", 700, 1.0), ("o", 1, "p", 700, 2.0), ("o", 2, "q", 1, None)],
                                  "order_ref string, position int, product_id string, quantity int, unit_price_at_sale double")
    got = {r.product_id: r for r in intake.merge_repeats(lines).collect()}
    assert (got["p"].quantity, got["p"].requested_quantity, got["p"].price_conflict) == (1000, 1400, True)
    assert got["q"].requested_quantity == 1 and not got["q"].price_conflict
