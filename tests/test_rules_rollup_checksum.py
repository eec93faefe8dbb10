"""Run rules by mutation, the interval sweep, roll-ups and checksums against brute force."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fixtures_f1 import raw_frames
from tallyhouse.functions.sweep import running_total
from tallyhouse.operators import integrity, rollup, run_rules
from tallyhouse.plans.pipeline import build_and_publish, published
from tallyhouse.sources import lake

T0 = dt.datetime(2026, 1, 1)
RUN = "run_id string, status string, started_at timestamp, completed_at timestamp, row_counts map<string,bigint>, error_summary string"


def at(hour):
    return T0 + dt.timedelta(hours=hour)


GOOD = [("a", "succeeded", at(0), at(1), {"x": 1}, None), ("b", "failed", at(1), at(2), {}, "boom"), ("c", "running", at(3), None, {}, None)]


def found(spark, rows, schema=RUN):
    return {r.constraint: r.affected for r in run_rules.run_constraint_violations(spark.createDataFrame(rows, schema)).collect()}


def test_good_runs_break_no_rule(spark):
    got = found(spark, GOOD)
    assert len(got) == 6 and set(got.values()) == {0}
    assert set(found(spark, []).values()) == {0}


@pytest.mark.parametrize("rule,row", [
    ("status_known", ("x", "paused", at(-9), at(-8), {}, None)),
    ("status_known", ("x", None, at(-9), at(-8), {}, None)),
    ("completion_consistent", ("x", "succeeded", at(9), None, {}, None)),
    ("completion_consistent", ("x", "queued", at(-9), at(-8), {}, None)),
    ("not_backwards", ("x", "succeeded", at(-8), at(-9), {}, None)),
    ("error_only_on_failure", ("x", "succeeded", at(-9), at(-8), {}, "why")),
    ("row_counts_is_object", ("x", "succeeded", at(-9), at(-8), None, None)),
    ("single_active_run", ("x", "queued", at(4), None, {}, None)),
    ("single_active_run", ("x", "succeeded", at(0.5), at(1.5), {}, None))])
def test_each_rule_is_broken_by_its_row(spark, rule, row):
    got = found(spark, GOOD + [row])
    assert got[rule] > 0
    assert {k for k, n in got.items() if n} - {rule} <= ({"single_active_run"} if row[3] is None else set())


def test_row_counts_as_text(spark):
    schema = RUN.replace("map<string,bigint>", "string")
    assert found(spark, [("a", "running", at(0), None, '{"x": 1}', None)], schema)["row_counts_is_object"] == 0
    assert found(spark, [("a", "running", at(0), None, "[1]", None)], schema)["row_counts_is_object"] == 1


def test_sweep_equals_brute_force(spark):
    rng = random.Random(5)
    runs = []
    for i in range(300):
        start = rng.randrange(400)
        end = None if rng.random() < 0.05 else start + rng.randrange(0, 30)
        runs.append((str(i), "running" if end is None else "succeeded", at(start), None if end is None else at(end), {}, None))
    moments = sorted({m for r in runs for m in r[2:4] if m is not None})
    want = {m: sum(r[2] <= m and (r[3] is None or m < r[3]) for r in runs) for m in moments}
    df = spark.createDataFrame(runs, RUN).repartition(5)
    assert {r.moment: r.active_runs for r in run_rules.active_counts(df).collect()} == want
    assert {r.moment for r in run_rules.concurrent_moments(df).collect()} == {m for m, n in want.items() if n > 1}


def test_running_total_over_many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).select(((F.col("id") * 7919) % 2003).alias("k"), (F.col("id") % 5 - 2).alias("v"))
        got = {r.k: r.total for r in running_total(df, "k", "v", "total").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = 0, {}
    for k, v in sorted(((i * 7919) % 2003, i % 5 - 2) for i in range(2000)):
        total += v
        want[k] = total
    assert got == want


# -- roll-ups

@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    rng = random.Random(8)
    ts = dt.datetime(2026, 1, 1)
    data = {
        "customers": [(f"c{i:03d}", f"n{i}", f"c{i}@x.org", rng.choice(["Pune", "Kochi", "Agra"]), "S", ts) for i in range(60)],
        "products": [(f"p{i}", f"S{i}", f"n{i}", rng.choice(["Home", "Toys"]), D("2.50"), True, ts) for i in range(8)],
        "orders": [(f"o{i:04d}", f"c{rng.randrange(60):03d}", rng.choice(["delivered", "cancelled", "pending"]), dt.date(2026, 1, 1) + dt.timedelta(days=rng.randrange(70)), ts) for i in range(400)]}
    data["order_items"] = [(f"i{i:04d}", f"o{rng.randrange(400):04d}", f"p{rng.randrange(8)}", rng.randrange(1, 5), D("2.00")) for i in range(900)]
    root = str(tmp_path_factory.mktemp("rollup"))
    assert build_and_publish(spark, raw_frames(spark, data), root).published
    return data, published(spark, root)


def brute(data, dim, period, lo=None, hi=None):
    customers, products = {r[0]: r for r in data["customers"]}, {r[0]: r for r in data["products"]}
    orders = {r[0]: r for r in data["orders"] if r[2] != "cancelled" and (lo is None or lo <= r[3].isoformat() <= hi)}
    out = {}
    for _, order, product, quantity, price in data["order_items"]:
        if order in orders:
            o = orders[order]
            value = {"all": "", "category": products[product][3], "city": customers[o[1]][3]}[dim]
            g = out.setdefault((value, period(o[3])), [0, set(), set(), 0])
            g[0] += quantity * price
            g[1].add(order)
            g[2].add(o[1])
            g[3] += quantity
    return {k: (float(v[0]), len(v[1]), len(v[2]), v[3]) for k, v in out.items()}


PERIODS = {"weekly": lambda d: (d - dt.timedelta(days=d.weekday())).isoformat(), "monthly": lambda d: d.isoformat()[:7], "daily": lambda d: d.isoformat(), "whole": lambda d: "whole"}


@pytest.mark.parametrize("few", [0, 3, 2048])
def test_rollup_equals_brute_force(spark, sales, few, monkeypatch, tmp_path):
    """Containers as bits, as positions, and some of each give the same counts."""
    data, wh = sales
    monkeypatch.setattr(rollup, "FEW", few)
    folder = rollup.build(wh._replace(path=_copy(wh, tmp_path)))
    monkeypatch.setattr(rollup, "build", lambda _: folder)
    for dim in rollup.DIMS:
        for granularity, window in (("weekly", ()), ("monthly", ("2026-01-10", "2026-02-20")), ("daily", ()), ("whole", ("2026-01-05", "2026-03-01"))):
            got = {(r.value, r.date): (r.revenue, r.order_count, r.customer_count, r.units_sold) for r in rollup.rolled(wh, dim, granularity, *window).collect()}
            assert got == brute(data, dim, PERIODS[granularity], *window), (dim, granularity)


def _copy(wh, tmp_path):
    return str(tmp_path)


def test_rollup_reads_no_facts_and_is_built_once(spark, sales):
    _, wh = sales
    assert rollup.build(wh) == rollup.build(wh)
    files = rollup.rolled(wh, "category", "weekly").inputFiles()
    assert files and not [f for f in files if "fact_sales" in f]
    with pytest.raises(ValueError):
        rollup.rolled(wh, "planet")
    with pytest.raises(ValueError):
        rollup.rolled(wh, "all", "yearly")
    assert rollup.rolled(wh, "all", "whole", "2030-01-01", "2030-01-31").count() == 0


# -- checksums

def text(df):
    return df.select(integrity.checksum_text().alias("c"), "rows").first()


def test_checksum_sees_changed_lost_and_repeated_rows(spark, f1):
    items = f1["order_items"]
    whole = text(integrity.checksum(items))
    assert whole == text(integrity.checksum(items.repartition(7).orderBy(F.rand())))
    changed = items.withColumn("quantity", F.when(F.col("id") == "i-1", 3).otherwise(F.col("quantity")).cast("int"))
    swapped = items.withColumn("order_id", F.when(F.col("id") == "i-1", F.lit("o-e")).when(F.col("id") == "i-3", F.lit("o-d")).otherwise(F.col("order_id")))
    sums = [whole] + [text(integrity.checksum(x)) for x in (changed, swapped, items.where("id <> 'i-2'"), items.unionByName(items.where("id = 'i-2'")), items.limit(0),
                                                            items.unionByName(items), items.withColumn("product_id", F.lit(None).cast("string")), items.withColumn("product_id", F.lit("~")))]
    assert len({s.c for s in sums}) == len(sums)
    assert sums[5].c == "0" * 64 and sums[5].rows == 0


def test_checksum_tells_values_apart_that_join_alike(spark):
    a, b = ([("1:a", "b")], [("1:a1", ":b")])
    assert text(integrity.checksum(spark.createDataFrame(a, "x string, y string"))) != text(integrity.checksum(spark.createDataFrame(b, "x string, y string")))


def test_checksum_of_a_run_is_the_sum_of_its_files(spark, scratch):
    ts = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(f"c{i}", f"n{i}", f"e{i}", "x", "y", ts) for i in range(500)], lake.RAW["customers"]).repartition(6)
    df.write.parquet(scratch + "/t")
    read = spark.read.schema(df.schema).parquet(scratch + "/t")
    files = integrity.file_checksums(read)
    assert files.count() == 6
    assert text(integrity.combined(files)) == text(integrity.checksum(df)) and text(integrity.combined(files)).rows == 500
