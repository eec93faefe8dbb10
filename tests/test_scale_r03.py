"""What a step moves or holds at size: the gate's keys, ranks, positions, roll-ups, merges, training."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import keys
from tallyhouse.operators import quality, rollup
from tallyhouse.operators.star import build_star


@pytest.fixture(scope="module")
def star(spark):
    from fixtures_f1 import F1, raw_frames
    raw = raw_frames(spark, F1)
    built = build_star(raw)
    return type(built)(*[spark.createDataFrame(d.collect(), d.schema) for d in built]), raw


def test_gate_deals_line_keys_before_it_counts_them(star):
    s, raw = star
    report = quality.quality_report(s.dim_customer, s.dim_product, s.dim_date, s.fact_sales, raw["orders"], raw["order_items"], rows=quality.KEYS_A_TASK)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [kind" in plan and plan.split("RepartitionByExpression [kind")[1].splitlines()[0].endswith("3")


def test_gate_counts_references_of_a_dimension_with_a_gap(star):
    """Keys inside the span of a dimension that does not hold them all are counted one by one."""
    s, raw = star
    two = s.dim_customer.where("customer_key = 2")
    spread = s.dim_customer.where("customer_key = 1").unionByName(two.withColumn("customer_key", F.lit(9).cast("long")))
    for key, want in ((5, 3), (9, 0), (10, 3)):
        fact = s.fact_sales.withColumn("customer_key", F.lit(key).cast("long"))
        rows = quality.quality_report(spread, s.dim_product, s.dim_date, fact, raw["orders"], raw["order_items"]).collect()
        assert {r.check: r.affected for r in rows if not r.passed} == ({"fact_joins_customer": want} if want else {})


def test_ranked_rows_are_slim(spark, f1, monkeypatch):
    """The copy that fixes the sale keys is compressed and holds no derived column."""
    seen = []
    real = keys.ranked_key
    monkeypatch.setattr("tallyhouse.operators.star.ranked_key", lambda df, by, name, *a: (seen.append(df.columns), real(df, by, name, *a))[1])
    star = build_star(f1)
    assert "revenue" not in seen[-1]
    assert all(f.endswith(".zstd.parquet") for f in star.fact_sales.inputFiles() if "/ranked/" in f)


@pytest.mark.parametrize("limit", [2, 10_000])
def test_positions_with_and_without_hot_groups(spark, monkeypatch, limit):
    rows = [("a", i) for i in (3, 1, 2)] + [("b", 7), ("b", None), ("c", 5), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g string, id int")
    monkeypatch.setattr(keys, "HOT_GROUP", limit)
    ranked, real = [], keys.ranked_key
    monkeypatch.setattr(keys, "ranked_key", lambda d, *a: (ranked.append(sorted(r.g for r in d.collect())), real(d, *a))[1])
    got = keys.position_within(df, "g", "id", "pos")
    want = df.where("g is not null").select("g", "id", (F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1).cast("int").alias("pos"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert ranked == ([["a", "a", "a"]] if limit == 2 else [])  # only a hot group is written and ranked


def test_rollup_counts_orders_in_one_aggregation(spark, star):
    s, _ = star
    wh = rollup.Warehouse(spark, "", "", s.dim_customer, s.dim_product, s.dim_date, s.fact_sales, None)
    plan = rollup._daily(wh)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "distinct" not in plan


def test_merge_reads_a_bucket_without_a_join(spark, scratch, f1, monkeypatch):
    from tallyhouse.sources.order_store import OrderStore
    store = OrderStore(spark, scratch + "/store", buckets=2)
    orders = f1["orders"]
    none = orders.limit(1).withColumn("id", F.lit(None).cast("string"))
    store.create(f1 | {"orders": orders.unionByName(orders.where("id = 'o-1'")).unionByName(none)})
    first = orders.orderBy("id").first()["id"]
    new = orders.where(F.col("id") == first).withColumn("status", F.lit("shipped")).unionByName(none)
    monkeypatch.setattr(DataFrame, "join", lambda *a, **k: pytest.fail("a merge joins"))
    layout = store._merge("orders", store.log.entry(1)["layout"]["orders"], new, "t")
    monkeypatch.undo()
    rows = store._read("orders", list(layout.values())).collect()
    assert [r.status for r in rows if r.id == first] == ["shipped"]
    assert sum(r.id is None for r in rows) == 2  # a row without a key replaces nothing
    assert {r.id for r in rows} == {r.id for r in orders.collect()} | {None}


def test_training_holds_each_part_once():
    from tallyhouse.llm import toxicity
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(300)]
    tracemalloc.start()
    try:
        table, bias = toxicity.train(texts, np.arange(300) % 4 == 0, toxicity.Params(steps=2))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert table.shape == (1 << 17,) and np.isfinite(bias)
    assert peak < 210e6  # 183 MB; 233 MB when lists, joined and filtered copies were held together


def test_training_drops_texts_and_words_as_it_reads_them():
    import pyarrow as pa

    from tallyhouse.llm import toxicity
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(3000)]
    labels = np.arange(1200) % 4 == 0

    def text(i: int) -> str:
        r = np.random.default_rng(i)
        return " ".join([*r.choice(words, 150), *("".join(r.choice(list("qrstuvw"), 12)) for _ in range(10))])

    def batches():
        for at in range(0, 1200, 300):
            yield pa.RecordBatch.from_pydict({"text": [text(i) for i in range(at, at + 300)], "toxic": labels[at: at + 300].astype(int)})

    p = toxicity.Params(steps=2)
    tracemalloc.start()
    try:
        [row] = pa.Table.from_batches(toxicity.learn(batches(), p)).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    table, bias = toxicity.train([text(i) for i in range(1200)], labels, p)
    assert row["logits"] == table.tobytes() and row["bias"] == bias
    assert peak < 80e6  # 52 MB; 124 MB when texts and their counters were held together
    assert list(toxicity.learn(iter([]), p)) == []


def test_texts_are_hashed_in_slices_of_few_bytes():
    import pyarrow as pa

    from tallyhouse.llm import ngram_join
    texts = [None, "", "a b c d e f", "x" * 300_000, *("y z " * 40_000 for _ in range(3)), *("w" * 10 for _ in range(600))]
    rows = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(ngram_join._slices(rows))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or p.num_rows <= 256 and sum(len(t or "") for t in p.column("text").to_pylist()) <= ngram_join.STEP_BYTES for p in parts)
    sets = [s for _, found in ngram_join._sets(iter([rows]), 5) for s in found]
    assert all((a == b).all() for a, b in zip(sets, ngram_join.shingle_sets(texts), strict=True))
    pairs = pa.RecordBatch.from_pydict({"a": [1, 2], "b": [3, 4], "text_a": ["a b c d e f", "p q r s t"], "text_b": ["A b c d e f", "u v w x y"]})
    assert [r for b in ngram_join._verify(iter([pairs]), 5, 80) for r in b.to_pylist()] == [{"a": 1, "b": 3}]
    assert list(ngram_join._slices(rows.slice(0, 0))) == []


def test_scratch_gives_batch_rows_back(spark, scratch):
    from tallyhouse.llm.common import Scratch
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    frame = spark.range(2500, numPartitions=1).mapInArrow(sizes, "n long")
    assert sorted(r.n for r in Scratch(spark, "few", 1000).cut(frame, "t").collect()) == [500, 1000, 1000]
    assert spark.conf.get(name) == usual
    assert [r.n for r in Scratch(spark, "many").cut(frame, "t").collect()] == [2500]
