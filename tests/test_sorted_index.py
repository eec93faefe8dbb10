"""Deep pages, lookups and substring search against the plain scans; what they open."""

import datetime as dt
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import operational as O
from tallyhouse.operators.substring_index import SubstringIndex
from tallyhouse.sources import testdata
from tallyhouse.sources.sorted_table import SortedTable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = SortedTable.build(testdata.stg_order_items(spark, SF), str(tmp_path_factory.mktemp("sorted")), [("id", False)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return table, sorted(r.id for r in testdata.stg_order_items(spark, SF).select("id").collect())


def test_pages_equal_the_global_order(spark, lines):
    table, ids = lines
    assert table.total() == len(ids) and table.directory().count() == 9
    ends = [r.start for r in table.directory().collect()]
    for offset, limit in [(0, 1), (0, 200), (len(ids) - 3, 50), (len(ids), 50), (10 ** 9, 5), (max(ends) - 7, 20), (max(ends), 20), *[(random.Random(i).randrange(len(ids)), 37) for i in range(4)]]:
        assert [r.id for r in table.page(limit, offset).collect()] == ids[offset:offset + limit]
    with pytest.raises(ValueError):
        table.page(0)


def test_a_deep_page_opens_the_files_that_hold_it(lines):
    table, ids = lines
    assert len(table.page(50, len(ids) * 5 // 6).inputFiles()) <= 2
    assert len(table.page(1, len(ids) - 1).inputFiles()) == 1


def test_a_lookup_opens_one_file_and_one_row_group(lines):
    table, ids = lines
    for wanted in (ids[0], ids[len(ids) // 2], ids[-1]):
        found = table.find(wanted)
        assert [r.id for r in found.collect()] == [wanted]
        files = found.inputFiles()
        assert len(files) == 1
        groups = pq.ParquetFile(files[0].removeprefix("file://")).metadata
        holds = []
        for g in range(groups.num_row_groups):
            col = next(groups.row_group(g).column(c) for c in range(groups.num_columns) if groups.row_group(g).column(c).path_in_schema == "id")
            holds.append(col.statistics.min <= wanted <= col.statistics.max)
        assert holds.count(True) == 1
    assert table.find("nothing").count() == 0 and table.find(ids[5] + "0").count() == 0


def test_descending_order_and_ties(spark, scratch):
    rows = [(f"o{i:03d}", dt.date(2026, 1, 1 + i % 4), i % 3) for i in range(300)]
    table = SortedTable.build(spark.createDataFrame(rows, "id string, day date, n int").repartition(5), scratch + "/t", [("day", True), ("n", False), ("id", False)])
    want = sorted(rows, key=lambda r: (-r[1].toordinal(), r[2], r[0]))
    assert [tuple(r) for r in table.page(200, 50).collect()] == want[50:250]
    assert table.find(dt.date(2026, 1, 2)).count() == 75
    empty = SortedTable.build(spark.createDataFrame([], "id string"), scratch + "/e", [("id", False)])
    assert empty.page(10).count() == 0 and empty.find("x").count() == 0 and empty.total() == 0
    with pytest.raises(LookupError):
        SortedTable(spark, scratch + "/missing")


def test_search_equals_the_scan_on_random_needles(spark, scratch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcÄß .@") for _ in range(rng.randrange(0, 14)))
    rows = [(f"c{i:03d}", word(), None if i % 11 == 0 else word().upper(), word(), dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i * 7919 % 5000)) for i in range(250)]
    people = spark.createDataFrame(rows, "id string, name string, email string, city string, created_at timestamp_ntz")
    index = SubstringIndex.build(people, scratch + "/i", ["name", "email", "city"])
    needles = [None, "", "  ", "a", "ab", "zzzz", "ß c"] + [(rng.choice(rows)[rng.randrange(1, 4)] or "ab")[:rng.randrange(2, 9)] for _ in range(25)] + ["abcabc", "ABC", "Äß"]
    for needle in needles:
        got = [r.id for r in O.customer_search_indexed(index, people, needle).collect()]
        assert got == [r.id for r in O.customer_search(people, needle).collect()], needle


def test_search_reads_rare_lists_only(spark, scratch):
    people = spark.createDataFrame([(str(i), f"name{i}", f"u{i}@example.com") for i in range(500)], "id string, name string, email string")
    index = SubstringIndex.build(people, scratch + "/i", ["name", "email"])
    assert [r.id for r in index.candidates("u137@example.com").collect()] == ["137"]
    assert index.candidates("xq").__class__ is type(None) and index.candidates("qqq").count() == 0
    assert index.search(people, ["name", "email"], "example").count() == 500
