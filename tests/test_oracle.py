"""Every registered query against its DuckDB oracle statement (sf0.001)."""

import pytest

from oracle_compare import compare

SF = "/root/testdata/sf0.001"


def test_registered_queries_match_oracle(spark):
    res = compare(spark, SF)
    errors = {k: v for k, v in res.items() if "error" in v}
    mismatched = {k: v for k, v in res.items() if v.get("match") is False}
    assert not errors, errors
    assert not mismatched, mismatched


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "revenue" in df.columns
