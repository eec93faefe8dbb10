"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Comparison: same column names (sorted), same row count, and the same multiset
of rows after normalising values (floats compared exactly as repr, None kept).

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    return str(v)


def _key(row):
    return tuple((v is None, "" if v is None else v) for v in row)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)


def rows_of_duck(con, q):
    cur = con.execute(q)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=_key)


def compare(spark, sf_dir: str, names: list[str] | None = None) -> dict:
    import __spark_entry__ as E
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t = time.time()
        rec = {}
        try:
            scols, srows = rows_of_spark(qs[name](spark, sf_dir))
            rec["rows"] = len(srows)
            if name in os_:
                dcols, drows = rows_of_duck(con, os_[name])
                rec["cols_match"] = scols == dcols
                rec["match"] = scols == dcols and srows == drows
                if not rec["match"]:
                    rec["spark_cols"], rec["duck_cols"] = scols, dcols
                    rec["duck_rows"] = len(drows)
                    dset, sset = set(drows), set(srows)
                    diff_s = [r for r in srows if r not in dset][:3]
                    diff_d = [r for r in drows if r not in sset][:3]
                    rec["spark_only"], rec["duck_only"] = diff_s, diff_d
            else:
                rec["match"] = None
        except Exception as e:  # report and continue
            rec["error"] = f"{type(e).__name__}: {str(e)[:400]}"
        rec["sec"] = round(time.time() - t, 2)
        out[name] = rec
        print(name, json.dumps(rec, default=str), flush=True)
    return out


if __name__ == "__main__":
    from tallyhouse.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v.get("match") is False or "error" in v]
    print("FAILED:", bad)
