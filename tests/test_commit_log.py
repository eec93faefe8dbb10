"""Commit log, versions of the warehouse, one active run."""

import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from fixtures_f1 import F1, raw_frames
from tallyhouse.plans.pipeline import build_and_publish, published, run_with_audit
from tallyhouse.sources import run_slot
from tallyhouse.sources.commit_log import CommitConflict, CommitLog, VersionExpired, create_if_absent
from tallyhouse.sources.lake import LakeError, upload_run
from tallyhouse.sources.warehouse import expire, open_warehouse, version_counts


def test_create_if_absent_has_one_winner(spark, scratch):
    path = scratch + "/a/b.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: create_if_absent(spark, path, f"writer {i}"), range(24)))
    assert won.count(True) == 1
    assert open(path).read() == f"writer {won.index(True)}"
    assert [f for f in os.listdir(scratch + "/a") if "tmp" in f] == []


def test_of_two_commits_on_one_version_one_conflicts(spark, scratch):
    log = CommitLog(spark, scratch)
    assert log.latest() == 0 and log.entry(0) is None
    assert log.commit({"who": "a"}, 0) == 1
    with pytest.raises(CommitConflict):
        log.commit({"who": "b"}, 0)
    assert log.entry(1)["who"] == "a" and log.entry(1)["base"] == 0


def test_retrying_prepares_anew_and_loses_nothing(spark, scratch):
    def add(i):
        return CommitLog(spark, scratch).retrying(
            lambda base, entry: {"sum": (entry or {"sum": 0})["sum"] + i, "i": i}, tries=40, wait=0.01)
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(add, range(1, 13)))
    log = CommitLog(spark, scratch)
    assert sorted(versions) == list(range(1, 13)) and log.entry(12)["sum"] == 78
    assert log.frame("version long, i long").agg({"i": "sum"}).first()[0] == 78
    assert log.retrying(lambda base, entry: None) is None and log.latest() == 12


def test_concurrent_builds_one_commits_one_conflicts(spark, scratch):
    """Both start from the same version; the slower one must not undo the other."""
    started = []

    def build(name):
        frames = raw_frames(spark, F1)
        started.append(name)
        try:
            return build_and_publish(spark, frames, scratch, run_id=name).published
        except CommitConflict:
            return "conflict"
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(build, ["run-a", "run-b"]))
    assert sorted(map(str, got)) == ["True", "conflict"]
    winner = ["run-a", "run-b"][got.index(True)]
    assert published(spark, scratch).version == f"version={winner}"
    assert os.listdir(scratch + "/warehouse") and len([d for d in os.listdir(scratch + "/warehouse") if d.startswith("version=")]) == 1


def test_older_versions_stay_readable_until_expired(spark, scratch, f1):
    root = scratch + "/warehouse"
    build_and_publish(spark, f1, scratch, run_id="one")
    less = dict(f1) | {"order_items": f1["order_items"].where("id <> 'i-2'")}
    build_and_publish(spark, less, scratch, run_id="two")
    assert open_warehouse(spark, root).fact_sales.count() == 2
    assert open_warehouse(spark, root, version=1).fact_sales.count() == 3
    assert open_warehouse(spark, root, version=7) is None
    rows = {(r.version, r.table): (r.base, r.recorded, r.rows) for r in version_counts(spark, root).collect()}
    assert rows[(1, "fact_sales")] == (0, 3, 3) and rows[(2, "fact_sales")] == (1, 2, 2) and len(rows) == 8
    assert expire(spark, root, keep=1) == [1] and expire(spark, root, keep=1) == []
    with pytest.raises(VersionExpired):
        open_warehouse(spark, root, version=1)
    assert open_warehouse(spark, root).fact_sales.count() == 2 and CommitLog(spark, root).entry(1)["run_id"] == "one"
    with pytest.raises(ValueError):
        expire(spark, root, keep=0)


def test_unreadable_or_dangling_version_is_not_ready(spark, scratch):
    log = CommitLog(spark, scratch + "/warehouse")
    log.commit({"folder": "version=gone"}, 0)
    assert published(spark, scratch) is None
    open(f"{log.path}/{2:020d}.json", "w").close()
    assert published(spark, scratch) is None


def test_lake_prefix_has_one_writer(spark, scratch, f1):
    with ThreadPoolExecutor(2) as pool:
        futures = [pool.submit(upload_run, spark, f1, scratch, "2026-01-01", "same") for _ in range(2)]
        errors = [f.exception() for f in futures]
    assert sum(e is None for e in errors) == 1 and sum(isinstance(e, LakeError) for e in errors) == 1


def test_one_active_run(spark, scratch, f1):
    log = scratch + "/audit"
    run_slot.claim(spark, log, "r1")
    assert run_slot.holder(spark, log) == "r1"
    with pytest.raises(run_slot.ConcurrentRun, match="r1"):
        run_with_audit(spark, f1, scratch, log, run_id="r2")
    assert not os.path.exists(scratch + "/warehouse")
    assert run_slot.release(spark, log, "r2") is False
    with pytest.raises(run_slot.ConcurrentRun):
        run_slot.claim(spark, log, "r3", stale_after=dt.timedelta(hours=1))
    run_slot.claim(spark, log, "r3", stale_after=dt.timedelta(0))
    assert run_slot.release(spark, log, "r1") is False and run_slot.release(spark, log, "r3") is True
    assert run_with_audit(spark, f1, scratch, log, run_id="r4").published and run_slot.holder(spark, log) is None


def test_claims_at_one_moment(spark, scratch):
    def claim(i):
        try:
            run_slot.claim(spark, scratch, f"r{i}")
            return True
        except run_slot.ConcurrentRun:
            return False
    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(claim, range(12))) == 1
