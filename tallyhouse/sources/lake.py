"""Raw lake runs: immutable, checksummed Parquet snapshots.

A run lives under ``<lake>/run_date=<yyyy-MM-dd>/run_id=<id>/`` with one
folder per table (zstd Parquet, rows range-partitioned and sorted by ``id`` so
a rewrite of the same data is byte-identical). The manifest has two parts:
``manifest_files`` holds one JSON line per lake file (name, size, SHA-256,
rows), written by the executors that hashed the files, and ``manifest`` is a
one-row header (ids, versions, row counts, number of files) written last as
the commit marker. The file list never passes through one task or the
driver, however many files a run has. A prefix that already holds anything
is refused: runs are append-only.

Hashes are computed by Spark: the ``binaryFile`` source reads each Parquet
file as one row and ``sha2(content, 256)`` hashes it on the executors. A file
is one row in memory, so the writer caps file size with ``maxRecordsPerFile``.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PIPELINE_VERSION, RAW_TABLES, SCHEMA_VERSION
from ..schemas import RAW
from ..session import scratch_root
from .commit_log import create_if_absent, utc_now
from .warehouse import delete_tree, path_exists

MAX_RECORDS_PER_FILE = 2_000_000
MANIFEST = "manifest"
MANIFEST_FILES = "manifest_files"
CLAIMS = "_claims"

MANIFEST_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_date", T.StringType()),
    T.StructField("prefix", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("pipeline_version", T.StringType()),
    T.StructField("extracted_at", T.StringType()),
    T.StructField("source", T.StructType([T.StructField("system", T.StringType()),
                                          T.StructField("tables", T.ArrayType(T.StringType()))])),
    T.StructField("row_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("file_count", T.LongType()),
])

MANIFEST_FILE_SCHEMA = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("size_bytes", T.LongType()),
    T.StructField("sha256", T.StringType()), T.StructField("row_count", T.LongType()),
])


class LakeError(RuntimeError):
    pass


class LakeRun(NamedTuple):
    run_id: str
    run_date: str
    prefix: str
    row_counts: dict[str, int]


def run_prefix(lake_root: str, run_date: str, run_id: str) -> str:
    return f"{lake_root.rstrip('/')}/run_date={run_date}/run_id={run_id}"


def assert_prefix_unused(spark: SparkSession, prefix: str) -> None:
    if path_exists(spark, prefix):
        raise LakeError(f"lake prefix already used: {prefix}")


def write_table(df: DataFrame, path: str) -> None:
    """Deterministic layout: range-partitioned and sorted on ``id``."""
    (df.repartitionByRange("id").sortWithinPartitions("id")
     .write.mode("errorifexists")
     .option("compression", "zstd")
     .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .option("parquet.enable.dictionary", "true")
     .parquet(path))


def _norm_path(c) -> F.Column:
    """``file:/x`` and ``file:///x`` name the same file."""
    return F.regexp_replace(c, r"^file:/+", "file:/")


def file_hashes(spark: SparkSession, table_dir: str) -> DataFrame:
    """(path, size_bytes, sha256) for every Parquet file under ``table_dir``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(table_dir))
    return files.select(_norm_path(F.col("path")).alias("path"),
                        F.col("length").alias("size_bytes"),
                        F.sha2(F.col("content"), 256).alias("sha256"))


def file_row_counts(spark: SparkSession, table_dir: str, schema: T.StructType) -> DataFrame:
    df = spark.read.schema(schema).parquet(table_dir)
    return (df.select(_norm_path(F.col("_metadata.file_path")).alias("path"))
            .groupBy("path").agg(F.count(F.lit(1)).alias("row_count")))


def manifest_files(spark: SparkSession, prefix: str) -> DataFrame:
    """One row per lake file: table, name, key, size, sha256, rows."""
    frames = []
    for table in RAW_TABLES:
        tdir = f"{prefix}/{table}"
        hashes = file_hashes(spark, tdir)
        counts = file_row_counts(spark, tdir, RAW[table])
        frames.append(hashes.join(counts, "path", "left").select(
            F.lit(table).alias("table"),
            F.concat(F.lit(table + "/"), F.element_at(F.split("path", "/"), -1)).alias("name"),
            F.col("path").alias("key"), "size_bytes", "sha256",
            F.coalesce(F.col("row_count"), F.lit(0)).cast("long").alias("row_count")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def upload_run(spark: SparkSession, raw: dict[str, DataFrame], lake_root: str,
               run_date: str, run_id: str, extracted_at: str | None = None,
               system: str = "parquet") -> LakeRun:
    """Write the four tables, then the manifest (the commit marker)."""
    prefix = run_prefix(lake_root, run_date, run_id)
    assert_prefix_unused(spark, prefix)
    # The check alone lets two writers pass; only one of them can make the claim.
    if not create_if_absent(spark, f"{lake_root.rstrip('/')}/{CLAIMS}/run_date={run_date}/run_id={run_id}", utc_now()):
        raise LakeError(f"lake prefix already claimed: {prefix}")
    # The four tables are independent jobs: submit them together so small
    # tables do not wait behind the line table (jobs share the cluster's slots).
    with ThreadPoolExecutor(max_workers=len(RAW_TABLES)) as pool:
        for f in [pool.submit(write_table, raw[t], f"{prefix}/{t}") for t in RAW_TABLES]:
            f.result()
    # File entries: hashed and written by the executors, then read back so the
    # files are hashed once; only four per-table totals reach the driver.
    manifest_files(spark, prefix).write.mode("errorifexists").json(f"{prefix}/{MANIFEST_FILES}")
    entries = spark.read.schema(MANIFEST_FILE_SCHEMA).json(f"{prefix}/{MANIFEST_FILES}")
    per_table = entries.groupBy("table").agg(F.sum("row_count").alias("n"),
                                             F.count(F.lit(1)).alias("files")).collect()
    row_counts = {t: 0 for t in RAW_TABLES}
    row_counts.update({r["table"]: int(r["n"]) for r in per_table})
    file_count = sum(int(r["files"]) for r in per_table)
    extracted_at = extracted_at or _dt.datetime.now(_dt.timezone.utc).isoformat(timespec="seconds")
    header = spark.createDataFrame(
        [(run_id, run_date, prefix, SCHEMA_VERSION, PIPELINE_VERSION, extracted_at,
          (system, list(RAW_TABLES)), row_counts, file_count)], MANIFEST_SCHEMA)
    header.coalesce(1).write.mode("errorifexists").json(f"{prefix}/{MANIFEST}")
    return LakeRun(run_id, run_date, prefix, row_counts)


def read_manifest(spark: SparkSession, prefix: str) -> DataFrame:
    """The manifest header as one row; a missing or malformed header raises."""
    path = f"{prefix}/{MANIFEST}"
    if not path_exists(spark, path):
        raise LakeError(f"no manifest under {prefix}")
    m = spark.read.schema(MANIFEST_SCHEMA).json(path)
    ok = m.where(F.col("run_id").isNotNull() & F.col("file_count").isNotNull())
    if ok.limit(2).count() != 1:
        raise LakeError(f"manifest under {prefix} is not a manifest object")
    return m


def manifest_entries(spark: SparkSession, prefix: str) -> DataFrame:
    """The manifest's file entries of a committed run (header present)."""
    read_manifest(spark, prefix)
    return spark.read.schema(MANIFEST_FILE_SCHEMA).json(f"{prefix}/{MANIFEST_FILES}")


def verify_run(spark: SparkSession, prefix: str) -> None:
    """Re-hash every file; any missing, extra or changed file aborts, and so
    does a file list whose size differs from the header's count."""
    header = read_manifest(spark, prefix)
    entries = manifest_entries(spark, prefix)
    listed = entries.select(F.col("key").alias("path"), F.col("sha256").alias("expected"))
    actual = None
    for table in RAW_TABLES:
        h = file_hashes(spark, f"{prefix}/{table}")
        actual = h if actual is None else actual.unionByName(h)
    bad = (listed.join(actual, "path", "full_outer")
           .where(F.col("expected").isNull() | F.col("sha256").isNull()
                  | (F.col("expected") != F.col("sha256"))))
    found = f"{scratch_root(spark)}/lake-verification/{uuid.uuid4().hex}"
    try:
        bad.select("path", "expected", "sha256").write.parquet(found)
    except Exception as e:  # a file that cannot even be read back is corrupt too
        raise LakeError(f"lake files under {prefix} cannot be read back: {e}") from e
    report = spark.read.parquet(found)
    count = report.count()
    if count:  # the whole list stays in the table; the message names the first
        raise LakeError(f"{count} lake files fail verification, listed in {found}, "
                        f"first {report.agg(F.min('path')).first()[0]}")
    delete_tree(spark, found)
    want = header.select("file_count").first()[0]
    if entries.count() != want:
        raise LakeError(f"manifest under {prefix} lists a different number of files than {want}")


def lake_runs(spark: SparkSession, lake_root: str) -> DataFrame:
    """One row per committed run under ``lake_root``: the ``run_date`` and
    ``run_id`` partition values of its prefix, when it was extracted, how many
    files and rows it holds. A run without a manifest header (a write that
    did not finish) is not listed."""
    root = lake_root.rstrip("/")
    headers = (spark.read.schema(MANIFEST_SCHEMA).option("basePath", root)
               .json(f"{root}/run_date=*/run_id=*/{MANIFEST}"))
    return headers.select(
        "run_date", "run_id", "extracted_at", "file_count",
        F.aggregate(F.map_values("row_counts"), F.lit(0).cast("long"),
                    lambda acc, x: acc + x).alias("rows"))


def read_run(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """The four tables of a run, with their declared schemas."""
    return {t: spark.read.schema(RAW[t]).parquet(f"{prefix}/{t}") for t in RAW_TABLES}
