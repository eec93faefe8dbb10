"""The published warehouse: immutable version folders under a commit log.

Layout under a warehouse root::

    <root>/version=<run_id>/dim_customer/ ... /fact_sales/ (partitioned by sale_month)
    <root>/version=<run_id>/warehouse_metadata/
    <root>/_commits/<version>.json    one entry per published version (``commit_log``)

A build remembers the newest version when it starts, writes a new version
folder, is gated there, and only then commits the next version. Of two builds
that started from one version the first to commit wins; the other gets a
conflict and its folder is removed. Readers resolve the version once per query,
so a reader never sees a half-written or failed build. Older versions stay
readable by their number until :func:`expire` removes their folders. No version
(or an unreadable one) means "not ready".
"""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STAR_TABLES
from ..schemas import STAR

POINTER = "_CURRENT"


class Warehouse(NamedTuple):
    spark: SparkSession
    path: str
    version: str
    dim_customer: DataFrame
    dim_product: DataFrame
    dim_date: DataFrame
    fact_sales: DataFrame
    metadata: DataFrame

    def published_at(self) -> str | None:
        row = self.metadata.where(F.col("key") == "published_at").select("value").first()
        return row[0] if row else None


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm


def read_text(spark: SparkSession, path: str) -> str | None:
    """Small text file through the Hadoop file system (works on any scheme)."""
    fs, hpath, jvm = _hadoop_fs(spark, path)
    if not fs.exists(hpath):
        return None
    stream = fs.open(hpath)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        return None if line is None else str(line).strip()
    finally:
        stream.close()


def write_text_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` to a temporary sibling, then rename over ``path``."""
    fs, hpath, jvm = _hadoop_fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(path + ".tmp-" + os.urandom(6).hex())
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    # One atomic rename over the old pointer: a reader sees the old or the new
    # version, and a crash before it leaves the old one published.
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fs.makeQualified(tmp), fs.makeQualified(hpath), over)


def delete_tree(spark: SparkSession, path: str) -> None:
    fs, hpath, _ = _hadoop_fs(spark, path)
    fs.delete(hpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath, _ = _hadoop_fs(spark, path)
    return bool(fs.exists(hpath))


def table_path(version_dir: str, table: str) -> str:
    return f"{version_dir.rstrip('/')}/{table}"


def open_version(spark: SparkSession, version_dir: str) -> Warehouse:
    def rd(name: str) -> DataFrame:
        path = table_path(version_dir, name)
        if name == "warehouse_metadata" and not path_exists(spark, path):
            return spark.createDataFrame([], STAR[name])  # stamped only at publish
        return spark.read.schema(_read_schema(name)).parquet(path)
    return Warehouse(spark, version_dir, version_dir.rstrip("/").rsplit("/", 1)[-1],
                     rd("dim_customer"), rd("dim_product"), rd("dim_date"),
                     rd("fact_sales"), rd("warehouse_metadata"))


def _read_schema(name: str):
    from pyspark.sql import types as T
    schema = STAR[name]
    if name == "fact_sales":
        schema = T.StructType(schema.fields + [T.StructField("sale_month", T.IntegerType(), True)])
    return schema


def open_warehouse(spark: SparkSession, root: str, version: int | None = None) -> Warehouse | None:
    """The newest published version, or the one numbered ``version``.

    ``None`` when nothing usable is published. A version asked for by number
    that retention has removed raises ``VersionExpired``."""
    from .commit_log import CommitLog, VersionExpired
    log = CommitLog(spark, root)
    entry = log.entry(version or log.latest())
    if not entry or not entry.get("folder"):
        return None
    version_dir = f"{root.rstrip('/')}/{entry['folder']}"
    if not all(path_exists(spark, f"{table_path(version_dir, t)}/_SUCCESS")
               for t in (*STAR_TABLES, "warehouse_metadata")):
        if version is not None and not path_exists(spark, version_dir):
            raise VersionExpired(f"version {version} of {root} is no longer kept")
        return None
    return open_version(spark, version_dir)


def publish_version(spark: SparkSession, root: str, folder: str, base: int, **fields) -> int:
    """Commit ``folder`` as the version after ``base``; on a conflict the folder
    is removed and ``CommitConflict`` is raised."""
    from .commit_log import CommitConflict, CommitLog
    try:
        return CommitLog(spark, root).commit({"folder": folder, **fields}, base)
    except CommitConflict:
        delete_tree(spark, f"{root.rstrip('/')}/{folder}")
        raise


def expire(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Remove the data of all but the newest ``keep`` versions; their entries
    stay in the log. Returns the versions whose data was removed."""
    from .commit_log import CommitLog
    if keep < 1:
        raise ValueError("at least the newest version is kept")
    log, gone = CommitLog(spark, root), []
    versions = log.versions()
    kept = {(log.entry(v) or {}).get("folder") for v in versions[-keep:]}
    for v in versions[:-keep]:
        folder = (log.entry(v) or {}).get("folder")
        if folder and folder not in kept and path_exists(spark, f"{root.rstrip('/')}/{folder}"):
            delete_tree(spark, f"{root.rstrip('/')}/{folder}")
            gone.append(v)
    return gone


def version_counts(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable version and star table: the rows its commit recorded
    and the rows its files hold."""
    from functools import reduce

    from .commit_log import CommitLog
    log, frames = CommitLog(spark, root), []
    for v in log.versions():
        entry = log.entry(v) or {}
        if not entry.get("folder") or not path_exists(spark, f"{root.rstrip('/')}/{entry['folder']}"):
            continue
        wh = open_version(spark, f"{root.rstrip('/')}/{entry['folder']}")
        frames += [getattr(wh, t).agg(F.count(F.lit(1)).cast("long").alias("rows")).select(
            F.lit(v).cast("long").alias("version"), F.lit(entry["base"]).cast("long").alias("base"), F.lit(t).alias("table"),
            F.lit(entry.get("counts", {}).get(t)).cast("long").alias("recorded"), "rows") for t in STAR_TABLES]
    if not frames:
        return spark.createDataFrame([], "version long, base long, table string, recorded long, rows long")
    return reduce(lambda a, b: a.unionByName(b), frames)
