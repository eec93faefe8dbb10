"""The operational tables as a store that intake batches are committed to.

Every table is split into ``buckets`` by a hash of its key (lines by their
order, so an order and its lines change together). A commit is copy-on-write:
only the buckets that receive rows are read, merged and written to new folders;
the entry of the commit log names the live folder of every bucket of every
table, so a reader sees all tables of one version and nothing in between.

* Orders are all-or-nothing: :func:`operators.intake.order_intake` decides on the tables of
  the version the commit is based on; a conflicting commit decides anew.
* A batch has an id. An id the log already holds is a repeat and changes nothing.
* Ids of new rows are UUID-shaped and follow from the batch id and the row's
  place in the batch, so a batch that is prepared twice makes the same rows.
* Rows with a key that exists are replaced, all others are added.

The driver handles bucket numbers and folder names, at most ``buckets`` a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RAW_TABLES
from ..functions.keys import materialize
from ..operators import intake
from ..schemas import RAW, conform
from .commit_log import CommitConflict, CommitLog
from .warehouse import _hadoop_fs, delete_tree, path_exists

BUCKETS = 64
#: The column whose hash gives the bucket.
BUCKET_KEY = {"customers": "id", "products": "id", "orders": "id", "order_items": "order_id"}


class Applied(NamedTuple):
    version: int | None        # None: the batch had been applied before
    verdict: DataFrame | None  # one row per proposal: accepted, issues


def row_id(batch: str, *place: Column | str) -> Column:
    """UUID-shaped text from the SHA-256 of ``batch:place:…``."""
    h = F.sha2(F.concat_ws(":", F.lit(batch), *[F.col(p).cast("string") if isinstance(p, str) else p for p in place]), 256)
    part = lambda start, n: F.substring(h, start, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


class OrderStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.log = CommitLog(spark, root)

    # -- reading

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The four tables of the newest (or the given) version."""
        entry = self.log.entry(version or self.log.latest())
        if entry is None:
            raise LookupError(f"no version {version or ''} in {self.root}")
        return {t: self._read(t, list(entry["layout"][t].values())) for t in RAW_TABLES}

    def _read(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], RAW[table])
        return self.spark.read.schema(RAW[table]).parquet(*[f"{self.root}/{f}" for f in sorted(folders)])

    def applied(self, batch: str) -> bool:
        return bool(self.log.latest()) and self.log.frame("batch string").where(F.col("batch") == batch).limit(1).count() > 0

    # -- writing

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(BUCKET_KEY[table]), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame, token: str) -> str:
        """Bucket folders of ``rows``. A range over (bucket, id) lets a large bucket
        be several tasks, and a task write few buckets. With a column ``_new``, rows
        that are not new give way to new ones of their key (and bucket)."""
        folder = f"data/{table}/commit={token}"
        placed = rows.withColumn("bucket", self._bucket(table)).repartitionByRange("bucket", "id")
        if "_new" in rows.columns:
            # the rows of one key lie in one task by now: no join, no second shuffle
            replaced = F.max("_new").over(Window.partitionBy("bucket", "id"))
            placed = (placed.withColumn("_replaced", replaced)
                      .where(F.col("_new") | ~F.col("_replaced") | F.col("id").isNull()).drop("_new", "_replaced"))
        (placed.sortWithinPartitions("bucket", "id")
         .write.mode("errorifexists").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{folder}"))
        return folder

    def _buckets_of(self, folder: str) -> list[str]:
        fs, hpath, _ = _hadoop_fs(self.spark, f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(hpath)]
        return [n.split("=", 1)[1] for n in names if n.startswith("bucket=")]

    def _merge(self, table: str, layout: dict[str, str], new: DataFrame, token: str) -> dict[str, str]:
        """The layout after ``new`` has been merged into the buckets it touches."""
        new = materialize(conform(new, RAW[table]), f"new-{table}")
        touched = [str(r[0]) for r in new.select(self._bucket(table)).distinct().collect()]
        if not touched:
            return layout
        old = self._read(table, [layout[b] for b in touched if b in layout])
        both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        folder = self._write(table, both, token)
        return layout | {b: f"{folder}/bucket={b}" for b in touched}

    def _drop(self, token: str) -> None:
        for t in RAW_TABLES:
            delete_tree(self.spark, f"{self.root}/data/{t}/commit={token}")

    def expire(self, keep: int) -> int:
        """Remove the folders that none of the newest ``keep`` versions names; their number."""
        if keep < 1:
            raise ValueError("at least the newest version is kept")
        live = {f for v in self.log.versions()[-keep:] for t in RAW_TABLES for f in self.log.entry(v)["layout"][t].values()}
        old = {f for v in self.log.versions()[:-keep] for t in RAW_TABLES for f in self.log.entry(v)["layout"][t].values()}
        gone = [f for f in sorted(old - live) if path_exists(self.spark, f"{self.root}/{f}")]
        for f in gone:
            delete_tree(self.spark, f"{self.root}/{f}")
        return len(gone)

    def create(self, tables: dict[str, DataFrame]) -> int:
        """The first version; a store that has one conflicts."""
        token = uuid.uuid4().hex

        def written(table: str) -> dict[str, str]:
            folder = self._write(table, conform(tables[table], RAW[table]), token)
            return {b: f"{folder}/bucket={b}" for b in self._buckets_of(folder)}
        with ThreadPoolExecutor(len(RAW_TABLES)) as pool:  # independent jobs
            layout = dict(zip(RAW_TABLES, pool.map(written, RAW_TABLES)))
        try:
            return self.log.commit({"batch": None, "kind": "create", "buckets": self.buckets, "layout": layout}, 0)
        except CommitConflict:
            self._drop(token)
            raise

    def _apply(self, batch: str, kind: str, prepare: Callable[[dict[str, DataFrame]], tuple[DataFrame, dict[str, DataFrame]]], tries: int) -> Applied:
        for turn in range(tries):
            base = self.log.latest()
            if self.applied(batch):
                return Applied(None, None)
            entry = self.log.entry(base)
            if entry is None:
                raise LookupError(f"{self.root} has no tables yet")
            if entry["buckets"] != self.buckets:
                raise ValueError(f"{self.root} has {entry['buckets']} buckets, not {self.buckets}")
            token = uuid.uuid4().hex
            verdict, rows = prepare(self.tables(base))
            layout = entry["layout"]
            with ThreadPoolExecutor(len(rows)) as pool:
                layout = layout | dict(zip(rows, pool.map(lambda t: self._merge(t, layout[t], rows[t], token), rows)))
            try:
                return Applied(self.log.commit({"batch": batch, "kind": kind, "buckets": self.buckets, "layout": layout}, base), verdict)
            except CommitConflict:
                self._drop(token)
                if turn == tries - 1:
                    raise
        raise ValueError("tries must be positive")

    def apply_orders(self, batch: str, headers: DataFrame, lines: DataFrame, as_of: str, on_repeat: str = "reject", tries: int = 5) -> Applied:
        """Commit the accepted orders of a batch with their lines, priced at intake."""
        def prepare(now: dict[str, DataFrame]):
            verdict = materialize(intake.order_intake(headers, lines, now["customers"], now["products"], as_of, on_repeat), "verdict")
            good = verdict.where("accepted")
            orders = good.select(row_id(batch, "order_ref").alias("id"), "customer_id", "status", "order_date", F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
            items = intake.accepted_lines(verdict, lines, now["products"], on_repeat).select(
                row_id(batch, "order_ref", "position").alias("id"), row_id(batch, "order_ref").alias("order_id"), "product_id", "quantity", "unit_price_at_sale")
            return verdict, {"orders": orders, "order_items": items}
        return self._apply(batch, "orders", prepare, tries)

    def apply_customers(self, batch: str, proposed: DataFrame, as_of: str, tries: int = 5) -> Applied:
        def prepare(now: dict[str, DataFrame]):
            verdict = materialize(intake.customer_intake(proposed, now["customers"]), "verdict")
            return verdict, {"customers": verdict.where("accepted").select(
                row_id(batch, "ref").alias("id"), "name", "email", "city", "state", F.lit(as_of).cast("timestamp_ntz").alias("created_at"))}
        return self._apply(batch, "customers", prepare, tries)

    def apply_products(self, batch: str, proposed: DataFrame, as_of: str, tries: int = 5) -> Applied:
        def prepare(now: dict[str, DataFrame]):
            verdict = materialize(intake.product_intake(proposed, now["products"]), "verdict")
            return verdict, {"products": verdict.where("accepted").select(
                row_id(batch, "ref").alias("id"), "sku", "name", "category", "unit_price", "active", F.lit(as_of).cast("timestamp_ntz").alias("created_at"))}
        return self._apply(batch, "products", prepare, tries)
