"""Sorted tables with a directory of their files: deep pages and point lookups
that open only the files that hold the answer.

A table is range-partitioned and sorted by its order, one stretch of the order
a file. Every row carries its position in its file; the directory has a row per
file: how many rows lie before it, how many it holds, and the first and last
value of the leading order column. So

* a page at any offset is a position range of one file, or of a few neighbours,
  where ``offset`` + ``limit`` would gather all rows before it in one task;
* a lookup by the leading column opens the files whose range holds the value,
  and Parquet statistics, page indexes and Bloom filters leave one row group.

The directory is a Parquet table itself and is asked by predicate; the driver
sees the few files of one page or lookup.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commit_log import create_if_absent
from .warehouse import read_text

ROW_GROUP_BYTES = 16 << 20


class SortedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        head = json.loads(read_text(spark, f"{self.path}/table.json") or "null")
        if head is None:
            raise LookupError(f"no sorted table at {path}")
        self.order = [(name, desc) for name, desc in head["order"]]
        self.schema = T.StructType.fromJson(head["schema"])

    @classmethod
    def build(cls, df: DataFrame, path: str, order: list[tuple[str, bool]]) -> SortedTable:
        """Write ``df`` in ``order`` ([(column, descending)], unique together)."""
        spark, path, lead = df.sparkSession, path.rstrip("/"), order[0][0]
        sort = [F.col(n).desc() if d else F.col(n).asc() for n, d in order]
        rows = (df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
        (rows.write.option("parquet.block.size", ROW_GROUP_BYTES).option(f"parquet.bloom.filter.enabled#{lead}", "true")
         .parquet(f"{path}/rows"))
        written = spark.read.parquet(f"{path}/rows")
        per_file = written.groupBy("_part").agg(
            F.first("_metadata.file_name").alias("file"), F.count(F.lit(1)).alias("rows"),
            F.min(lead).alias("low"), F.max(lead).alias("high"), F.count_distinct("_metadata.file_name").alias("files"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
        (per_file.select("file", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), "low", "high",
                         F.assert_true(F.col("files") == 1, "a stretch of the order must be one file").alias("_ok")).drop("_ok")
         .write.parquet(f"{path}/directory"))
        create_if_absent(spark, f"{path}/table.json", json.dumps({"order": order, "schema": df.schema.jsonValue()}))
        return cls(spark, path)

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory")

    def total(self) -> int:
        return int(self.directory().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])

    def _rows(self, files: list[str]) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_pos", T.LongType())])
        if not files:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*[f"{self.path}/rows/{f}" for f in files])

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, in order."""
        from ..operators.operational import check_page
        check_page(limit, offset)
        hit = (self.directory().where((F.col("start") < offset + limit) & (F.col("start") + F.col("rows") > offset))
               .orderBy("start").limit(limit).collect())  # a page of n rows meets n files at most
        if not hit:
            return self._rows([]).select(*self.schema.names)
        first, last = hit[0], hit[-1]
        rows = self._rows([r["file"] for r in hit])
        name = F.col("_metadata.file_name")
        after = (name != first["file"]) | (F.col("_pos") >= offset - first["start"])
        until = (name != last["file"]) | (F.col("_pos") < offset + limit - last["start"])
        if len(hit) == 1:  # plain bounds on the position reach the row groups
            after, until = F.col("_pos") >= offset - first["start"], F.col("_pos") < offset + limit - first["start"]
        return rows.where(after & until).orderBy("_part", "_pos").select(*self.schema.names)

    def find(self, value) -> DataFrame:
        """The rows whose leading order column equals ``value``."""
        lead = self.order[0][0]
        hit = self.directory().where((F.col("low") <= F.lit(value)) & (F.col("high") >= F.lit(value))).select("file").collect()
        return self._rows([r["file"] for r in hit]).where(F.col(lead) == F.lit(value)).select(*self.schema.names)
