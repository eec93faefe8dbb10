"""Shared helpers of the ``llm`` operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_root

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch where whole texts go to Python: at Spark's 10,000 a batch
#: takes tens of MB, several times over, in each task and outside the heap.
TEXT_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Written intermediate tables of one query under ``spark.checkpoint.dir``.

    ``cut`` writes a frame and reads it back (a lineage cut that survives lost
    executors). ``drop`` deletes a table as soon as no later step reads it.
    The tables a returned lazy frame still reads stay until the session ends.
    ``rows``: Arrow batches have that many rows at most while a table is written.
    """

    def __init__(self, spark: SparkSession, name: str, rows: int | None = None):
        self.spark, self.rows = spark, rows
        self.root = f"{scratch_root(spark)}/llm/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        usual = self.spark.conf.get(_ROWS)
        fewer = self.rows is not None and not 0 < int(usual) <= self.rows
        if fewer:
            self.spark.conf.set(_ROWS, str(self.rows))
        try:
            df.write.mode("errorifexists").parquet(path)
        finally:
            if fewer:
                self.spark.conf.set(_ROWS, usual)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, names: Iterable[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or with underscores after it while a column is called so (whatever the case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


MARK_BITS = 26


def _place(keys: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits)) + 1


def marks(df: DataFrame, keys: Sequence[str], bits: int = MARK_BITS) -> DataFrame:
    """(bucket, bits): a bitmap of the hash places of ``keys``, of 2**bits bits at most."""
    place = _place(keys, bits)
    return (df.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).distinct()
            .repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))


def maybe_marked(df: DataFrame, keys: Sequence[str], marked: DataFrame, bits: int = MARK_BITS) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are in the bitmap ``marked``, and a few
    others whose hash shares a place. It saves shuffles; it decides nothing."""
    place = _place(keys, bits)
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_marks.bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    packed = marked.select(F.col("bucket").alias("_bucket"), F.struct("bits").alias("_marks"))
    return (df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(packed), "_bucket")
            .where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*df.columns))


#: From texts to (source row of each output row, or None for one each; values of each added column).
TextFunction = Callable[[list], tuple[Sequence[int] | None, list]]


def over_texts(df: DataFrame, text_col: str, keep: list[str], make: Callable[[], TextFunction], added: str, step: int = 256) -> DataFrame:
    """Columns ``keep`` of ``df`` with the columns ``added`` (a DDL string) that a
    function of ``step`` texts at a time gives.

    ``make`` builds the function once a task. The other columns stay in Arrow, so
    64-bit ids beside nulls, structs and the like come out as they went in.
    """
    fields = [f for c in keep for f in df.schema.fields if f.name == c][: len(keep)]
    new = T._parse_datatype_string(added)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types, names = [to_arrow_type(f.dataType) for f in new.fields], [f.name for f in [*fields, *new.fields]]
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                rows, values = function(some.column(text_col).to_pylist())
                kept = [some.column(c) for c in keep]
                if rows is not None:
                    order = pa.array(rows, pa.int64())
                    kept = [c.take(order) for c in kept]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, t in zip(values, types))], names=names)

    return df.mapInArrow(run, T.StructType([*fields, *new.fields]))
