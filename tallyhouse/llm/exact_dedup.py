"""Exact duplicates by skew-safe combining of whole normalised texts.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted. Equal texts are combined in three stages, and
every stage compares whole contents, so two texts that share a digest stay apart:

1. **local**: a task merges equal texts of what it scans, keeping at most
   ``LOCAL_BYTES`` of text at a time (more is merged by the next stage instead);
2. **salted**: local winners meet by (digest, salt), the salt being the scan
   task's number modulo ``SALTS``, so a text that fills every partition is spread;
3. **global**: the winners of the salts meet by digest, at most ``SALTS`` a text.

A text travels only if its digest may occur twice: a first pass counts digests
and marks those above one in a bitmap of 2**``FILTER_BITS`` bits, which is the
only thing broadcast (8 MB at most, whatever the input). A false mark costs one
comparison and changes no result. All other columns are narrow.

Of equal texts the row with the most code points in its original text stays,
then the smallest id (null ids last), then the first scanned. So:

* a null text counts as empty; empty and blank texts are equal to each other;
* null ids are documents of their own; repeated rows are copies, one stays;
* an empty table gives an empty result; extra columns are ignored by
  :func:`resolve` and kept as they are, whatever their names, by :func:`deduplicated`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

BLANKS = " \t\n\x0b\x0c\r"
FILTER_BITS = 26
SALTS = 32
LOCAL_BYTES = 32 << 20
LOCAL_ROWS = 200_000

#: Equal in DuckDB: content decides the group, so the digest only names it.
ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
g AS (
  SELECT doc_id, content, count(*) OVER (PARTITION BY content) AS group_size,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY content ORDER BY chars DESC, doc_id NULLS LAST) AS place FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM g"""


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _place(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(1 << bits)) + 1


def shared_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bits): a bitmap of the places of digests that occur twice or more.
    The places are dealt by bucket before the bitmaps are built, so a task makes
    each of its bitmaps once; there are 2**bits / 32768 of 4 KB."""
    places = (digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(_place(F.col("digest"), bits).alias("place")))
    return (places.select(F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"))
            .repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))


def _local(batches: Iterator, limit: int) -> Iterator:
    """Equal contents of one task become one group; its winner alone carries the content."""
    import pyarrow as pa

    start = TaskContext.get().partitionId() << 33
    held, size, rows = [], 0, 0

    def merged():
        table = pa.Table.from_batches(held)
        ids, chars, contents = (table.column(c).to_pylist() for c in ("id", "chars", "content"))
        best, count = {}, {}
        rank = lambda i: (-chars[i], ids[i] is None, ids[i] or 0, i)
        for i, content in enumerate(contents):
            if content is None:
                continue
            old = best.get(content)
            count[content] = count.get(content, 0) + 1
            if old is None or rank(i) < rank(old):
                best[content] = i
        group = [None if c is None else start + best[c] for c in contents]
        wins = [c is not None and best[c] == i for i, c in enumerate(contents)]
        out = table.drop_columns(["content"])
        out = out.append_column("local", pa.array(group, pa.int64()))
        out = out.append_column("win", pa.array(wins, pa.bool_()))
        out = out.append_column("n", pa.array([count[c] if w else None for c, w in zip(contents, wins)], pa.int64()))
        out = out.append_column("content", pa.array([c if w else None for c, w in zip(contents, wins)], pa.binary()))
        return out.to_batches()

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.column(batch.schema.get_field_index("content")).nbytes
        if size >= limit or rows >= LOCAL_ROWS:
            yield from merged()
            start += rows
            held, size, rows = [], 0, 0
    if held:
        yield from merged()


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, *,
            digest: Callable[[Column], Column] = sha256, filter_bits: int = FILTER_BITS, salts: int = SALTS,
            local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (the
    ``digest`` of the normalised text), and ``row``, a struct of the columns of
    ``carry``, if given."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    packed = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    text = F.col(f"`{text_col}`")
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.char_length(F.coalesce(text.cast("string"), F.lit(""))).cast("long").alias("chars"),
                       normal(text).alias("content"), *packed).withColumn("digest", digest(F.col("content")))
    marks = scratch.cut(shared_filter(read.select("digest"), filter_bits), "marks")

    place = _place(F.col("digest"), filter_bits)
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shared = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    narrow = ["id", "chars", "digest", *(["row"] if carry else [])]
    marked = (read.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "bucket", "left")
              .select(*narrow, F.when(shared, F.col("content").cast("binary")).alias("content")))
    schema = T.StructType([*marked.select(*narrow).schema.fields, T.StructField("local", T.LongType()), T.StructField("win", T.BooleanType()),
                           T.StructField("n", T.LongType()), T.StructField("content", T.BinaryType())])
    rows = scratch.cut(marked.mapInArrow(lambda batches: _local(batches, local_bytes), schema), "rows")
    scratch.drop(["marks"])

    # A lower rank is better; its last field names the winning row.
    rank = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("none"),
                    F.coalesce("id", F.lit(0)).alias("id"), F.col("local").alias("local"))
    by_salt = Window.partitionBy("digest", "salt", "content")
    salted = (rows.where("content is not null")
              .select("digest", "content", "local", "n", rank.alias("rank"), F.pmod(F.shiftright("local", 33), F.lit(salts)).alias("salt"))
              .select("digest", "content", "local", F.min("rank").over(by_salt).alias("rank"), F.sum("n").over(by_salt).alias("n")))
    first = F.col("local") == F.col("rank.local")
    salted = scratch.cut(salted.select("digest", "local", "rank", "n", F.when(first, F.col("content")).alias("content")), "salted")
    whole = Window.partitionBy("digest", "content")
    final = (salted.where("content is not null")
             .select(F.col("local").alias("winner"), F.min("rank").over(whole).alias("best"), F.sum("n").over(whole).alias("size")))
    ends = salted.select("local", F.col("rank.local").alias("winner")).join(final, "winner").drop("winner")

    def shaped(df: DataFrame, keep_id: Column, size: Column, kept: Column) -> DataFrame:
        return df.select(F.col("id").alias("doc_id"), keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"),
                         F.col("digest").alias("text_sha256"), *(["row"] if carry else []))
    alone = shaped(rows.where("local is null"), F.col("id"), F.lit(1), F.lit(True))
    grouped = shaped(rows.where("local is not null").drop("n", "content").join(ends, "local"),
                     F.when(~F.col("best.none"), F.col("best.id")), F.col("size"),
                     F.col("win") & (F.col("local") == F.col("best.local")))
    return alone.unionByName(grouped)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return resolve(docs, id_col, text_col, docs.columns).where("kept").select("row.*")
