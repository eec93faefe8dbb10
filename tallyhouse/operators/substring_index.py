"""Substring search over an index of trigrams.

A needle occurs in a text only if all its trigrams do. The index holds, for
every trigram of the lower-cased texts, the ids of the rows that have it, sorted
by (trigram, id), and how many they are. A search reads the counts of the
needle's trigrams (at most its length), takes the ``RAREST`` rarest, intersects
their lists, and verifies the rows left on their texts. A trigram that every row
has is thus never read unless the needle has no rarer one, and its list, sorted
by id too, is spread over files when the index is written. A needle of fewer than three
characters has no trigram; it falls back to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
RAREST = 3


def grams(text: Column) -> Column:
    """Distinct trigrams of one text."""
    low = F.lower(text)
    last = F.char_length(low) - (GRAM - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


class SubstringIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, df: DataFrame, path: str, text_cols: list[str], id_col: str = "id") -> SubstringIndex:
        """Index ``text_cols`` of ``df``; a needle is looked for inside each column."""
        each = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(F.col(c)), F.array().cast("array<string>")) for c in text_cols])))
        postings = df.select(F.explode(each).alias("gram"), F.col(id_col).alias("id"))
        (postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")
         .write.option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{path}/postings"))
        (df.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
         .repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams"))
        return cls(df.sparkSession, path)

    def candidates(self, needle: str) -> DataFrame | None:
        """Ids of rows that hold the rarest trigrams of ``needle``; None when it has none."""
        n = needle.lower()
        wanted = sorted({n[i:i + GRAM] for i in range(len(n) - GRAM + 1)})
        if not wanted:
            return None
        found = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(wanted)).orderBy("n", "gram").collect()
        postings = self.spark.read.parquet(f"{self.path}/postings")
        if len(found) < len(wanted):  # a trigram that no row has
            return postings.select("id").limit(0)
        rare = [r["gram"] for r in found[:RAREST]]
        ids = postings.where(F.col("gram") == rare[0]).select("id")
        for gram in rare[1:]:
            ids = ids.join(postings.where(F.col("gram") == gram).select("id"), "id", "left_semi")
        return ids

    def search(self, df: DataFrame, text_cols: list[str], needle: str | None, id_col: str = "id") -> DataFrame:
        """The rows of ``df`` with the trimmed needle in one of ``text_cols``, whatever the case."""
        n = (needle or "").strip().lower()
        if not n:
            return df
        ids = self.candidates(n)
        rows = df if ids is None else df.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi")
        hit = F.lit(False)
        for c in text_cols:
            hit = hit | F.coalesce(F.lower(c).contains(n), F.lit(False))
        return rows.where(hit)
