"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays,
personal data is replaced, and what is left is packed into training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``. No stage is expressible in SQL, so
``ORACLE_SQL`` is None; tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import ngram_join, packing, pii, toxicity
from tallyhouse.llm.catalog import tokenizer_path
from tallyhouse.llm.common import TEXT_ROWS, Scratch, fresh, table

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC; empty texts and null texts stay."""
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    score = fresh("_toxicity", docs.columns)
    return toxicity.score(docs, model, score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each linked group: of the smallest id, then class, then text.

    Rows are told apart by id and class, so rows that repeat a doc_id with other
    texts are documents of their own, and so are rows without an id (they come
    last in a group). Blank texts are linked with nothing; each such row stays.
    """
    key = [F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id")]
    kept = (ngram_join.labelled(docs).where("n > 0").select("label", F.struct(*key, F.col("sig").alias("_sig")).alias("_row"))
            .groupBy("label").agg(F.min("_row").alias("_row")).select("_row.*"))
    # a row travels as one struct, so no column of it can clash
    rows = ngram_join.classed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")))
    single = (rows.where("_n > 0").select(*key, "_sig", "_row")
              .groupBy("_none", "_id", "_sig").agg(F.min("_row").alias("_row")).join(kept, ["_none", "_id", "_sig"], "left_semi"))
    return single.select("_row.*").unionByName(rows.where("_n = 0").select("_row.*"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; none is dropped."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates),
          ("pii", redact_personal_data), ("best_fit_packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline", TEXT_ROWS)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.cut(docs, name)
            if number:
                scratch.drop([STAGES[number - 1][0]])
    return docs
