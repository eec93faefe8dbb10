"""Document fingerprints by consistent weighted sampling, in Spark SQL functions.

A text is a bag of lower-cased words, each weighted by its count. For sample k a
term with weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of
(term, k) alone, and takes

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1).

The sample is the term with the least a. As a depends on the weight only through
t, two texts keep the same (term, t) with a probability equal to the generalised
Jaccard similarity of their bags, sum of smaller weights over sum of larger
ones. The least ln a stands for its (term, t), so a signature is one minimum per
sample: a fixed-width aggregate that is combined before the shuffle. The share
of equal samples estimates the similarity.

Defined cases: null texts count as empty; texts without a word have the
fingerprint of all zeros, alike to one another (1.0) and to no other (0.0). The
order of documents is descending doc_id, a null doc_id last; rows that repeat a
doc_id share their neighbours, and the one with the smallest text hash gives the
text to the document before; with a single doc_id the next document is itself.
Every input row gives one row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ranked_key
from .common import Scratch

SAMPLES = 32
_BITS = 21


def words(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def _uniform(h: Column, part: int) -> Column:
    """The part-th 21 bits of a hash as a number in (0, 1)."""
    bits = F.shiftrightunsigned(h, _BITS * part).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))
    return (bits + F.lit(0.5)) * F.lit(1.0 / (1 << _BITS))


def _counted(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with a row (term, w) for every different word; one row with nulls if there is none."""
    rest = [c for c in df.columns if c != text]
    hashed = df.select(*rest, F.sort_array(F.transform(words(F.col(text)), lambda x: F.xxhash64(x))).alias("_h"))
    cut = hashed.select(*rest, "_h", F.filter(
        F.when(F.size("_h") > 0, F.sequence(F.lit(0), F.size("_h") - 1)).otherwise(F.expr("cast(array() as array<int>)")),
        lambda i: (i == 0) | (F.get("_h", i) != F.get("_h", F.greatest(i - 1, F.lit(0))))).alias("_at"))
    pairs = cut.select(*rest, F.transform("_at", lambda i, j: F.struct(
        F.get("_h", i).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_h")) - i).alias("w"))).alias("_t"))
    return pairs.select(*rest, F.explode_outer("_t").alias("_x")).select(*rest, F.col("_x.term").alias("term"), F.col("_x.w").alias("w"))


def signatures(df: DataFrame, text: str, samples: int = SAMPLES) -> DataFrame:
    """One row per input row: its other columns (its key) and ``signature``, ``samples`` ints.

    The other columns must tell the rows apart.
    """
    keys = [c for c in df.columns if c != text]
    terms = _counted(df, text).select(*keys, "term", F.log("w").alias("lw"))
    least = [F.min(_log_a(F.col("term"), F.col("lw"), k)).alias(f"m{k}") for k in range(samples)]
    # the samples' identities: 32 bits of the hash of the least value, 0 without a word
    sign = F.array(*[F.when(F.col(f"m{k}").isNull(), F.lit(0)).otherwise(F.hash(f"m{k}")) for k in range(samples)])
    return terms.groupBy(*keys).agg(*least).select(*keys, sign.alias("signature"))


def _log_a(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of sample k. Each draw is computed inside the aggregate, so that
    nothing but (term, ln w) is held per word and the plan stays in one generated stage."""
    g, h = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(_uniform(g, 0) * _uniform(g, 1))
    log_c = F.log(-F.log(_uniform(g, 2) * _uniform(h, 0)))
    b = _uniform(h, 1)
    # t is 0 for weight 1, by far the most common one
    return F.when(log_weight == 0, log_c - r * (1 - b)).otherwise(log_c - r * (F.floor(log_weight / r + b) - b + 1))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two signatures."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda t, x: t + x) / F.size(a)


def as_text(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))), 8, "0"))), "")


def _text_key(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("k1"), F.xxhash64(F.lit("text"), c).alias("k2"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, edited, key, next_key): each text with its last third replaced by the next one's start."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = base.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3).cast("int")).alias("need"))
    ranked = ranked_key(ids, ["doc_id"], "place")
    last = ranked.agg(F.max("place")).first()[0] or 0
    # the next lower id is the next document; the lowest goes on with the highest
    taker = ranked.select(F.col("doc_id").alias("to_id"), "need",
                          F.when(F.col("place") == 1, F.lit(last)).otherwise(F.col("place") - 1).alias("place"))
    plan = ranked.select(F.col("doc_id").alias("from_id"), "place").join(taker, "place").select("from_id", "to_id", "need")
    heads = (base.join(plan, base["doc_id"].eqNullSafe(plan["from_id"]))
             .groupBy("to_id").agg(F.min(F.struct(_text_key(F.col("text")).alias("key"), F.substr("text", F.lit(1), F.col("need")).alias("head"))).alias("d"))
             .select("to_id", F.col("d.key").alias("next_key"), F.col("d.head").alias("head")))
    third = F.floor(F.length("text") / 3).cast("int")
    return (base.join(heads, base["doc_id"].eqNullSafe(heads["to_id"]))
            .select("doc_id", F.length("text").cast("long").alias("n_chars"), "text",
                    F.concat(F.substr("text", F.lit(1), F.length("text") - third), F.substr("head", F.lit(1), third)).alias("edited"),
                    _text_key(F.col("text")).alias("key"), "next_key"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    scratch = Scratch(docs.sparkSession, "fingerprint")
    edited = edited_documents(docs).withColumn("row", F.monotonically_increasing_id())
    # What is needed once travels with one of the two rows of a document only.
    own_keys = [F.col(c).alias(a) for c, a in (("key.k1", "k1"), ("key.k2", "k2"), ("next_key.k1", "n1"), ("next_key.k2", "n2"))]
    no_keys = [F.lit(None).cast("long").alias(a) for a in ("k1", "k2", "n1", "n2")]
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"), F.lit(None).cast("binary").alias("sha"), *own_keys),
                   F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"), F.unhex(F.sha2("edited", 256)).alias("sha"), *no_keys))
    rows = edited.select("row", "doc_id", "n_chars", F.explode(both).alias("x")).select("row", "doc_id", "n_chars", "x.*")
    signed = scratch.cut(signatures(rows, "t"), "signatures")
    own = signed.where("kind = 0").drop("sha").withColumnRenamed("signature", "own")
    changed = signed.where("kind = 1").select("row", "sha", F.col("signature").alias("changed"))
    following = (signed.where("kind = 0").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("signature").alias("next"))
                 .dropDuplicates(["n1", "n2"]))
    return (own.join(changed, "row").join(following, ["n1", "n2"])
            .select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
                    likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next")))
