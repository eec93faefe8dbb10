"""Spelling variants: words one edit apart, found by asymmetric chunks.

One word of a pair contributes disjoint chunks, the other its positional grams.
Two halves are disjoint, so one edit leaves one of them whole; the half it hits
is again a word with one edit, and is halved the same way, down to ``PIECES``
pieces. What is left whole (all but the hit piece) is the join key of the
longer word (of equally long ones: the smaller), one key a piece. The other
word offers, for its own length and the next, the grams that lie where those
chunks must lie: before the hit piece at the same place, behind it shifted by
the difference of length, which is none or one. So two words meet if and only
if some piece may hold their whole difference, and each meeting is verified by
edit distance. With pieces of one letter a key brings together at most as many
words as there are letters, so candidates grow with the number of words, not
with the square of a common ending.

Words are counted inside each task before any shuffle; only distinct words are
joined. Rows:

* a null or empty text has no words; a null id counts as empty text in the slip
  rule; repeated rows are counted each;
* very long words are handled whole (a key is a hash, the word is verified);
* ties of the most frequent near word go to the smallest in code-point order;
* an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP_EVERY = 97
PIECES = 8


def slipped(doc_id: Column, run: Column, every: int = SLIP_EVERY) -> Column:
    """``run`` without one code point where crc32 of ``<doc_id>:<run>`` is divisible by ``every``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of words with at least ``min_length`` code points and ``min_count`` occurrences."""
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    # a run loses one letter at most, so shorter ones never count
    words = runs.where(F.char_length("run") >= min_length).select(slipped(F.col("id"), F.col("run")).alias("word"))
    return (words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _keys(word: Column, length: Column, shift: Column | int, pieces: int) -> Column:
    """A hash for each non-empty piece of a word of ``length``: what is left of
    ``word`` (which is ``shift`` shorter) around the piece."""
    def key(j: Column) -> Column:
        lo, hi = (F.floor(length * j / pieces).cast("int"), F.floor(length * (j + 1) / pieces).cast("int"))
        rest = F.concat(F.substring(word, F.lit(1), lo), F.substring(word, hi - shift + 1, length))
        return F.when(hi > lo, F.xxhash64(length, lo, rest))
    return F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), key))


def near_pairs(words: DataFrame, pieces: int = PIECES) -> DataFrame:
    """(a, n_a, b, n_b): every two words of ``words`` (word, n) that differ by
    exactly one inserted, deleted or replaced code point, once."""
    length = F.char_length("word").cast("int")
    chunks = words.select(F.explode(_keys(F.col("word"), length, 0, pieces)).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    grams = words.select(F.explode(F.concat(_keys(F.col("word"), length, 0, pieces), _keys(F.col("word"), length + 1, 1, pieces))).alias("key"),
                         F.col("word").alias("b"), F.col("n").alias("n_b"))
    longer = (F.char_length("a") > F.char_length("b")) | ((F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b")))
    met = chunks.join(grams, "key").where(longer & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()  # a shift inside a double letter meets in several pieces


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form. Counts at least double along a chain,
    so there is no circle, and every round halves what is left of each chain."""
    at = scratch.cut(forms.select("word", F.col("form").alias("root")), "roots-0")
    turn = 0
    while True:
        turn += 1
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = scratch.cut(at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), f"roots-{turn}")
        moved = new.where("moved").limit(1).count()
        scratch.drop([f"roots-{turn - 1}"])
        at = new.drop("moved")
        if not moved:
            return at


def group(words: DataFrame, pieces: int = PIECES) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n), words being distinct.
    A form is the most frequent near word, if at least twice as frequent."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.cut(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = scratch.cut(near_pairs(words, pieces), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    has = -F.col("best.n") >= 2 * F.col("n")
    near = scratch.cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"),
        F.when(has, -F.col("best.n")).cast("long").alias("form_n")), "near")
    scratch.drop(["words", "pairs"])
    roots = _roots(near.where("form is not null"), scratch)
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return group(word_counts(docs, id_col, text_col))
