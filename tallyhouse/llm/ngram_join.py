"""N-gram Jaccard self-join of documents by rare-first prefix filtering.

A document's set holds its distinct word shingles as 64-bit hashes; documents
with one and the same set form a class, named by a 64-bit hash of the set. All
work between texts is on classes, so copies cost one row each and no pair.

1. Every task counts the shingles of its classes in a sketch of ``SLOTS``
   saturating counters; their sum over all documents (a fixed size) is the
   frequency that orders shingles, rarest first, ties by hash. The order only
   decides how many candidates arise, never the result.
2. A class posts its prefix: the first n - ceil(t n) + 1 shingles. Two sets of
   Jaccard t or more share a prefix shingle. Postings are dealt by shingle.
3. Links are found in rounds. A round pairs each posting with the hubs of its
   shingle and with its neighbours (see ``_neighbours``); each class offers its
   best pairs, those that pass the suffix filter are verified, and linked classes
   become components. This is linear in the postings and joins groups of copies
   without ever listing their pairs.
4. What is left are pairs of classes in different components that share a
   prefix shingle. All of them are formed; length, positional and suffix filters
   drop those that cannot reach t. A pair goes by its smaller class first and is
   verified once in all rounds, on the whole texts.

The suffix filter compares counts of the two sets over ``PARTS`` hash parts:
the overlap is at most the sum of the smaller counts.

Defined cases: null and blank texts have no shingles, are linked with nothing
and are their own component; a text with fewer words than ``size`` has its whole
sequence as one shingle; rows that repeat a doc_id are a document each and share
the id; a null doc_id stays null, and its row belongs to the component of its
class; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, Scratch, marks, maybe_marked
from .graph import components

SIZE = 5
PERCENT = 80
SLOTS, BLOCKS = 1 << 24, 256
PARTS = 64
STEP_BYTES = 1 << 18  # of text hashed at a time; each byte takes some fifty while it is
ROUNDS = 2
TRIES = 3  # pairs a class verifies in a round; what is left is verified in full at the end
_BYTE = np.random.default_rng(20240).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", dtype=np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(raw))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * up)))
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    bound = np.concatenate(([0], np.searchsorted(starts, text_ends)))  # first word of each text
    rolled = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(_Q) + words[k: len(words) - size + 1 + k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a: b - size + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(_Q) + w
            out.append(_mix(np.array([h])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _slices(rows: pa.RecordBatch, texts: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """Parts of 256 rows and STEP_BYTES of ``texts`` at most; a row longer than that by itself."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(rows.column(c).cast(pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts))
    at = done = 0
    while at < rows.num_rows:
        end = max(at + 1, min(at + 256, int(np.searchsorted(ends, done + STEP_BYTES, side="right"))))
        yield rows.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Arrow batches, so that ids never become floats beside a null."""
    for rows in batches:
        for some in _slices(rows):
            yield some, shingle_sets(some.column("text").to_pylist(), size)


def _rows(ids: pa.Array, n: list[int], sigs: list[int], blocks: list[int], counts: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(sigs, pa.int64()), pa.array(blocks, pa.int32()), pa.array(counts, pa.binary())],
                                      names=["doc_id", "n", "sig", "block", "counts"])


def _classes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row per document (doc_id, n, sig), then the task's counters in blocks."""
    counts, seen = np.zeros(SLOTS, dtype=np.uint8), set()
    for rows, sets in _sets(batches, size):
        sigs = [_class(s) for s in sets]
        fresh = [s for g, s in zip(sigs, sets) if len(s) and g not in seen]
        seen.update(sigs)
        if fresh:
            slots, times = np.unique(np.concatenate(fresh) & np.uint64(SLOTS - 1), return_counts=True)
            counts[slots] = np.minimum(counts[slots] + times, 255).astype(np.uint8)
        yield _rows(rows.column("doc_id"), [len(s) for s in sets], sigs, [-1] * len(sets), [None] * len(sets))
    if seen:
        blocks = counts.reshape(BLOCKS, -1)
        for at in range(0, BLOCKS, 32):
            ids = list(range(at, at + 32))
            yield _rows(pa.nulls(32, pa.int64()), [0] * 32, [0] * 32, ids, [zlib.compress(blocks[i].tobytes(), 1) for i in ids])


def _sum_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for rows in batches:
        for block, data in zip(rows["block"], rows["counts"]):
            c = np.frombuffer(zlib.decompress(data), dtype=np.uint8).astype(np.int64)
            total[block] = np.minimum(total.get(block, 0) + c, 255)
    if total:
        yield pd.DataFrame({"block": list(total), "counts": [zlib.compress(c.astype(np.uint8).tobytes(), 1) for c in total.values()]})


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _postings(batches: Iterator[pa.RecordBatch], counts: np.ndarray, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for _, sets in _sets(batches, size):
        out = []
        for s in sets:
            sig = _class(s)
            if len(s) and sig not in seen:
                seen.add(sig)
                order = np.lexsort((s, counts[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))
                out.append((sig, len(s), s[order[: prefix_length(len(s), percent)]].view(np.int64)))
        sigs, lengths, tokens = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(lengths, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["sig", "n", "tokens"])


def _verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for some in _slices(rows, ("text_a", "text_b")):
            keep = []
            for x, y in zip(*(shingle_sets(some.column(c).to_pylist(), size) for c in ("text_a", "text_b"))):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _represent(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, sig, text, parts): texts with their class and the counts of their set over PARTS parts."""
    seen: set[tuple[int | None, int]] = set()
    for rows, sets in _sets(batches, size):
        keep, sigs, parts = [], [], []
        for i, s in zip(rows.column("doc_id").to_pylist(), sets):
            sig = _class(s)
            keep.append(len(s) > 0 and (i, sig) not in seen)
            if keep[-1]:
                seen.add((i, sig))
                sigs.append(sig)
                parts.append(np.bincount((s >> np.uint64(40)).astype(np.int64) % PARTS, minlength=PARTS).astype(np.int32))
        some = rows.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sigs, pa.int64()), some.column("text"), pa.array(parts, pa.list_(pa.int32()))],
                                         names=["doc_id", "sig", "text", "parts"])


def _length_and_position(percent: int):
    """Both sets can still reach the threshold, a and b being candidates of one posting."""
    least = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    return ((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= least))


def _neighbours(open_: DataFrame, by_token) -> DataFrame:
    """A few pairs (a, b, ...) with another label's class a for each posting of b: linear in the postings.

    The hub of a shingle is the class with the fewest rarer shingles, close to
    what its copies share; the second hub is the best one of another label.
    Then come the neighbours by that place and by size.
    """
    this = F.struct("pos", "n", "sig", "label")
    near = (open_.withColumn("_hub", F.min(this).over(by_token))
            .withColumn("_second", F.min(F.when(F.col("label") != F.col("_hub.label"), this)).over(by_token))
            .withColumn("_rarer", F.lag(this).over(by_token.orderBy("pos", "n", "sig")))
            .withColumn("_smaller", F.lag(this).over(by_token.orderBy("n", "sig")))
            .select("sig", "n", "pos", "label", F.explode(F.array("_hub", "_second", "_rarer", "_smaller")).alias("o"))
            .where("o IS NOT NULL AND o.label != label"))
    return near.select(F.col("o.sig").alias("a"), F.col("sig").alias("b"), F.col("o.n").alias("n_a"), F.col("n").alias("n_b"),
                       F.col("o.pos").alias("pos_a"), F.col("pos").alias("pos_b"))


def classed(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with the class ``_sig`` and the shingles ``_n`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for some in _slices(rows):
                sets = shingle_sets(some.column("text").to_pylist(), size)
                added = [pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
                yield pa.RecordBatch.from_arrays([*some.columns, *added], names=[*some.schema.names, "_sig", "_n"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_sig", T.LongType()), T.StructField("_n", T.IntegerType())]))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, sig, component_id) of every document.

    ``sig`` names the class of equal sets; ``component_id`` is the smallest
    doc_id reachable over links of Jaccard ``percent`` / 100 or more.
    """
    member = labelled(docs, size, percent)
    smallest = member.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return (member.join(smallest, "label", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sig",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def labelled(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, sig, label) of every document; classes of one component share the label."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join", TEXT_ROWS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = scratch.cut(docs.mapInArrow(lambda b: _classes(b, size),
                                         "doc_id long, n int, sig long, block int, counts binary"), "classes")
    members = first.where("block < 0").select("doc_id", "n", "sig")
    blocks = (first.where("block >= 0").select("block", "counts").repartition("block")
              .mapInPandas(_sum_blocks, "block int, counts binary").collect())  # SLOTS bytes at most
    counts = np.zeros((BLOCKS, SLOTS // BLOCKS), dtype=np.uint8)
    for r in blocks:
        counts[r["block"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.uint8)
    sketch = spark.sparkContext.broadcast(counts.reshape(-1))

    posted = (docs.mapInArrow(lambda b: _postings(b, sketch.value, size, percent), "sig long, n int, tokens array<long>")
              .select("sig", "n", F.posexplode("tokens").alias("pos", "token")).repartition("token"))
    by_token = Window.partitionBy("token")
    shared = (posted.dropDuplicates(["token", "sig"])
              .withColumn("_more", F.max("sig").over(by_token) != F.min("sig").over(by_token)).where("_more").drop("_more"))
    shared = scratch.cut(shared, "postings")

    # One document of each class with shared shingles gives its text. The bitmaps keep the other
    # texts out of Python and of every shuffle; what passes them by chance is only a further copy.
    wanted = (members.join(shared.select("sig").distinct(), "sig", "left_semi")
              .groupBy("sig").agg(F.min("doc_id").alias("doc_id")))
    owners = scratch.cut(wanted, "owners")
    texts = maybe_marked(docs, ["doc_id"], marks(owners, ["doc_id"])).mapInArrow(
        lambda b: _represent(b, size), "doc_id long, sig long, text string, parts array<int>")
    texts = scratch.cut(maybe_marked(texts, ["doc_id", "sig"], marks(owners, ["doc_id", "sig"])).drop("doc_id"), "texts")
    parts = scratch.cut(texts.select("sig", "parts").dropDuplicates(["sig"]), "parts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among distinct pairs (a, b, n), n being the sum of their set sizes, after the suffix filter."""
        a = parts.select(F.col("sig").alias("a"), F.col("parts").alias("p_a"))
        b = parts.select(F.col("sig").alias("b"), F.col("parts").alias("p_b"))
        most = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
        pairs = scratch.cut(pairs.join(a, "a").join(b, "b").where(most * (100 + percent) >= F.lit(percent) * F.col("n")).select("a", "b"), f"{name}-pairs")
        sides = marks(pairs.select(F.explode(F.array("a", "b")).alias("sig")), ["sig"])
        own = maybe_marked(texts.select("sig", "text"), ["sig"], sides).dropDuplicates(["sig"])
        a = own.select(F.col("sig").alias("a"), F.col("text").alias("text_a"))
        b = own.select(F.col("sig").alias("b"), F.col("text").alias("text_b"))
        links = scratch.cut(pairs.join(a, "a").join(b, "b").mapInArrow(lambda x: _verify(x, size, percent), "a long, b long"), name)
        scratch.drop([f"{name}-pairs"])
        return links

    links, tried = None, None
    open_ = shared.withColumn("label", F.col("sig"))
    for turn in range(ROUNDS):
        near = _neighbours(open_, by_token)
        pairs = (near.where(_length_and_position(percent))
                 .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("b").alias("by"))
                 .agg(F.count(F.lit(1)).alias("times"), F.first(F.col("n_a") + F.col("n_b")).alias("n")))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        ranked = F.row_number().over(Window.partitionBy("by").orderBy(F.desc("times"), "a", "b"))
        best = scratch.cut(pairs.withColumn("_k", ranked).where(F.col("_k") <= TRIES).select("a", "b", "n").distinct(), f"pairs{turn}")
        tried = best.select("a", "b") if tried is None else tried.union(best.select("a", "b"))
        found = verified(best, f"links{turn}")
        links = found if links is None else links.union(found)
        labels = components(links, scratch, f"cc{turn}")
        open_ = (shared.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
                 .withColumn("label", F.coalesce("label", "sig")).repartition("token")
                 .withColumn("_more", F.max("label").over(by_token) != F.min("label").over(by_token))
                 .where("_more").drop("_more"))

    open_ = scratch.cut(open_, "open")
    a = open_.select("token", *[F.col(c).alias(f"{c}_a") for c in ("sig", "n", "pos", "label")])
    b = open_.select("token", *[F.col(c).alias(f"{c}_b") for c in ("sig", "n", "pos", "label")])
    cross = (a.join(b, "token").where("label_a != label_b AND sig_a < sig_b").where(_length_and_position(percent))
             .select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"), (F.col("n_a") + F.col("n_b")).alias("n")).distinct()
             .join(tried, ["a", "b"], "left_anti"))
    links = links.union(verified(cross, "links-rest"))
    labels = components(links, scratch, "cc-all")
    scratch.drop(["postings", "owners", "texts", "parts", "open", "links-rest", *(f"{n}{t}" for n in ("pairs", "links") for t in range(ROUNDS))])

    return members.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select(
        "doc_id", "n", "sig", F.coalesce("label", "sig").alias("label"))
