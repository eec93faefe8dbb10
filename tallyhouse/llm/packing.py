"""Best-fit packing: hierarchical residual packing of tokenised documents.

Level 0 runs inside the tokenising tasks: each scan partition packs the pieces
of its own documents best-fit decreasing and numbers its bins. Nearly full bins
are final. Underfull bins go up a tree: groups of ``FAN_IN`` nodes pack the
underfull bins of their children as items, best-fit decreasing, until one node
is left. No text, token or piece moves in these rounds, only (bin, fill).

What a node carries is bounded. Best-fit leaves at most one bin of half the
capacity or less, and two fuller ones never share a sequence. Each carried bin
above half can only take in small bins, of which the level has one per node at
most; so of bins with the same fill a node keeps as many as there are nodes and
closes the others, which can't be told apart. That closes bins early without
changing what can be packed.

Tokens: a pre-token's ids don't depend on its neighbours in this byte-level BPE,
so each task remembers the ids of pre-tokens (bounded) and asks the tokenizer
for new ones only. Texts that hold a special token's string, or characters
outside the plain ranges, go to the tokenizer whole.

Defined cases: null and empty texts give one piece with the end id alone; every
input row is packed by itself, also rows that repeat a doc_id; a null doc_id
stays null; extra columns are ignored; an empty table gives no rows. A document
longer than the capacity is cut from its end, so only its first piece is short.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY = 1024
END_ID = 2
NEARLY_FULL = 8  # free tokens a final bin may have
FAN_IN = 16
CACHE_PRETOKENS = 200_000  # a generation; two are kept

#: Letters, digits and blanks below U+0250 as the byte-level pre-tokenizer has them.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
BLANK = " \t\n\r\f\v\u0085 "
PRETOKEN = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
UNCOMMON = re.compile("[^\\x00-\\x1b\\x20-ɏ]|<\\|")

PIECE_SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
                "bin long, place long, fill long, open boolean")


def _common(text: str) -> bool:
    """Whether PRETOKEN cuts ``text`` as the tokenizer does. Latin-1 texts, nearly
    all, are told by how they encode and a few searches for one character."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not UNCOMMON.search(text)
    return not ("<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)


class Ids:
    """Token ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}
        names = self.tokenizer.get_vocab()
        self.starts = {first: np.zeros(1 + max(names.values()), dtype=bool) for first in (" ", "\n")}
        for first, sign in ((" ", "Ġ"), ("\n", "Ċ")):  # as byte-level vocabularies write these bytes
            self.starts[first][[i for name, i in names.items() if name.startswith(sign)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str], first: str) -> None:
        """Ids of ``words``, which hold the blank ``first`` at their start only, or
        nowhere (a line break, put before each); if the ids show other cuts, none is learnt."""
        starts, skip = self.starts[first], first == "\n"
        for at in range(0, len(words), 512):
            some = words[at: at + 512]
            joined = first + first.join(some) if skip else "".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            data = ids.tobytes()
            cuts = (4 * np.flatnonzero(starts[ids])).tolist()
            if len(cuts) == len(some) and not cuts[0]:
                self.known.update(zip(some, [data[a + 4 * skip: b] for a, b in zip(cuts, [*cuts[1:], len(data)])]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_PRETOKENS:
            self.old, self.known = self.known, {}
        parts = [PRETOKEN.findall(t) if _common(t) else None for t in texts]
        new = set().union(*(p for p in parts if p)).difference(self.known)
        again = new & self.old.keys()  # words still in use outlive a full memory
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        new -= again
        # A pre-token that starts with a space, or stands behind a line break, is one
        # wherever it stands: many in one call. Blanks alone go one by one.
        spaced = [w for w in new if w[0] == " " and not w.isspace()]
        bare = [w for w in new if w[0] not in BLANK]
        self.learn(spaced, " ")
        self.learn(bare, "\n")
        for word in new.difference(self.known):
            self.known[word] = self.whole(word)
        value = self.known.__getitem__
        return [self.whole(t) if p is None else b"".join(map(value, p)) for t, p in zip(texts, parts)]


@functools.lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    """One tokenizer and memory a Python worker, for all tasks it runs."""
    return Ids(path)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its place there, fill of each bin), best-fit decreasing.

    Bins are kept by free space, so finding the tightest is a walk over at most
    ``capacity`` free-space classes, whatever the number of items.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    classes = 0  # bit f is set when a bin with f free tokens exists
    fills: list[int] = []
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = classes >> size
        if fitting:
            f = size + (fitting & -fitting).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                classes &= ~(1 << f)
        else:
            f, b = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += size
        left = f - size
        if left:
            free[left].append(b)
            classes |= 1 << left
    return bins, places, np.array(fills, dtype=np.int64)


def local_pieces(batches: Iterator, path: str) -> Iterator:
    """Level 0: the pieces of a partition's documents, packed among themselves."""
    import pyarrow as pa

    node = TaskContext.get().partitionId()
    ids = ids_of(path)
    end = np.array([END_ID], dtype="<u4").tobytes()
    docs: list[pa.Array] = []
    out: list[tuple] = []
    done = 0
    for rows in batches:
        for at in range(0, rows.num_rows, 256):
            some = rows.slice(at, 256)
            docs.append(some.column("doc_id"))
            base, done = done, done + some.num_rows
            for i, b in enumerate(ids([t or "" for t in some.column("text").to_pylist()])):
                b += end
                total = len(b) // 4
                first = total % CAPACITY or CAPACITY
                edges = [0, *range(first, total + 1, CAPACITY)]
                for k, (s, e) in enumerate(zip(edges, edges[1:])):
                    out.append((base + i, k, s, e - s, zlib.crc32(b[4 * s: 4 * e])))
    if not out:
        return
    row, piece, start, length, crc = (np.array(c, dtype=np.int64) for c in zip(*out))
    bins, places, fills = best_fit(length)
    fill = fills[bins]
    table = pa.table([pa.chunked_array(docs).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc),
                      pa.array(bins + (node << 32)), pa.array(places), pa.array(fill), pa.array(fill < CAPACITY - NEARLY_FULL)],
                     names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill", "open"])
    yield from table.to_batches(max_chunksize=50_000)


def _merge_round(opened: DataFrame, nodes: int) -> DataFrame:
    """Pack the open bins (bin, node, fill) of each group of nodes: (bin, into, shift, fill, node, open)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        group = int(rows["node"].iloc[0]) // FAN_IN
        bins, places, fills = best_fit(rows["fill"].to_numpy())
        first = np.full(len(fills), -1, dtype=np.int64)
        first[bins[::-1]] = rows["bin"].to_numpy()[::-1]  # a merged bin keeps the number of its first member
        kept = np.zeros(len(fills), dtype=np.int64)
        for size in np.unique(fills):
            same = np.flatnonzero(fills == size)
            kept[same] = np.arange(len(same))
        still = (fills < CAPACITY - NEARLY_FULL) & (kept < nodes)
        return pd.DataFrame({"bin": rows["bin"], "into": first[bins], "shift": places, "fill": fills[bins],
                             "node": group, "open": still[bins]})

    return (opened.groupBy((F.col("node") / FAN_IN).cast("long").alias("parent"))
            .applyInPandas(run, "bin long, into long, shift long, fill long, node long, open boolean"))


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: local_pieces(batches, tokenizer_path), PIECE_SCHEMA), "pieces")
    node = F.shiftright("bin", 32)
    nodes = (pieces.agg(F.max(node)).first()[0] or 0) + 1
    opened = (pieces.where("open").groupBy("bin").agg(F.first("fill").alias("fill"))
              .select("bin", node.alias("node"), "fill"))
    moved, level = None, 0
    while nodes > 1:
        nodes, level = -(-nodes // FAN_IN), level + 1
        merged = scratch.cut(_merge_round(opened, nodes), f"round{level}")
        step = merged.select("bin", "into", "shift")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("_to"), F.col("shift").alias("_more"))
            moved = scratch.cut(moved.join(later, "into", "left").select(
                "bin", F.coalesce("_to", "into").alias("into"),
                (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift")), f"moved{level}")
        opened = merged.where("open AND bin = into").select("bin", "node", "fill")
    if moved is None:
        placed = pieces.withColumn("into", F.col("bin")).withColumn("shift", F.lit(0))
    else:
        placed = pieces.join(moved.where("bin != into OR shift != 0"), "bin", "left")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         F.coalesce("into", "bin").alias("sequence_id"),
                         (F.col("place") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"))
