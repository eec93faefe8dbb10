"""SentencePiece encoding and decoding by suffix-array matching.

A batch's different chunks (a run of word marks and the word after it; no piece
crosses their borders) are concatenated and indexed by a suffix array over the
longest piece's length. Every piece is binary-searched for its range in the
array; the occurrences are edges (start, end, piece), which are sorted by
position and relaxed from left to right.

The model file holds merge ranks, not unigram costs, so an edge is relaxed by
the rule that makes a segmentation the one of the merge order: every prefix has
one encoding, and a piece can follow the last piece of a prefix exactly if the
two, merged from characters on their own, come out as these two pieces. That
check is remembered per pair. The result equals the library's, piece by piece.

Characters outside the vocabulary become their UTF-8 bytes' pieces.

Defined cases: null and empty texts have no ids and decode to the empty text;
every input row gives one row; null ids stay null; extra columns are ignored. A
text with the word mark character itself decodes with a space there, as in the
library.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHE_CHUNKS, CACHE_PAIRS = 300_000, 500_000  # two generations of chunks are kept
CLOSED, FREE = -2, -1
LONG = 48  # longer chunks are relaxed one by one


class Model:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.id = {self.names[i]: i for i in plain}
        self.width = max(len(p) for p in self.id)
        self.sorted = np.array(sorted(self.id), dtype=f"<U{self.width}")
        self.after = np.array([p + "\U0010ffff" * (self.width - len(p)) for p in self.sorted], dtype=f"<U{self.width}")
        self.lengths = np.array([len(p) for p in self.sorted])
        self.raw = [p.encode() for p in self.names]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.number = [self.id[p] for p in self.sorted.tolist()]
        self.numbers = np.array(self.number)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether the two pieces (numbers in sorted order) come out of merging as they are."""
        known = self.pairs.get(left * len(self.sorted) + right)
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            a, b = str(self.sorted[left]), str(self.sorted[right])
            known = self.pairs[left * len(self.sorted) + right] = self.merged(a + b) == [a, b]
        return known

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of a piece, by end, then start."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        padded = np.concatenate((codes, np.zeros(self.width, dtype=np.uint32)))
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[: len(codes)])
        keys = windows.view(f"<U{self.width}").reshape(-1)
        array = np.argsort(keys, kind="stable")
        ordered = keys[array]
        low, high = np.searchsorted(ordered, self.sorted, "left"), np.searchsorted(ordered, self.after, "right")
        count = np.maximum(high - low, 0)
        first = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        start = array[first]
        end = start + np.repeat(self.lengths, count)
        order = np.lexsort((start, end))
        return start[order], end[order], np.repeat(np.arange(len(count)), count)[order]

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        codes, place = np.unique(before * len(self.sorted) + piece, return_inverse=True)
        get, many = self.pairs.get, len(self.sorted)
        fits = [get(c) for c in codes.tolist()]
        for i, c in enumerate(codes.tolist()):
            if fits[i] is None:
                fits[i] = self.follows(*divmod(c, many))
        return np.array(fits, dtype=bool)[place]

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks, from one index over their concatenation."""
        text = "\0".join(chunks) + "\0"
        starts, ends, found = self.edges(text)
        sizes = np.array([len(c) for c in chunks])
        first = np.cumsum(sizes + 1) - sizes - 1
        bound = np.searchsorted(ends, np.arange(len(text) + 2))
        inside = np.zeros(len(text) + 1, dtype=bool)  # the character that ends here is a piece
        inside[ends[starts == ends - 1]] = True
        # The last piece of the prefix that ends here: CLOSED, none (FREE: a chunk's
        # start, or behind a character outside the vocabulary), or its number.
        last, begin = np.full(len(text) + 1, CLOSED), np.zeros(len(text) + 1, dtype=np.int64)
        last[first] = FREE
        short = sizes <= LONG
        for c in np.flatnonzero(~short).tolist():
            self.relax_one(int(first[c]), int(sizes[c]), starts, found, bound, inside, last, begin)
        # Short chunks are relaxed side by side, a position at a time.
        for k in range(1, int(sizes[short].max(initial=0)) + 1):
            end = first[short & (sizes >= k)] + k
            todo, edge, stop = end, bound[end], bound[end + 1]
            while len(todo):
                more = edge < stop
                todo, edge, stop = todo[more], edge[more], stop[more]
                start, piece = starts[edge], found[edge]
                before = last[start]
                fits, asked = before == FREE, np.flatnonzero(before >= 0)
                fits[asked] = self.may_follow(before[asked], piece[asked])
                last[todo[fits]], begin[todo[fits]] = piece[fits], start[fits]
                todo, edge, stop = todo[~fits], edge[~fits] + 1, stop[~fits]
            bare = end[(last[end] == CLOSED) & (last[end - 1] != CLOSED) & ~inside[end]]
            last[bare], begin[bare] = FREE, bare - 1  # outside the vocabulary
        self.walk(chunks, text, first, sizes, last, begin)

    def relax_one(self, at: int, size: int, starts, found, bound, inside, last, begin) -> None:
        """The relaxation of one chunk, edge by edge."""
        edges = bound[at: at + size + 2].tolist()
        low = edges[0]
        s_list, p_list = (starts[low: edges[-1]] - at).tolist(), found[low: edges[-1]].tolist()
        known = inside[at: at + size + 1].tolist()
        ends, back = [FREE] + [CLOSED] * size, [0] * (size + 1)
        for end in range(1, size + 1):
            for i in range(edges[end] - low, edges[end + 1] - low):
                before = ends[s_list[i]]
                if before != CLOSED and (before == FREE or self.follows(before, p_list[i])):
                    ends[end], back[end] = p_list[i], s_list[i]
                    break
            else:
                if ends[end - 1] != CLOSED and not known[end]:
                    ends[end], back[end] = FREE, end - 1
        last[at: at + size + 1], begin[at: at + size + 1] = ends, np.array(back) + at

    def walk(self, chunks: list[str], text: str, first, sizes, last, begin) -> None:
        """Read the pieces of every chunk back from its end."""
        on = np.zeros(len(last), dtype=bool)
        chunk, at = np.arange(len(chunks)), first + sizes
        while len(chunk):
            more = at > first[chunk]
            chunk, at = chunk[more], at[more]
            on[at] = True
            at = begin[at]
        on = np.flatnonzero(on)
        pieces = last[on]
        data = self.numbers[pieces].astype("<u4").tobytes()
        cuts = np.searchsorted(on, np.concatenate((first, [len(last)])), "right")
        self.chunks.update(zip(chunks, [data[a: b] for a, b in zip((4 * cuts[:-1]).tolist(), (4 * cuts[1:]).tolist())]))
        for c in np.unique(np.searchsorted(first, on[pieces == FREE]) - 1).tolist():  # bytes stand for a character
            out: list[int] = []
            for end, piece in zip(on[cuts[c]: cuts[c + 1]].tolist(), pieces[cuts[c]: cuts[c + 1]].tolist()):
                out.extend([self.number[piece]] if piece != FREE else [self.bytes[b] for b in text[end - 1].encode("utf-8", "surrogatepass")])
            self.chunks[chunks[c]] = np.array(out, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.old, self.chunks = self.chunks, {}
        parts = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*parts).difference(self.chunks)
        again = new & self.old.keys()  # chunks still in use outlive a full memory
        self.chunks.update(zip(again, map(self.old.__getitem__, again)))
        batch: list[str] = []
        size = 0
        for c in sorted(new - again):  # the index takes a bounded length at a time
            batch.append(c)
            size += len(c) + 1
            if size > 300_000:
                self.learn(batch)
                batch, size = [], 0
        if batch:
            self.learn(batch)
        return [b"".join(map(self.chunks.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return out.decode("utf-8", "replace").replace(MARK, " ")[1:]


@functools.lru_cache(maxsize=1)
def model_of(path: str) -> Model:
    """One model and memory a Python worker, for all tasks it runs."""
    return Model(path)


def encode(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256) of every document; ``ids`` as an array if asked for."""
    import hashlib

    def make():
        model = model_of(model_path)

        def run(texts: list) -> tuple[None, list]:
            data = model.encode([t or "" for t in texts])
            out = [[len(d) // 4 for d in data], [zlib.crc32(d) for d in data],
                   [hashlib.sha256(model.decode(d).encode("utf-8", "surrogatepass")).hexdigest() for d in data]]
            return None, out + ([[np.frombuffer(d, dtype="<u4").astype(np.int32) for d in data]] if with_ids else [])
        return run

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", ["doc_id"], make,
                      "n_ids long, ids_crc32 long, decoded_sha256 string" + (", ids array<int>" if with_ids else ""), step=2048)
