"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (3 to 5 letters
with word-edge marks, and the whole word); a document is the mean of its words;
a linear softmax over that mean gives the two class probabilities. Embeddings
and softmax are trained jointly with Adam in numpy, so misspellings and
inflections never seen in training share n-gram vectors with known words.

Training sees at most ``max_docs`` labelled rows (a documented bound), a quarter
of them toxic at most, taken by hash order over all labelled rows. It runs in
one Spark task over that bounded sample; only the model comes to the driver.

At scoring time the model is linear in the document mean, so every n-gram
bucket collapses to one number: its toxic minus clean logit. That table has a
fixed size (``buckets`` floats) and is what the scoring tasks receive.

Defined cases: null and empty texts, and texts without a word, have an empty
bag and score by the softmax bias alone; with no usable label the score is 0.0,
with labels of one class only it is that class. Labels repeated for a document
count once, toxic if any row says so. Null labels are ignored. Every input row
gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

WORD = re.compile(r"[^\W_]+")
MIN_N, MAX_N = 3, 5
CACHE_WORDS = 400_000
STEP = 256  # texts cut into words at a time


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 17
    dim: int = 8
    max_docs: int = 6000
    steps: int = 250
    prune: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
    batch: int = 128
    rate: float = 0.05
    decay: float = 0.01
    min_docs: int = 20
    seed: int = 7


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of every n-gram of every word, vectorised over the words."""
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    owner = np.repeat(np.arange(len(words)), lens)
    ends = np.cumsum(lens)
    left = ends[owner] - np.arange(len(chars))  # characters up to the word's end
    mixed = _mix(chars + np.uint64(0x9E3779B97F4A7C15))
    out_b, out_w = [], []
    h = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, MAX_N + 1):
        part = np.zeros_like(h)
        if n <= len(chars):
            part[: len(chars) - n + 1] = mixed[n - 1:]
        h = h * np.uint64(0x100000001B3) + part
        if n >= MIN_N:
            keep = left >= n
            out_b.append(_mix(h[keep] + np.uint64(n)) % np.uint64(buckets))
            out_w.append(owner[keep])
    # the whole word is a subword too: sum of position-weighted characters
    pos = np.arange(len(chars)) - (ends - lens)[owner]
    weight = _mix(pos.astype(np.uint64) + np.uint64(77)) | np.uint64(1)
    whole = np.add.reduceat(mixed * weight, ends - lens) if len(words) else h
    out_b.append(_mix(whole) % np.uint64(buckets))
    out_w.append(np.arange(len(words)))
    return np.concatenate(out_b).astype(np.int64), np.concatenate(out_w)


def bag(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


class Bags:
    """Texts as counted words. A word has a number and its n-gram buckets once for all
    texts, so that a text takes eight bytes a distinct word and its string can go."""

    def __init__(self, buckets: int):
        self.buckets, self.vocab = buckets, {}
        self.ids, self.counts, self.grams, self.sizes = [], [], [], []

    def add(self, texts: list[str | None]) -> None:
        bags = [bag(t) for t in texts]
        new = sorted(set().union(*bags).difference(self.vocab))
        if new:
            b, w = subwords(new, self.buckets)
            self.grams.append(b[np.argsort(w, kind="stable")].astype(np.int32))
            self.sizes.append(np.bincount(w, minlength=len(new)))
            self.vocab.update(zip(new, range(len(self.vocab), len(self.vocab) + len(new))))
        for g in bags:
            self.ids.append(np.fromiter(map(self.vocab.__getitem__, g), dtype=np.int32, count=len(g)))
            self.counts.append(np.fromiter(g.values(), dtype=np.int32, count=len(g)))

    def matrix(self, min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each column, first entry of each text and the end, column and value of
        each entry) for the buckets of ``min_docs`` texts or more. Takes the words out."""
        self.vocab = {}
        grams = np.concatenate([np.zeros(0, dtype=np.int32), *self.grams])
        self.grams = []
        sizes = np.concatenate([np.zeros(0, dtype=np.int64), *self.sizes])
        starts = np.cumsum(sizes) - sizes

        def buckets_of(ids: np.ndarray, reps: np.ndarray) -> np.ndarray:
            return grams[np.repeat(starts[ids] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]

        in_docs, entries = np.zeros(self.buckets, dtype=np.int64), 0
        for ids in self.ids:
            has = np.zeros(self.buckets, dtype=bool)
            has[buckets_of(ids, sizes[ids])] = True
            in_docs += has
        used = np.flatnonzero(in_docs >= max(min_docs, 1))
        place = np.zeros(self.buckets, dtype=np.int32)
        place[used] = np.arange(1, len(used) + 1)  # 0: none
        most = int(in_docs[used].sum())
        col, val = np.empty(most, dtype=np.min_scalar_type(len(used))), np.empty(most, dtype=np.float32)
        bounds = np.zeros(len(self.ids) + 1, dtype=np.int64)
        for i, (ids, count) in enumerate(zip(self.ids, self.counts)):
            reps = sizes[ids]
            v = np.bincount(place[buckets_of(ids, reps)], weights=np.repeat(count / max(count.sum(), 1) / reps, reps))
            v[:1] = 0.0
            some = np.flatnonzero(v)
            entries += len(some)
            bounds[i + 1] = entries
            col[entries - len(some): entries], val[entries - len(some): entries] = some - 1, v[some]
            self.ids[i] = self.counts[i] = None  # the worker holds each text's parts once
        return used, bounds, col[:entries], val[:entries]


def train(texts: Iterable[str | None], labels: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """(toxic minus clean logit of each bucket, bias) after joint training."""
    bags, texts = Bags(p.buckets), iter(texts)
    while some := list(islice(texts, STEP)):
        bags.add(some)
    return train_bags(bags, labels, p)


def train_bags(bags: Bags, labels: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """``train`` on counted words, which it uses up."""
    labels = np.asarray(labels, dtype=np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        constant = 40.0 if len(labels) and labels[0] == 1 else -40.0
        return np.zeros(p.buckets, dtype=np.float32), constant
    # rarer ones keep a zero vector
    used, bounds, col, val = bags.matrix(min(p.min_docs, max(2, len(labels) // 100)))
    n, d, rng = len(labels), p.dim, np.random.default_rng(p.seed)
    emb = rng.normal(0, 0.02, (len(used), d))
    soft, bias = rng.normal(0, 0.5, (d, 2)), np.zeros(2)
    target = np.eye(2)[labels]
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, soft, bias)]
    mixed_up = rng.permutation(n)
    learn, tune = mixed_up[: max(1, n - n // 4)], mixed_up[n - n // 4:]
    step = 0
    while step < p.steps:
        shuffled = rng.permutation(learn)[: p.batch * (p.steps - step)]
        for at in range(0, len(shuffled), p.batch):
            step += 1
            ids = shuffled[at: at + p.batch]
            sizes = bounds[ids + 1] - bounds[ids]
            own = np.repeat(np.arange(len(ids)), sizes)
            pick = np.repeat(bounds[ids] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            c, v = col[pick].astype(np.int64), val[pick].astype(np.float64)
            del pick
            # one dimension at a time: a batch of long texts has many entries
            doc = np.stack([np.bincount(own, weights=emb[:, k][c] * v, minlength=len(ids)) for k in range(d)], axis=1)
            z = doc @ soft + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - target[ids]) * (1 / len(ids))
            back = g @ soft.T
            g_emb = np.stack([np.bincount(c, weights=back[:, k][own] * v, minlength=len(used)) for k in range(d)], axis=1)
            grads = (g_emb, doc.T @ g, g.sum(axis=0))
            for x, gr, (m, s) in zip((emb, soft, bias), grads, state):
                m += 0.1 * (gr - m)
                s += 0.01 * (gr * gr - s)
                x *= 1 - p.rate * p.decay
                x -= p.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    # Small logits are noise that sums up in short texts: prune them by the share
    # of the largest that gives the least loss on the quarter not trained on, with
    # slope and bias of the softmax fitted anew.
    raw = emb @ (soft[:, 1] - soft[:, 0])
    best = None
    for share in p.prune:
        cut = np.where(np.abs(raw) >= share * np.abs(raw).max(initial=0), raw, 0.0)
        x = np.concatenate([_sums(bounds[a: a + 257], col, val, cut) for a in range(0, n, 256)])
        at = tune if len(tune) and labels[tune].min() != labels[tune].max() else learn
        slope, offset = refit(x[at], labels[at])
        z = np.clip(x[at] * slope + offset, -40, 40)
        loss = np.mean(np.log1p(np.exp(-np.where(labels[at] == 1, z, -z))))
        if best is None or loss < best[0]:
            best = (loss, cut * slope, offset)
    table = np.zeros(p.buckets, dtype=np.float32)
    table[used] = best[1].astype(np.float32)
    return table, float(best[2])


def _sums(bounds: np.ndarray, col: np.ndarray, val: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sum of the values of each text between two ``bounds``."""
    some, sizes = slice(bounds[0], bounds[-1]), np.diff(bounds)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=val[some] * weight[col[some]], minlength=len(sizes))


def refit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic fit (damped Newton, small ridge)."""
    scale = np.abs(x).max(initial=0) or 1.0
    f = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    ridge = np.diag([1e-4, 1e-3])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        grad = f.T @ (q - y) + ridge @ w
        w -= np.clip(np.linalg.solve((f * (q * (1 - q))[:, None]).T @ f + ridge, grad), -5, 5)
    return w[0] / scale, w[1]


class Scorer:
    """Document score; remembers word values, at most CACHE_WORDS of them."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.cache = table.astype(np.float64), bias, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            bags = [WORD.findall((t or "").lower()) for t in texts[at: at + 256]]
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            new = list(set().union(*bags).difference(self.cache))
            if new:
                b, w = subwords(new, len(self.table))
                self.cache.update(zip(new, (np.bincount(w, weights=self.table[b]) / np.bincount(w)).tolist()))
            value = self.cache.__getitem__
            out[at: at + 256] = [sum(map(value, g)) / max(len(g), 1) + self.bias for g in bags]
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def learn(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """The model of all rows (text, toxic) as one row (logits, bias); no row without one."""
    bags, labels = Bags(p.buckets), []
    for rows in batches:
        for at in range(0, rows.num_rows, STEP):
            some = rows.slice(at, STEP)
            bags.add(some.column("text").to_pylist())
            labels += some.column("toxic").to_pylist()
    if labels:
        table, bias = train_bags(bags, labels, p)
        yield pa.RecordBatch.from_pydict({"logits": [table.tobytes()], "bias": [bias]})


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> tuple[np.ndarray, float]:
    """Model from a bounded sample of the labelled documents.

    ``labels`` has (doc_id, toxic) of the rows that may be learned from. The
    sample takes each class by hash order, a quarter of ``max_docs`` toxic rows and
    three quarters clean ones at most.
    """
    one = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    drawn = None
    for label in (0, 1):
        part = (one.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(params.seed)), "doc_id")
                .limit(params.max_docs // 4 if label else params.max_docs - params.max_docs // 4))
        drawn = part if drawn is None else drawn.unionByName(part)
    # One text an id, whatever the rows that repeat it, so the bound holds for rows too.
    sample = (docs.select("doc_id", "text").join(drawn, "doc_id").groupBy("doc_id", "toxic")
              .agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))

    model = (sample.repartition(1).sortWithinPartitions("doc_id")
             .mapInArrow(lambda batches: learn(batches, params), "logits binary, bias double").collect())
    if not model:
        return np.zeros(params.buckets, dtype=np.float32), -40.0
    return np.frombuffer(bytes(model[0]["logits"]), dtype=np.float32), model[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """``docs`` with a toxicity score of its text in ``column`` (0 to 1)."""
    logits = docs.sparkSession.sparkContext.broadcast(model[0])  # fixed size: Params.buckets floats
    bias = model[1]

    def make():
        scorer = Scorer(logits.value, bias)
        return lambda texts: (None, [scorer(texts)])

    return over_texts(docs, "text", docs.columns, make, f"`{column}` double", step=4096)


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out third (crc32 of the id text mod 3 is 1)."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
             params: Params = Params()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, learnable(labels), params))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
