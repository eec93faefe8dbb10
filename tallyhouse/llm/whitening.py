"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Let A be the centred rows of the fit list (each distinct vector once). Two
orthonormal bases grow by turns: v (one entry a dimension, on the driver) and
u = A v (one entry a row, never stored: every u is A w for a known short w, so a
task forms its part of it from its rows). One step is one pass over the rows:
a task multiplies its block by w and by all earlier w, and returns u'u, the
inner products of u with every earlier u, and its part of A'u. Both bases are
reorthogonalised against all earlier vectors in every step; a step whose u lost
much of its length is passed again. What links the bases is a small matrix, a
bidiagonal but for rounding, whose singular values and right vectors give
deviations and components.

The recursion ends when the wanted components are settled (residual against the
gap to the next value) **and** what is left of the squared length of A is less
than the last wanted value holds, so no value, a repeated one either, is
overlooked; at the latest after as many steps as there are dimensions. A space
that closes early is left by a new random direction. The result does not depend
on partitions except by rounding; a lost executor repeats its blocks of a pass.

Rows:

* a null vector, or one that holds null, NaN or an infinity, takes no part;
* shorter vectors are filled up with zeros to the longest of the table;
* repeated vectors and repeated or null ids get rows each; the fit counts a
  vector once;
* there are as many components as directions with variance, ``count`` at most: a
  single distinct vector, or an empty table, gives no rows;
* entries beyond a long are cut to its range, and a deviation beyond it is null;
* extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

STEPS = 256
COUNT = 4
SEED = 20_241
#: Relative to the length of A: below it a value counts as zero.
ZERO = 1e-12
#: Residual over gap at which a component counts as settled.
SETTLED = 1e-14


class Fit(NamedTuple):
    n: int
    total: list[int]           # exact sum of the rows, per dimension
    components: np.ndarray     # one unit vector a row
    variances: np.ndarray
    trace: float
    identity_error: float
    passes: int


def steps(c: Column) -> Column:
    """An entry as a whole number of 1/256."""
    return F.floor(c.cast("double") * STEPS).cast("long")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): vectors of whole steps, without those that take no part."""
    v = F.col(f"`{vector_col}`")
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vectors.where(v.isNotNull()).where(~F.exists(v, bad)).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, steps).alias("x"))


def _blocks(batches: Iterator, dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _sums(rows: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (a vector) over all blocks of all tasks."""
    def run(batches):
        import pyarrow as pa
        acc = None
        for block in _blocks(batches, dims):
            acc = part(block.astype(np.float64)) + (0 if acc is None else acc)
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc)), pa.int32()), pa.array(acc, pa.float64())], ["i", "v"])
    got = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for i, v in got:
        out[i] = v
    return out


def _exact_totals(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Row count and the exact sum per dimension."""
    def run(batches):
        import decimal

        import pyarrow as pa
        n, acc = 0, [0] * dims
        for block in _blocks(batches, dims):
            n += len(block)
            small = float(np.abs(block.astype(np.float64)).max()) * len(block) < 2.0 ** 62
            acc = [a + int(b) for a, b in zip(acc, (block if small else block.astype(object)).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([decimal.Decimal(a) for a in [*acc, n]], pa.decimal128(38, 0))], ["i", "s"])
    got = {i: int(s) for i, s in rows.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return got.get(dims, 0), [got.get(i, 0) for i in range(dims)]


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], dims: int, energy: float,
                  count: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, right vectors as rows, passes) of the largest ``count``.

    ``product(W, w)`` is one distributed pass: for u = A w it returns the inner
    products of u with every A W[i], u'u, and A'u. ``energy`` is the squared
    Frobenius length of A.
    """
    rng = np.random.default_rng(SEED)
    scale = energy ** 0.5
    V, W, Z = [], [], []                    # right basis; w of the left basis; A'u of the left basis
    H = np.zeros((dims, dims))              # A V = U H
    v, beta, passes = None, 0.0, 0
    while True:
        if v is None:                       # a new direction outside the space found
            v = _orthogonal(rng.standard_normal(dims), V)
            v, beta = v / np.linalg.norm(v), 0.0
        j, k = len(V), len(W)
        V.append(v)
        w = v - beta * W[-1] if beta else v.copy()
        if beta:
            H[k - 1, j] = beta
        for again in range(3):
            g, uu, z = product(np.array(W).reshape(k, dims), w)
            passes += 1
            left = uu - g @ g
            if k:                           # take off what lies along earlier u, on all three forms of u
                w, z = w - g @ np.array(W), z - g @ np.array(Z)
                H[:k, j] += g
            if left > 0.5 * uu or left <= (ZERO * scale) ** 2:
                break
        alpha = max(left, 0.0) ** 0.5
        beta, v = 0.0, None
        if alpha > ZERO * scale:
            W.append(w / alpha)
            Z.append(z / alpha)
            H[k, j] = alpha
            r = _orthogonal(z / alpha, V)
            beta = float(np.linalg.norm(r))
            if beta > ZERO * scale:
                v = r / beta
            else:
                beta = 0.0
        k, j = len(W), len(V)
        if k:
            P, s, Q = np.linalg.svd(H[:k, :j], full_matrices=False)
            wanted = min(count, len(s))
            rest = energy - float(s @ s)
            after = np.append(s, 0.0)[1:wanted + 1]
            gap = np.minimum(s[:wanted] - after, np.append(np.inf, s[:wanted - 1] - s[1:wanted]) if wanted > 1 else np.inf)
            residual = beta * np.abs(P[-1, :wanted])
            settled = wanted == count and bool(np.all(residual <= SETTLED * np.maximum(gap, 0)) and rest < s[wanted - 1] ** 2)
        else:
            settled = False
        if settled or j == dims or (k and rest <= (ZERO * scale) ** 2 and beta == 0.0):
            break
    if not k:
        return np.zeros(0), np.zeros((0, dims)), passes
    keep = s[:wanted] > ZERO * scale
    return s[:wanted][keep], (Q[:wanted] @ np.array(V))[keep], passes


def fit(rows: DataFrame, dims: int, count: int = COUNT) -> Fit | None:
    """The largest components of distinct ``rows`` (x); None without variance."""
    n, total = _exact_totals(rows, dims)
    if n < 2:
        return None
    mean = np.array([t / n for t in total])
    energy = float(_sums(rows, dims, lambda x: np.array([((x - mean) ** 2).sum()]))[0])
    if energy == 0.0:
        return None

    def product(W: np.ndarray, w: np.ndarray):
        def part(x: np.ndarray) -> np.ndarray:
            a = x - mean
            u = a @ w
            return np.concatenate([(a @ W.T).T @ u, [u @ u], a.T @ u])
        got = _sums(rows, dims, part)
        return got[:len(W)], float(got[len(W)]), got[len(W) + 1:]

    values, parts, passes = bidiagonalise(product, dims, energy, min(count, dims))
    parts = np.array([p / np.linalg.norm(p) * (1.0 if p[np.abs(p).argmax()] > 0 else -1.0) for p in parts]).reshape(len(values), dims)
    variances = values ** 2 / n
    turn = parts.T / np.sqrt(variances)
    centre = _sums(rows, dims, lambda x: ((x - mean) @ turn).sum(axis=0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ turn - centre
        return (z.T @ z).ravel()
    spread = _sums(rows, dims, products).reshape(len(values), len(values)) / n
    return Fit(n, total, parts, variances, energy / n, float(np.abs(spread - np.eye(len(values))).max()), passes)


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sum over the dimensions of (n*x - S)**2; null beyond a long."""
    top = int(np.abs(x.astype(np.float64)).max()) + 1 if x.size else 1
    far = max(abs(t) for t in total) + 1
    if x.shape[1] * (n * top + far) ** 2 < 1 << 62:
        off = n * x - np.array(total, dtype=np.int64)
        return [int(v) for v in (off * off).sum(axis=1)]
    off = n * x.astype(object) - np.array(total, dtype=object)
    return [d if d < 1 << 63 else None for d in (int(v) for v in (off * off).sum(axis=1))]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COUNT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = usable(vectors, id_col, vector_col)
    dims = found.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], schema)
    found = found.select("id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))).alias("x"))
    distinct = scratch.cut(found.select("x").distinct(), "fit")
    model = fit(distinct, dims, count)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], schema)
    mean = np.array([t / model.n for t in model.total])
    turn = model.components.T / np.sqrt(model.variances)
    explained, found_parts = model.variances / model.trace, len(model.variances)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(m, dims)
            order = pa.array(np.repeat(np.arange(m), found_parts))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(order), pa.array(np.tile(np.arange(1, found_parts + 1), m), pa.int32()),
                pa.array(np.full(m * found_parts, model.n), pa.int64()), pa.array(_deviations(x, model.n, model.total), pa.int64()).take(order),
                pa.array(((x.astype(np.float64) - mean) @ turn).ravel(), pa.float64()), pa.array(np.tile(explained, m), pa.float64()),
                pa.array(np.full(m * found_parts, model.identity_error), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return found.mapInArrow(run, schema)
