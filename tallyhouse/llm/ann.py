"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Index. Every vector is rotated by a seeded random orthogonal matrix; the signs
of the rotated unit vector are its code (one bit a dimension), beside its norm
and the inner product of the unit vector with its own code. Blocks of at most
``BLOCK`` vectors form one row each: ids, packed codes, scalars and the original
vectors for reranking. No centre is subtracted: inner products are estimated
directly, which keeps the index free of any fit.

Search. A query block meets every index block. The inner product of query and
vector is estimated from the code as norm * <q, code> / <v, code>, with an error
of at most ``EPSILON`` / sqrt(dims - 1) times the tangent of the angle between
the vector and its code, which holds with a probability set by ``EPSILON``. A
vector is reranked, in double precision on the original vectors, when its upper
bound reaches the k-th largest lower bound of the block (or of what the task has
found already), so the candidates adapt to the data and have no cap. The best
``k`` of each block are merged per query.

The stated query set meets all rows in blocks: each index block is shipped once
per query block, never a pair of rows. Only block numbers are broadcast-sized.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither do rows without an id or of another length than
the most common one of the table (the shortest of equally common ones). Rows
that repeat an id are vectors of their own, but never candidates of a query with
that id. Ties in score go to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 8192
QUERY_BLOCK = 1024
EPSILON = 2.5
SEED = 11


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector_col)
    one = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    one = one.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0))
    return one


def _blocks(batches: Iterator[pd.DataFrame], dims: int, size: int, coded: bool) -> Iterator[pd.DataFrame]:
    """Rows of at most ``size`` vectors: ids and vectors, with codes and scalars if asked for."""
    turn = rotation(dims)

    def block(ids: np.ndarray, vecs: np.ndarray) -> dict:
        row = {"ids": ids.astype("<i8").tobytes(), "vecs": vecs.astype("<f8").tobytes()}
        if coded:
            largest = np.abs(vecs).max(axis=1, keepdims=True)
            unit = vecs / largest  # a length of huge or tiny entries comes from scaled ones
            length = np.linalg.norm(unit, axis=1, keepdims=True)
            with np.errstate(over="ignore"):
                norms = np.minimum(largest * length, np.finfo(np.float64).max).ravel()
            unit = unit / length @ turn.T
            row |= {"codes": np.packbits(unit > 0, axis=1).tobytes(), "norms": norms.tobytes(),
                    "own": (np.abs(unit).sum(axis=1) / np.sqrt(dims)).tobytes()}
        return row

    held_ids: list[np.ndarray] = []
    held: list[np.ndarray] = []
    count = 0
    for rows in batches:
        if not len(rows):
            continue
        held_ids.append(rows["id"].to_numpy(dtype=np.int64))
        held.append(np.stack(rows["v"].to_numpy()).astype(np.float64))
        count += len(rows)
        while count >= size:
            ids, vecs = np.concatenate(held_ids), np.concatenate(held)
            yield pd.DataFrame([block(ids[:size], vecs[:size])])
            held_ids, held, count = [ids[size:]], [vecs[size:]], count - size
    if count:
        yield pd.DataFrame([block(np.concatenate(held_ids), np.concatenate(held))])


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vecs: np.ndarray, codes: np.ndarray,
                 norms: np.ndarray, own: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of one index block for each query: (query_id, vec_id, score)."""
    dims = vecs.shape[1]
    signs = np.unpackbits(codes.reshape(len(ids), -1), axis=1, count=dims).astype(np.float32) * 2 - 1
    # Estimates for queries of length one and lengths relative to the block's longest
    # vector: what a query's own length and the block's scale do to them is the same
    # for all its candidates, and no finite entry overflows.
    turned = q / np.abs(q).max(axis=1, keepdims=True)
    turned = turned / np.linalg.norm(turned, axis=1, keepdims=True) @ rotation(dims).T
    norms = norms / norms.max()
    scale = norms / (np.sqrt(dims) * own)
    spread = norms * np.sqrt(np.maximum(1 - own ** 2, 0)) / own * EPSILON / np.sqrt(max(dims - 1, 1))
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(q), 128):
        guess = turned[at: at + 128].astype(np.float32) @ signs.T * scale
        own_row = q_ids[at: at + 128, None] == ids[None, :]
        low = np.where(own_row, -np.inf, guess - spread)
        high = np.where(own_row, -np.inf, guess + spread)
        floor = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(low), -np.inf)
        for i in range(len(low)):
            pick = np.flatnonzero((high[i] >= floor[i]) & ~own_row[i])
            exact = vecs[pick] @ q[at + i]
            best = np.lexsort((ids[pick], -exact))[:k]
            out_q.append(np.full(len(best), q_ids[at + i]))
            out_v.append(ids[pick][best])
            out_s.append(exact[best])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def _search(batches: Iterator[pd.DataFrame], dims: int, k: int) -> Iterator[pd.DataFrame]:
    read = lambda data, kind="<f8": np.frombuffer(data, dtype=kind)
    for rows in batches:
        for r in rows.itertuples(index=False):
            ids = read(r.ids, "<i8")
            yield search_block(read(r.q_ids, "<i8"), read(r.q_vecs).reshape(-1, dims), ids, read(r.vecs).reshape(-1, dims),
                               read(r.codes, np.uint8), read(r.norms), read(r.own), k)


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` to each row of ``queries``."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    base = usable(vectors, id_col, vector_col)
    common = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], out)
    dims, count = common["d"], common["count"]
    scratch = Scratch(spark, "ann")
    index = scratch.cut(base.where(F.size("v") == dims).repartition(-(-count // BLOCK), F.xxhash64("id", "v")).mapInPandas(
        lambda b: _blocks(b, dims, BLOCK, True), "ids binary, vecs binary, codes binary, norms binary, own binary"), "index")
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dims)
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], out)
    wanted = scratch.cut(asked.repartition(-(-n_queries // QUERY_BLOCK), F.xxhash64("id", "v")).mapInPandas(
        lambda b: _blocks(b, dims, QUERY_BLOCK, False), "ids binary, vecs binary"), "queries")
    wanted = scratch.cut(wanted.select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
                         .withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    numbers = [r["block"] for r in wanted.select("block").collect()]  # one number per QUERY_BLOCK queries
    pairs = (index.withColumn("block", F.explode(F.lit(numbers).cast("array<bigint>")))
             .withColumn("salt", F.crc32("ids") % 16).repartition("block", "salt").join(wanted, "block"))
    found = pairs.select("ids", "vecs", "codes", "norms", "own", "q_ids", "q_vecs").mapInPandas(
        lambda b: _search(b, dims, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
