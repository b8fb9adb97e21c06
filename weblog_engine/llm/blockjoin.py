"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; a task holds one block of each
and works through tiles of them. Vectors are quantised to int8 with one scale
each, so a tile of int8 products estimates inner products, and the norms of the
vectors and of what rounding lost bound the error. Pairs whose upper bound
reaches the k-th largest lower bound of their query survive; their products are
computed again in double precision and go into the query's heap of k. The heaps
of a query's tasks are merged at the end. The result is exact.

Nearness is the inner product, ties go to the smaller candidate id. Null, zero
or empty vectors and vectors with null or non-finite components take no part,
nor do null ids. Rows equal in id and vector count as one, and a query's own row is
the one equal to it in both: rows that share an id but not the vector are different
rows, found by each other, and each of them that asks gets ranks of its own.
Vectors of different lengths are compared only within their length. With fewer
candidates than k all are returned; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved

BLOCK_QUERIES, BLOCK_CANDIDATES = 2048, 16384  # rows a task holds of each side
TILE = 2048  # candidates in one product


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of what they stand for, norms of the rest."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    shown = q * scale[:, None]
    return q, scale, np.linalg.norm(shown, axis=1), np.linalg.norm(x - shown, axis=1)


class Heaps:
    """The k nearest of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.scores: list[np.ndarray] = [np.zeros(0)] * n
        self.least = np.full(n, -np.inf)

    def push(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[row], ids]), np.concatenate([self.scores[row], scores])
        if len(ids) > self.k:
            # all that tie with the k-th score, so that ids decide among them
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= kth
            ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids[row], self.scores[row] = ids[order], scores[order]
        if len(order) == self.k:
            self.least[row] = self.scores[row][-1]


def search_block(q_ids, q, c_ids, c, k: int) -> Heaps:
    """The k nearest candidates of each query, exact."""
    heaps = Heaps(len(q), k)
    if not len(q) or not len(c):
        return heaps
    q8, qs, qn, qr = quantise(q)
    c8, cs, cn, cr = quantise(c)
    q32 = q8.astype(np.float32)
    # int8 products are summed exactly in float32 while they stay below 2^24
    exact = 127 * 127 * q.shape[1] < 1 << 24
    for at in range(0, len(c), TILE):
        part = slice(at, at + TILE)
        if exact:
            dots = (q32 @ c8[part].astype(np.float32).T).astype(np.float64)
        else:
            dots = q8.astype(np.float64) @ c8[part].astype(np.float64).T
        about = dots * qs[:, None] * cs[None, part]
        # |<q, c> - <q', c'>| <= |q'| |c - c'| + |q - q'| |c'| + |q - q'| |c - c'|
        off = qn[:, None] * cr[None, part] + qr[:, None] * (cn[None, part] + cr[None, part])
        off = off * (1 + 1e-9) + 1e-12 * (qn[:, None] + qr[:, None]) * (cn + cr)[None, part]
        at_q, at_c = np.nonzero(q_ids[:, None] == c_ids[None, part])
        own = (q[at_q] == c[part][at_c]).all(axis=1)
        about[at_q[own], at_c[own]] = -np.inf
        # products beyond the range of doubles have no bound: such pairs stay
        low = about - off
        low[np.isnan(low)] = -np.inf
        bar = heaps.least.copy()
        if low.shape[1] >= k:
            bar = np.maximum(bar, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        alive = ~(about + off < bar[:, None])
        alive[at_q[own], at_c[own]] = False
        for row in np.flatnonzero(alive.any(axis=1)):
            cols = at + np.flatnonzero(alive[row])
            heaps.push(row, c_ids[cols], c[cols] @ q[row])
    return heaps


def _block_of(col: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(blocks)).cast("int")


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for each query."""
    spark = candidates.sparkSession
    prepare(spark)

    def clean(df):
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
            & F.exists("v", lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")) \
            .where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False))) \
            .distinct().withColumn("dim", F.size("v"))

    c = saved(clean(candidates).withColumn("number", F.lit(0).cast("long")), "vectors")
    # the number tells queries of one id apart; it is fixed once written
    q = saved(clean(queries).withColumn("number", F.monotonically_increasing_id()), "query_vectors")
    per_q, per_c = (max(1, math.ceil(x.count() / n)) for x, n in ((q, BLOCK_QUERIES), (c, BLOCK_CANDIDATES)))
    # every query block meets every candidate block: the stated query set
    # against all rows, in blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda df, is_query: df.withColumn("is_query", F.lit(is_query))
    rows = side(q.withColumn("qb", _block_of("id", per_q)).withColumn("cb", every(per_c)), True) \
        .unionByName(side(c.withColumn("cb", _block_of("id", per_c)).withColumn("qb", every(per_q)), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block pair, so one pair is held at a time."""
        held, key = [], None
        for b in batches:
            block = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in ("dim", "qb", "cb")])
            edges = np.flatnonzero(np.any(np.diff(block, axis=1) != 0, axis=0)) + 1
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                if a == z:
                    continue
                if key != tuple(block[:, a]):
                    yield from finish(held)
                    held, key = [], tuple(block[:, a])
                held.append(b.slice(a, z - a))
        yield from finish(held)

    def finish(held) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids, is_query = t.column("id").to_numpy(), t.column("is_query").to_numpy()
        dim = t.column("dim")[0].as_py()
        v = t.column("v").combine_chunks()
        v = (v.flatten() if not isinstance(v, pa.ChunkedArray) else pa.concat_arrays([x.flatten() for x in v.chunks])) \
            .to_numpy().reshape(-1, dim)
        heaps = search_block(ids[is_query], v[is_query], ids[~is_query], v[~is_query], k)
        n = [len(x) for x in heaps.ids]
        if sum(n):
            numbers = t.column("number").to_numpy()[is_query]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[is_query], n)), pa.array(np.repeat(numbers, n)), pa.array(np.concatenate(heaps.ids)),
                 pa.array(np.concatenate(heaps.scores))], ["query_id", "number", "vec_id", "score"])

    found = rows.repartition(per_q * per_c, "dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb") \
        .select("id", "v", "dim", "is_query", "qb", "cb", "number") \
        .mapInArrow(run, "query_id long, number long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id", "number").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
