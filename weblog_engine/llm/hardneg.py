"""Hard-negative mining by threshold joins on an inverted index.

Each anchor looks twice through all rows: for its first positives (rows of its
own label) and then, for every positive, for the first negatives (rows of other
labels) whose score lies in a window below the positive's score. Both are
threshold joins of anchor blocks with row blocks; a task holds one block of each.

The rows of a block are indexed by groups of dimensions, those with most weight
first. A group's list is sorted by the norm that a row has left from this group
on, so that for a threshold t and an anchor whose own remaining norm is r the
entries with norm * r >= t are the head of the list: what follows is covered by
the bound and is not looked at. Partial scores are added up group by group, and
a row is dropped once its partial score and the product of the remaining norms
stay below t. Rows left at the end are scored exactly in integers. The threshold
begins high and is lowered until the anchor's windows are full or nothing below
can count, so lowering it only lengthens the heads. The few best of each block
are merged for each window by a ranking over (anchor, positive).

Cases: rows with a null id, a null label, a null or empty vector, or any null or
non-finite component take no part. Rows equal in id, label and vector count
once; rows that share an id but differ are different rows, and an anchor's own
row is the only one it may not meet. Vectors of different lengths are never
compared. Ties go to the smaller id. Fewer rows than asked for give all there
are; an anchor without positives, or a positive with an empty window, gives none.
Components beyond 2^53 after scaling stand at that bound, and a score that leaves
64 bits is returned as null. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
BLOCK_ANCHORS, BLOCK_ROWS = 8192, 16384
GROUP = 8  # dimensions of a list
LOWERED = 0.85  # the next threshold over the last
_MOST = 1 << 53


class Index:
    """The lists of a block of rows."""

    def __init__(self, rows: np.ndarray):
        """rows: integers, one row a vector."""
        self.rows = rows
        x = rows.astype(np.float64)
        d = x.shape[1]
        self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        x = x[:, self.order]
        starts = range(0, d, GROUP)
        left = np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])
        # norm left from each group on, 0 after the last
        self.left = np.column_stack([left[:, s] for s in starts] + [np.zeros(len(x))]) if d else np.zeros((len(x), 1))
        self.lists = []
        for g, s in enumerate(starts):
            head = np.argsort(-self.left[:, g], kind="stable")
            self.lists.append((head, -self.left[head, g], x[head, s:s + GROUP]))
        self.most = float(self.left[:, 0].max()) if len(x) else 0.0

    def anchor(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An anchor's values in the order of the lists, and its norms left."""
        v = q.astype(np.float64)[self.order]
        return v, np.array([*(math.sqrt((v[s:] ** 2).sum()) for s in range(0, len(v), GROUP)), 0.0])

    def reaching(self, q: np.ndarray, v: np.ndarray, rest: np.ndarray, wanted: np.ndarray,
                 t: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows among ``wanted`` whose score with q is at least t, and scores."""
        slack = 1e-9 * (self.most * rest[0] + 1)
        if t > self.most * rest[0] + slack:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        alive, part = wanted.copy(), np.zeros(len(wanted))
        for g, (head, norms, values) in enumerate(self.lists):
            # entries that the norms left do not cover
            m = len(head) if t <= slack else np.searchsorted(norms, -(t - slack) / rest[g], "right") if rest[g] else 0
            if g == 0:
                alive[head[m:]] = False
            if not m:
                break
            ids = head[:m]
            on = np.flatnonzero(alive[ids])
            ids = ids[on]
            part[ids] += values[on] @ v[g * GROUP:(g + 1) * GROUP]
            alive[ids[part[ids] + rest[g + 1] * self.left[ids, g + 1] < t - slack]] = False
        found = np.flatnonzero(alive)
        scores = (self.rows[found] * q).sum(axis=1)
        ok = scores >= t
        return found[ok], scores[ok]


def lowered(index: Index, q: np.ndarray, wanted: np.ndarray, top: float, least: float, full) -> tuple[np.ndarray, np.ndarray]:
    """Rows among ``wanted`` from a threshold that starts at ``top`` and goes
    down until ``full(scores, threshold)`` or to ``least``."""
    v, rest = index.anchor(q)
    bound = index.most * rest[0] * (1 + 1e-9) + 1
    floor = max(least, -bound)
    t = max(min(top, bound), floor)
    step = max(1.0, (1 - LOWERED) * abs(t))
    while True:
        ids, scores = index.reaching(q, v, rest, wanted, t)
        if t <= floor or full(scores, t):
            return ids, scores
        t, step = max(t - step, floor), step * 1.5


def first(ids: np.ndarray, names: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller name."""
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(ids))
    return near[np.array(sorted(range(len(near)), key=lambda i: (-scores[near[i]], names[ids[near[i]]]))[:k], int)]


def windows(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest negative score of a positive's window."""
    return -((-low * positive) // 100), high * positive // 100


# --- the two joins -------------------------------------------------------------

def positives_of(index: Index, names, labels, numbers, q, label, number, k: int):
    """The first k rows of the anchor's own label in a block."""
    wanted = (labels == label) & (numbers != number)
    if not wanted.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, scores = lowered(index, q, wanted, float("inf"), -float("inf"), lambda s, t: len(s) >= k)
    top = first(ids, names, scores, k)
    return ids[top], scores[top]


def negatives_of(index: Index, names, labels, q, label, ends: list[tuple[int, int]], k: int):
    """(window, row, score) of the first k rows of other labels in each window."""
    open_ends = [(lo, hi) for lo, hi in ends if lo <= hi]
    wanted = labels != label
    if not open_ends or not wanted.any():
        return

    def full(scores, t):
        return all(t <= lo or ((scores >= lo) & (scores <= hi)).sum() >= k for lo, hi in open_ends)

    ids, scores = lowered(index, q, wanted, float(max(hi for _, hi in open_ends)), float(min(lo for lo, _ in open_ends)), full)
    for w, (lo, hi) in enumerate(ends):
        if lo <= hi:
            inside = np.flatnonzero((scores >= lo) & (scores <= hi))
            for at in inside[first(ids[inside], names, scores[inside], k)].tolist():
                yield w, ids[at], scores[at]


# --- Spark -----------------------------------------------------------------------

def scaled(vector_col: str | Column, scale: int = 256) -> Column:
    """floor(scale * component) as 64-bit integers, within 2^53."""
    v = F.col(vector_col) if isinstance(vector_col, str) else vector_col
    return F.transform(v, lambda c: F.greatest(F.lit(-_MOST), F.least(
        F.lit(_MOST), F.floor(F.lit(float(scale)) * c.cast("double")))).cast("long"))


def _blocks(n: int, block: int, least: int) -> int:
    return max(1, math.ceil(n / block), min(least, math.ceil(n / 1024)))


def _table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _matrix(column: pa.ChunkedArray, dim: int, exact: type) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(flat) if flat else np.zeros(0, np.int64)).reshape(-1, dim).astype(exact)


def _decimals(values) -> list[Decimal]:
    return [Decimal(int(v)) for v in values]


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    ``is_anchor`` is a condition on the columns of ``df``; ``label`` replaces
    the label column, both may refer to any of them."""
    spark = df.sparkSession
    prepare(spark)
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
                    & F.coalesce(fine, F.lit(False))) \
        .select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).alias("label"),
                scaled(vector_col, scale).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks")) \
        .where("label IS NOT NULL").groupBy("id", "label", "x").agg(F.max("asks").alias("asks"))
    # one number a label, and one a row; both are fixed once written
    rows = rows.select("id", F.xxhash64(F.col("label").cast("string")).alias("label"), "x", F.size("x").alias("dim"), "asks",
                       F.monotonically_increasing_id().alias("number"))
    rows = saved(rows, "mining_rows")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("anchors"), F.max("dim").alias("dim"),
                    F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("most")).first()
    exact = np.int64 if (seen.most or 0) ** 2 * (seen.dim or 0) < 1 << 62 else object
    # blocks are bounded; small tables are cut finer, to keep all cores at work
    of_rows = _blocks(seen.n, BLOCK_ROWS, spark.sparkContext.defaultParallelism)
    of_anchors = _blocks(seen.anchors, BLOCK_ANCHORS, 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    lists = rows.select("id", "label", "x", "dim", "number", deal(of_rows).alias("rb"), every(of_anchors).alias("ab"))
    keys = ["dim", "ab", "rb"]

    def join(anchors: DataFrame, each, result: str) -> DataFrame:
        """``each(index, names, labels, numbers, anchor table, dim)`` for every
        pair of blocks."""
        out = pa.schema([(c.split(" ")[0], {"long": pa.int64(), "int": pa.int32()}.get(c.split(" ")[1], pa.decimal128(38, 0)))
                         for c in result.split(", ")])

        def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
            dim = key[0].as_py()
            found = {f.name: [] for f in out}
            if asked.num_rows and held.num_rows:
                names, labels, numbers = (held.column(c).to_numpy() for c in ("id", "label", "number"))
                index = Index(_matrix(held.column("x"), dim, exact))
                for values in each(index, names, labels, numbers, asked, _matrix(asked.column("x"), dim, exact)):
                    for name, value in zip(found, values):
                        found[name].append(value)
            return _table(found, out)

        dealt = anchors.withColumn("ab", deal(of_anchors)).withColumn("rb", every(of_rows))
        return dealt.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInArrow(run, result)

    def find_positives(index, names, labels, numbers, asked, q):
        for at, (name, label, number) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("id", "label", "number")))):
            ids, scores = positives_of(index, names, labels, numbers, q[at], label, number, positives)
            for i, s in zip(ids.tolist(), _decimals(scores)):
                yield number, names[i], s

    def find_negatives(index, names, labels, numbers, asked, q):
        for at, (label, number, best) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("label", "number", "best")))):
            ends = [windows(int(b["score"]), low, high) for b in best]
            for w, i, s in negatives_of(index, names, labels, q[at], label, ends, negatives):
                yield number, w, names[i], Decimal(int(s))

    asking = rows.where("asks").select("id", "label", "x", "dim", "number")
    highest = Window.partitionBy("number").orderBy(F.col("score").desc(), "positive_id")
    best = join(asking, find_positives, "number long, positive_id long, score decimal(38,0)") \
        .withColumn("place", F.row_number().over(highest)).where(F.col("place") <= positives) \
        .groupBy("number").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("best"))
    anchors = saved(asking.join(best, "number"), "mining_anchors")
    found = join(anchors, find_negatives, "number long, place int, negative_id long, score decimal(38,0)")
    highest = Window.partitionBy("number", "place").orderBy(F.col("score").desc(), "negative_id")
    found = found.withColumn("rank", F.row_number().over(highest)).where(F.col("rank") <= negatives)
    chosen = F.element_at("best", F.col("place") + 1)
    return found.join(anchors.select("number", F.col("id").alias("anchor_id"), "best"), "number") \
        .select("anchor_id", chosen["positive_id"].alias("positive_id"), "rank", "negative_id",
                F.expr("try_cast(element_at(best, place + 1).score AS bigint)").alias("positive_score"),
                F.expr("try_cast(score AS bigint)").alias("negative_score"))
