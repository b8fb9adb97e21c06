"""Random forests over all rows, a task growing whole trees.

Values are binned as for boosting (a feature of few values keeps each of them) and
rows go, as blocks of bins, labels and weights, to every task that grows trees: no
sums of nodes travel, which is what takes the time of a forest grown by levels over
a divided table. A task sorts its rows by their bins and labels, so neither the
partitioning nor the order of the rows changes the trees.

A tree's bootstrap gives each row a Poisson(1) weight times its own; rows of equal
bins, which no split tells apart, are then added up. A node takes the best cut of a
random subset of the features by the drop of the label's weighted variance; with
labels 0 and 1 that is half the drop of Gini impurity. Nulls lie above all values.
A leaf's value is its rows' weighted mean label, a forest's the mean over its trees.

A task holds the whole table, so this is for tables of at most ``TABLE_BYTES``."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .boost import bin_edges
from .split import SEED
from .treewalk import Nodes, leaf_sum

BINS = 32
BLOCK = 16_384  # rows of a block
TABLE_BYTES = 400 << 20  # of a task's rows as they are kept
LEAST_DROP = 1e-12  # of a split, as a share of the labels' sum of squares


@dataclass
class Forest:
    """``objective`` is 'share' (of label 1) or 'mean'."""
    features: list[str]
    objective: str
    nodes: Nodes = field(default_factory=Nodes)
    gains: list[float] = field(default_factory=list)  # by feature

    def score(self) -> Column:
        total = leaf_sum(self.nodes, self.features)
        return F.least(total, F.lit(1.0)) if self.objective == "share" else total

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Forest":
        doc = json.loads(text)
        return Forest(**(doc | {"nodes": Nodes(**doc["nodes"])}))


def fits(rows: int, features: int) -> bool:
    """bins, label, weight, place of the cell and a tree's weights of each row"""
    return rows * (features + 40) <= TABLE_BYTES


def _edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    found = bin_edges(df, features, bins, each=True).select("feature", "edge").toArrow()
    f, e = found.column("feature").to_numpy(), found.column("edge").to_numpy()
    return [np.sort(e[f == i]) for i in range(len(features))]


def packed(df: DataFrame, features: list[str], label: str, weight: str | None, edges: list[np.ndarray]) -> RDD:
    """Blocks (bins, labels, weights) as bytes; the bin after a feature's last is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                c = [x.to_numpy(zero_copy_only=False).astype(float) for x in whole.slice(at, BLOCK).columns]
                bins = np.empty((len(edges), len(c[0])), np.uint8)
                for i, e in enumerate(edges):
                    bins[i] = np.where(np.isnan(c[i]), len(e), np.minimum(np.searchsorted(e, c[i], "left"), max(len(e) - 1, 0)))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, c[-2], c[-1])], ["bins", "y", "w"])

    rows = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"),
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).where(F.col("y").isNotNull() & (F.col("w") > 0))
    return rows.mapInArrow(run, "bins binary, y binary, w binary").rdd.map(tuple)


@dataclass
class Table:
    """A task's rows, those of equal bins one after another from ``starts``; bins:
    a row a feature, a column a cell of equal bins."""
    bins: np.ndarray
    starts: np.ndarray
    y: np.ndarray
    w: np.ndarray
    known: np.ndarray


def table_of(blocks: list[tuple], known: np.ndarray) -> Table:
    bins = np.concatenate([np.frombuffer(b, np.uint8).reshape(len(known), -1) for b, *_ in blocks], axis=1)
    y, w = (np.concatenate([np.frombuffer(b[i]) for b in blocks]) for i in (1, 2))
    # as few whole numbers as hold the bins of a row
    keys, room = [np.zeros(len(y), np.int64)], 1
    for b, width in zip(bins, known + 1):
        if room * int(width) >= 1 << 62:
            keys, room = [*keys, np.zeros(len(y), np.int64)], 1
        keys[-1] = keys[-1] * int(width) + b
        room *= int(width)
    order = np.lexsort((w, y, *keys))
    new = np.zeros(len(y), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return Table(np.ascontiguousarray(bins[:, order[starts]]), starts, y[order], w[order], known)


def grow(t: Table, depth: int, chosen: int, seed: int, number: int) -> dict:
    """A tree as columns by node, level after level; a leaf's feature is -1."""
    rng = np.random.default_rng([seed, number])
    features, width = len(t.known), int(t.known.max(initial=0)) + 1
    drawn = rng.poisson(1.0, len(t.y)) * t.w
    weight, total = np.add.reduceat(drawn, t.starts), np.add.reduceat(drawn * t.y, t.starts)
    least = LEAST_DROP * float((drawn * t.y * t.y).sum())
    on = np.flatnonzero(weight > 0)
    weight, total, flat, cells = weight[on], total[on], t.bins[:, on].ravel(), len(on)
    tiny = 0.5 * float(t.w.min())
    rows, at = np.arange(cells), np.zeros(cells, np.int64)
    found: list[dict] = []
    size, first = 1, 0  # nodes of the level, and nodes before it
    for level in range(depth + 1):
        a, s = np.bincount(at, weight, size), np.bincount(at, total, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            here = {"feature": np.full(size, -1), "cut": np.zeros(size, np.int64), "left": first + np.arange(size),
                    "right": first + np.arange(size), "value": np.where(a > 0, s / a, 0.0), "cover": a, "gain": np.zeros(size)}
        found.append(here)
        if level == depth or not len(rows):
            break
        best, feature, cut = np.full(size, -np.inf), np.zeros(size, np.int64), np.zeros(size, np.int64)
        subset, own = np.argsort(rng.random((size, features)), axis=1)[:, :chosen], np.arange(size)
        for f in subset.T:
            place = at * width + flat.take((f * cells).take(at) + rows)
            la, ls = (np.bincount(place, x, size * width).reshape(size, width).cumsum(axis=1)[:, :-1] for x in (weight, total))
            ra, rs = a[:, None] - la, s[:, None] - ls
            with np.errstate(divide="ignore", invalid="ignore"):
                drop = ls * ls / la + rs * rs / ra - (s * s / a)[:, None]
            drop[(la < tiny) | (ra < tiny) | (np.arange(width - 1) >= t.known[f][:, None] - 1)] = -np.inf
            if not drop.shape[1]:
                continue
            c = drop.argmax(axis=1)
            better = drop[own, c] > best
            best, feature, cut = np.where(better, drop[own, c], best), np.where(better, f, feature), np.where(better, c, cut)
        split = best > least
        rank, following = np.cumsum(split) - 1, first + size
        for column, x in (("feature", feature), ("cut", cut), ("gain", best), ("left", following + 2 * rank), ("right", following + 2 * rank + 1)):
            here[column] = np.where(split, x, here[column])
        kept = split.take(at)
        rows, at, weight, total = rows[kept], at[kept], weight[kept], total[kept]
        to_right = flat.take((feature * cells).take(at) + rows) > cut.take(at)
        at = 2 * rank.take(at) + to_right
        first, size = following, 2 * int(split.sum())
        if not size:
            break
    return {k: np.concatenate([x[k] for x in found]) for k in found[0]}


def _flat(trees: list[dict], edges: list[np.ndarray], depth: int) -> tuple[Nodes, list[float]]:
    """All trees as one table, leaves over the number of trees, and the features'
    shares of the drops, each tree counting alike."""
    nodes, gains, first = Nodes(depth=depth), np.zeros(len(edges)), 0
    thresholds = np.zeros((len(edges), max((len(e) for e in edges), default=0) or 1))
    for i, e in enumerate(edges):
        thresholds[i, :len(e)] = e
    for t in trees:
        inner = t["feature"] >= 0
        f = np.where(inner, t["feature"], 0)
        nodes.feature += f.tolist()
        nodes.threshold += np.where(inner, thresholds[f, t["cut"]], 0.0).tolist()
        nodes.left += (first + t["left"]).tolist()
        nodes.right += (first + t["right"]).tolist()
        nodes.null_left += [False] * len(f)
        nodes.value += (t["value"] / len(trees)).tolist()
        nodes.cover += t["cover"].tolist()
        nodes.roots.append(first)
        first += len(f)
        drops = np.bincount(f[inner], t["gain"][inner], len(edges))
        gains += drops / drops.sum() if drops.sum() else 0.0
    return nodes, (gains / gains.sum() if gains.sum() else gains).tolist()


def fit(df: DataFrame, features: list[str], label: str, objective: str, trees: int, depth: int, weight: str | None = None,
        seed: int = SEED, bins: int = BINS) -> Forest:
    """A forest of all rows with a label. A node looks at the root of the number of
    features ('share') or at a third of them ('mean'), at all in a single tree."""
    ship_package(df.sparkSession)
    edges = _edges(df.where(F.col(label).isNotNull()), features, bins)
    known = np.array([len(e) for e in edges])
    chosen = len(features) if trees == 1 else math.ceil(math.sqrt(len(features)) if objective == "share" else len(features) / 3)
    sc = df.sparkSession.sparkContext
    tasks = max(1, min(trees, 2 * sc.defaultParallelism))

    def grown(blocks: Iterator[tuple]) -> Iterator[tuple]:
        held, numbers = [], range(0)
        for k, block in blocks:
            held.append(block)
            numbers = range(k, trees, tasks)
        if held:
            t = table_of(held, known)
            held.clear()
            centre = float(t.y.mean()) if objective == "mean" else 0.0
            t.y = t.y - centre
            for number in numbers:
                tree = grow(t, depth, chosen, seed, number)
                tree["value"] = tree["value"] + centre
                yield number, tree

    rows = packed(df, features, label, weight, edges)
    found = dict(rows.flatMap(lambda b: [(k, b) for k in range(tasks)]).partitionBy(tasks, int).mapPartitions(grown).collect())
    if not found:
        raise ValueError("no labelled rows")
    return Forest(list(features), objective, *_flat([found[k] for k in range(trees)], edges, depth))
