"""Gradient boosted trees from first and second derivatives, over all rows.

Values are binned first: a value's bin is floor(bins * (rows below it) / rows),
so equal values share a bin and its edge is the greatest value in it. Rows of
equal bins differ in nothing that a tree can see; they are added up to one row
with the sums of their weights and weighted labels before anything else, which
bounds the rows by the bins, not by the table.

A round holds a margin for each of these rows, packed in blocks. For each level
of its tree every block adds its rows' gradients and Hessians up by (node,
feature, bin), Spark adds these sums up over the blocks, and the driver, which
sees at most nodes x features x bins sums, takes the split of greatest gain

    GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)

per node, nulls tried on both sides. Of two children only the lighter one is
summed, the other is the parent less its sibling. Gradients are rounded to a
power of two that keeps all sums whole numbers below 2^53, so neither the order
of addition nor the partitioning changes the model.

A level is a small job, and there are rounds x depth of them, one after another. So
the blocks are an RDD, whose jobs need no plan, that executors keep in memory (on
disk what does not fit); the first level of a round brings the margins up to date
and keeps them for the others. Every ``CUT`` rounds they go to the shared checkpoint
folder, so lineages stay short and an executor's loss costs a few passes. Of a table
of at most ``ALONE`` bytes, one task takes the levels itself: a job costs more than
its pass, as blocks go to Python for each. It adds up features of few bins together,
by their joint bins, and takes each one's sums from these. The trees are the same."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, pin, ship_package
from .prefix import running_sums
from .treewalk import Nodes, leaf_sum

BINS = 256
BLOCK = 65_536  # most rows of a block
TASK = 1 << 20  # most rows of a task
ALONE = 384 << 20  # most bytes of a table whose levels are no jobs, as its task keeps it
JOINT = 1024  # most joint bins of features added up together
CUT = 8  # rounds
# A level's sums come to the driver by task if all tasks' together stay within so
# many bytes by their parameters, and are added up by Spark otherwise. They are
# whole numbers: the sums are the same.
DRIVER_BYTES = 32 << 20
WEIGHT_UNIT, LABEL_UNIT = 1 << 20, 1 << 24
LEAST_GAIN = 1e-6


@dataclass
class Boosted:
    """``objective`` is 'logistic' or 'squared'; a margin is base plus the
    trees' leaves, a squared model's prediction centre + scale * margin."""
    features: list[str]
    objective: str
    base: float
    centre: float = 0.0
    scale: float = 1.0
    nodes: Nodes = field(default_factory=Nodes)
    gains: list[float] = field(default_factory=list)  # by feature

    def margin(self) -> Column:
        return F.lit(self.base) + leaf_sum(self.nodes, self.features)

    def score(self) -> Column:
        """Probability of label 1, or the predicted value."""
        if self.objective == "logistic":
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))
        return F.lit(self.centre) + F.lit(self.scale) * self.margin()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Boosted":
        doc = json.loads(text)
        return Boosted(**(doc | {"nodes": Nodes(**doc["nodes"])}))


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS, buckets: int | None = None, each: bool = False) -> DataFrame:
    """(feature, bin, edge, n): the bins of each feature, their greatest values
    and rows; nulls and NaN have no bin. With ``each`` a feature of at most ``bins``
    values has a bin for each, numbered by the rows below."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    long = df.select(F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    below = running_sums(counts, ["value"], {"below": F.col("n")}, by=["feature"], buckets=buckets, inclusive=False,
                         edge_source=long.select("value"), group_domains={"feature": len(features)})
    totals = counts.groupBy("feature").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"))
    bin_ = F.floor(F.col("below") * bins / F.col("rows"))
    if each:
        bin_ = F.when(F.col("values") <= bins, F.col("below")).otherwise(bin_)
    return below.join(F.broadcast(totals), "feature") \
        .groupBy("feature", bin_.alias("bin")) \
        .agg(F.max("value").alias("edge"), F.sum("n").alias("n"))


def _edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    found = bin_edges(df, features, bins).select("feature", "edge").toArrow()
    f, e = found.column("feature").to_numpy(), found.column("edge").to_numpy()
    return [np.sort(e[f == i]) for i in range(len(features))]


def summed_rows(df: DataFrame, features: list[str], label: str, weight: Column | None, edges: list[np.ndarray],
                centre: float, scale: float) -> DataFrame:
    """(bins, w, wy): rows of equal bins as one, weights and weighted labels as
    whole numbers of their units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(edges))])
            bins = np.empty(x.shape, "<u2")
            for i, e in enumerate(edges):
                at = np.searchsorted(e, x[:, i], "left")
                bins[:, i] = np.where(np.isnan(x[:, i]), len(e), np.minimum(at, max(len(e) - 1, 0)))
            y = (b.column(len(edges)).to_numpy(zero_copy_only=False) - centre) / scale
            w = b.column(len(edges) + 1).to_numpy(zero_copy_only=False)
            raw = np.ascontiguousarray(bins).view(f"V{2 * len(edges)}").ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(raw.tolist(), pa.binary()), pa.array(np.rint(w * WEIGHT_UNIT).astype(np.int64)),
                 pa.array(np.rint(w * y * LABEL_UNIT).astype(np.int64))], ["bins", "w", "wy"])

    rows = df.where(F.col(label).isNotNull()).select(
        *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("label"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"))
    return rows.mapInArrow(run, "bins binary, w long, wy long").groupBy("bins").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))


def _packed(rows: DataFrame, features: int, base: float) -> RDD:
    """Blocks of up to ``BLOCK`` rows: matrices (bins by feature) as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield block(held, n)
                held, n = [], 0
        if n:
            yield block(held, n)

    def block(held: list[pa.RecordBatch], n: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        w, wy = (t.column(c).to_numpy() / u for c, u in (("w", WEIGHT_UNIT), ("wy", LABEL_UNIT)))
        bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), "<u2").reshape(n, features).T
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.binary()) for v in (bins.tobytes(), w.tobytes(), wy.tobytes(), np.full(n, base).tobytes())],
            ["bins", "w", "wy", "margin"])

    return rows.mapInArrow(run, "bins binary, w binary, wy binary, margin binary").rdd.map(tuple)


def _kept(blocks: RDD, cut: bool) -> RDD:
    """Blocks that the next job keeps for those after it and, at a cut, writes
    to the shared checkpoint folder."""
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    if cut:
        blocks.checkpoint()
    return blocks


@dataclass
class Tree:
    """A tree over bins while it grows; a bin beyond a feature's last is null."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    null_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    level: list[int] = field(default_factory=lambda: [0])

    def split(self, at: int, feature: int, cut: int, null_left: bool) -> tuple[int, int]:
        ends = len(self.feature), len(self.feature) + 1
        self.feature[at], self.cut[at], self.null_left[at] = feature, cut, null_left
        self.left[at], self.right[at] = ends
        for _ in ends:
            for column, x in ((self.feature, -1), (self.cut, 0), (self.null_left, False), (self.left, -1), (self.right, -1),
                              (self.value, 0.0), (self.cover, 0.0), (self.level, self.level[at] + 1)):
                column.append(x)
        return ends

    def nodes_of(self, bins: np.ndarray, known: np.ndarray, node: np.ndarray | None = None, reached: int = 0) -> np.ndarray:
        """The node that each row has reached, from the root or from its ``node``
        when the tree had ``reached`` levels. bins: a row a feature; known: bins
        of each feature. A leaf leads to itself."""
        own, n = np.arange(len(self.feature)), bins.shape[1]
        feature, cut, null_left, left, right = (np.array(c) for c in (self.feature, self.cut, self.null_left, self.left, self.right))
        leaf = feature < 0
        ends = np.column_stack([np.where(leaf, own, right), np.where(leaf, own, left)]).ravel()
        feature = np.where(leaf, 0, feature)
        first, null, nulls = feature * n, known[feature], null_left.any()
        flat, rows, node = bins.ravel(), np.arange(n), np.zeros(n, np.int64) if node is None else node
        for _ in range(reached, max(self.level)):
            b = flat.take(first.take(node) + rows)
            to_left = b <= cut.take(node)  # a null's bin is beyond any cut
            if nulls:
                to_left |= null_left.take(node) & (b >= null.take(node))
            node = ends.take(2 * node + to_left)
        return node

    def values_of(self, bins: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(bins, known)]


def gradients(objective: str, margin: np.ndarray, w: np.ndarray, wy: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradients and Hessians of the rows, as whole numbers of 1/unit."""
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return np.rint((p * w - wy) * unit), np.rint(p * (1 - p) * w * unit)
    return np.rint((margin * w - wy) * unit), np.rint(w * unit)


def best_splits(g: np.ndarray, h: np.ndarray, known: np.ndarray, l2: float, least_weight: float) -> list:
    """(gain, feature, cut, null_left, left sums) of each node's best split, or
    None. g, h: (nodes, features, bins + 1), a feature's nulls at its last bin + 1."""
    g0, h0 = g[:, 0].sum(axis=1)[:, None, None, None], h[:, 0].sum(axis=1)[:, None, None, None]
    at = np.arange(g.shape[1])
    # sums of the left side by (node, feature, nulls left, cut); after the last
    # bin only nulls are left to part with
    a, b = (np.stack([(c := np.cumsum(x, axis=2)), c + x[:, at, known][:, :, None]], axis=2) for x in (g, h))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a * a / (b + l2) + (g0 - a) ** 2 / (h0 - b + l2) - g0 * g0 / (h0 + l2)
    cuts = np.arange(g.shape[2]) < known[:, None, None]
    gain[~((b >= least_weight) & (h0 - b >= least_weight) & (b > 0) & (h0 - b > 0) & cuts)] = -np.inf
    found = []
    for n, one in enumerate(gain):
        f, side, cut = (int(i) for i in np.unravel_index(one.argmax(), one.shape))
        found.append((float(one[f, side, cut]), f, cut, bool(side), (float(a[n, f, side, cut]), float(b[n, f, side, cut])))
                     if one[f, side, cut] > LEAST_GAIN else None)
    return found


def together(known: np.ndarray) -> list[list[int]]:
    """Features in groups of at most ``JOINT`` joint bins, or alone."""
    groups: list[list[int]] = []
    for f in np.argsort(known, kind="stable").tolist():
        if groups and np.prod(known[[*groups[-1], f]].astype(float) + 1) <= JOINT:
            groups[-1].append(f)
        else:
            groups.append([f])
    return groups


def joint(bins: np.ndarray, known: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The joint bin of each group of features, a row a group."""
    out = np.empty((len(groups), bins.shape[1]), "<u2")
    for code, group in zip(out, groups):
        code[:] = bins[group[0]]
        for f in group[1:]:
            code *= np.uint16(known[f] + 1)
            code += bins[f]
    return out


def node_sums(rows: Iterable[tuple], nodes: int, measured: list[int], known: np.ndarray, groups: list[list[int]]) -> Iterator[tuple]:
    """(node, sums): summed gradients and Hessians of the rows in the nodes
    ``measured`` as an array (2, features, bins + 1). rows: (``joint`` bins, node that
    each has reached, gradients, Hessians), by block."""
    features, width, n = len(known), int(known.max(initial=0)) + 1, len(measured)
    slot = np.full(nodes, -1)
    slot[measured] = np.arange(n)
    widths = [int(np.prod(known[g] + 1)) for g in groups]
    joined = [np.zeros((2, n * w)) for w in widths]
    for codes, at, *both in rows:
        at = slot[at]
        on = np.flatnonzero(at >= 0)
        if len(on) < len(at):
            at, codes, both = at[on], codes[:, on], [x[on] for x in both]
        for code, w, sums in zip(codes, widths, joined):
            pos = at * w + code
            for total, x in zip(sums, both):
                total += np.bincount(pos, x, n * w)
    out = np.zeros((2, features, n, width))
    for group, sums in zip(groups, joined):
        cube = sums.reshape(2, n, *(known[group] + 1))
        for i, f in enumerate(group):
            out[:, f, :, :known[f] + 1] = cube.sum(axis=tuple(2 + j for j in range(len(group)) if j != i))
    for k, node in enumerate(measured):
        yield node, out[:, :, k]


def level_sums(blocks: RDD, tree: Tree, measured: list[int], known: np.ndarray, objective: str, unit: float) -> RDD:
    """``node_sums`` of all blocks, by task."""
    def run(packed: Iterator[tuple]) -> Iterator[tuple]:
        rows = ((bins, tree.nodes_of(bins, known), *gradients(objective, margin, w, wy, unit))
                for bins, w, wy, margin in _matrices(packed, len(known)))
        return node_sums(rows, len(tree.feature), measured, known, [[f] for f in range(len(known))])

    return blocks.mapPartitions(run)


def _added(parts: RDD, pairs: int) -> RDD:
    """The sums by task added up."""
    return parts.reduceByKey(lambda a, b: a + b, max(1, min(pairs, parts.getNumPartitions())))


def _matrices(packed: Iterator[tuple], features: int) -> Iterator[tuple]:
    for bins, w, wy, margin in packed:
        yield np.frombuffer(bins, "<u2").reshape(features, -1), np.frombuffer(w), np.frombuffer(wy), np.frombuffer(margin)


def _advanced(blocks: RDD, tree: Tree, known: np.ndarray) -> RDD:
    """Blocks whose margins include the leaves of ``tree``."""
    def run(packed: Iterator[tuple]) -> Iterator[tuple]:
        for block in packed:
            for bins, _, _, margin in _matrices([block], len(known)):
                yield *block[:3], (margin + tree.values_of(bins, known)).tobytes()

    return blocks.mapPartitions(run)


def by_job(blocks: RDD, known: np.ndarray, objective: str, unit: float, tasks: int) -> Callable[[Tree, list[int]], Iterable[tuple]]:
    """The sums of a level, got by a job."""
    def level(tree: Tree, measured: list[int]) -> Iterable[tuple]:
        parts = level_sums(blocks, tree, measured, known, objective, unit)
        if tasks * len(measured) * len(known) * (int(known.max(initial=0)) + 1) * 16 > DRIVER_BYTES:
            parts = _added(parts, len(measured))
        return parts.collect()

    return level


def grow(level: Callable[[Tree, list[int]], Iterable[tuple]], known: np.ndarray, depth: int, rate: float, l2: float,
         least_weight: float, unit: float, gains: np.ndarray) -> Tree:
    """One tree; ``level`` gives (node, sums) of a tree's nodes to measure."""
    tree, features, width = Tree(), len(known), int(known.max(initial=0)) + 1
    sums: dict[int, np.ndarray] = {}
    measured, derived, frontier = [0], {}, [0]
    for _ in range(depth):
        sums = {n: sums[n] for n, _ in derived.values()} | {n: np.zeros((2, features, width)) for n in measured}
        for n, part in level(tree, measured):
            sums[n] += part / unit
        for n, (parent, sibling) in derived.items():
            sums[n] = sums[parent] - sums[sibling]
        splits = best_splits(*np.stack([sums[n] for n in frontier], axis=1), known, l2, least_weight)
        measured, derived, following = [], {}, []
        for n, found in zip(frontier, splits):
            if found is None:
                continue
            g, h = sums[n]
            gain, feature, cut, null_left, (gl, hl) = found
            g0, h0 = float(g[0].sum()), float(h[0].sum())
            tree.cover[n] = h0
            gains[feature] += gain
            ends = tree.split(n, feature, cut, null_left)
            for end, (a, c) in zip(ends, ((gl, hl), (g0 - gl, h0 - hl))):
                tree.value[end], tree.cover[end] = -rate * a / (c + l2), c
            light, heavy = ends if hl <= h0 - hl else ends[::-1]
            measured.append(light)
            derived[heavy] = (n, light)
            following += ends
        frontier = following
        if not frontier:
            break
    if len(tree.feature) == 1:
        g, h = (float(x[0].sum()) for x in sums[0])
        tree.value[0], tree.cover[0] = -rate * g / (h + l2) if h + l2 else 0.0, h
    return tree


def grown_alone(s: "Start", objective: str, rounds: int, depth: int, rate: float, l2: float,
                least_weight: float) -> tuple[list[Tree], np.ndarray]:
    """All trees and the features' gains, by the one task that holds all blocks.
    It keeps each row's node and derivatives through the levels of a tree."""
    known, unit = s.known, s.unit

    def run(packed: Iterator[tuple]) -> Iterator[tuple]:
        held, trees, gains = [(*m[:3], m[3].copy()) for m in _matrices(packed, len(known))], [], np.zeros(len(known))
        groups = together(known)
        codes = [joint(bins, known, groups) for bins, *_ in held]
        for _ in range(rounds):
            kept = [[bins, np.zeros(len(w), np.int16), *gradients(objective, margin, w, wy, unit)] for bins, w, wy, margin in held]
            reached = 0

            def to_ends(tree: Tree) -> None:
                nonlocal reached
                for rows in kept:
                    rows[1] = tree.nodes_of(rows[0], known, rows[1], reached).astype(np.int16 if len(tree.feature) < 1 << 15 else np.int64)
                reached = max(tree.level)

            def level(tree: Tree, measured: list[int]) -> Iterator[tuple]:
                to_ends(tree)
                return node_sums(((c, *rows[1:]) for c, rows in zip(codes, kept)), len(tree.feature), measured, known, groups)

            trees.append(grow(level, known, depth, rate, l2, least_weight, unit, gains))
            to_ends(trees[-1])
            for (*_, margin), (_, node, *_) in zip(held, kept):
                margin += np.array(trees[-1].value)[node]
        yield trees, gains

    return s.blocks.mapPartitions(run).first()


def _append(nodes: Nodes, tree: Tree, edges: list[np.ndarray], depth: int) -> None:
    first = len(nodes.feature)
    for v, c in zip(tree.value, tree.cover):
        nodes.add_leaf(v, c)
    for at, f in enumerate(tree.feature):
        if f >= 0:
            nodes.set_split(first + at, f, float(edges[f][tree.cut[at]]), first + tree.left[at], first + tree.right[at],
                            bool(tree.null_left[at]))
    nodes.roots.append(first)
    nodes.depth = max(nodes.depth, depth)


@dataclass
class Start:
    """A table ready for its first tree."""
    edges: list[np.ndarray]
    known: np.ndarray
    blocks: RDD
    tasks: int
    unit: float
    base: float
    centre: float
    scale: float


def start(df: DataFrame, features: list[str], label: str, objective: str, positive_weight: float, bins: int) -> Start:
    ship_package(df.sparkSession)
    if objective not in ("logistic", "squared"):
        raise ValueError(f"unknown objective {objective}")
    y = F.col(label).cast("double")
    weight = F.when(y == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0)) if objective == "logistic" else None
    centre, scale = 0.0, 1.0
    if objective == "squared":
        ends = df.agg(F.avg(y.cast("decimal(38,6)")).cast("double").alias("m"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        if ends.m is not None:
            centre = ends.m
            scale = max(abs(ends.lo - centre), abs(ends.hi - centre)) or 1.0
    edges = _edges(df.where(y.isNotNull()), features, bins)
    rows = pin(summed_rows(df, features, label, weight, edges, centre, scale))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum("wy").alias("wy")).first()
    if not total.n:
        raise ValueError("no labelled rows")
    w, wy = total.w / WEIGHT_UNIT, total.wy / LABEL_UNIT
    # sums stay whole numbers below 2^53; gradients of 'squared' are at most 2 a row
    unit = 2.0 ** min(24, 51 - math.ceil(math.log2(max(w, 1.0))))
    base = -(0.5 * w - wy) / (0.25 * w) if objective == "logistic" else 0.0
    # bins, joint bins, weights, labels, margins, derivatives and nodes
    tasks = 1 if total.n * (4 * len(features) + 42) <= ALONE else \
        max(1, math.ceil(total.n / TASK), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total.n / BLOCK)))
    ensure_checkpoint_dir(df.sparkSession)
    blocks = _kept(_packed(rows.repartition(tasks), len(features), base), True)
    return Start(edges, np.array([len(e) for e in edges]), blocks, tasks, unit, base, centre, scale)


def root_sums(df: DataFrame, features: list[str], label: str, objective: str = "logistic", positive_weight: float = 1.0,
              bins: int = BINS) -> DataFrame:
    """(feature, bin, edge, g, h): what the first split is chosen from. Nulls are
    the bin after a feature's last, without an edge."""
    s = start(df, features, label, objective, positive_weight, bins)
    sums = _added(level_sums(s.blocks, Tree(), [0], s.known, objective, s.unit), 1).flatMap(
        lambda part: [(int(f), int(b), float(part[1][0, f, b]), float(part[1][1, f, b])) for f, b in zip(*np.nonzero(part[1][1]))]) \
        .toDF("feature int, bin int, g double, h double")
    edges = F.array(*[F.array(*[F.lit(float(v)) for v in e]).cast("array<double>") for e in s.edges])
    return sums.select(F.get(F.array(*[F.lit(f) for f in features]), F.col("feature")).alias("feature"),
                       F.col("bin").cast("long").alias("bin"), F.get(F.get(edges, F.col("feature")), F.col("bin")).alias("edge"),
                       (F.col("g") / s.unit).alias("g"), (F.col("h") / s.unit).alias("h"))


def fit(df: DataFrame, features: list[str], label: str, objective: str = "logistic", rounds: int = 200, depth: int = 6,
        rate: float = 0.1, l2: float | None = None, least_weight: float = 1.0, positive_weight: float = 1.0,
        bins: int = BINS) -> Boosted:
    """A model of all rows with a label. ``least_weight`` is the Hessian that a
    child needs; ``l2`` defaults to 1 for 'logistic' and to 0 for 'squared', where
    leaves are then plain means of residuals. The margin starts at the Newton step
    from zero; 'squared' labels are centred and scaled to at most 1."""
    l2 = (1.0 if objective == "logistic" else 0.0) if l2 is None else l2
    s = start(df, features, label, objective, positive_weight, bins)
    model, gains = Boosted(list(features), objective, s.base, s.centre, s.scale), np.zeros(len(features))
    blocks, former = s.blocks, None
    if s.tasks == 1:
        trees, gains = grown_alone(s, objective, rounds, depth, rate, l2, least_weight)
        for tree in trees:
            _append(model.nodes, tree, s.edges, depth)
    for k in range(rounds if s.tasks > 1 else 0):
        tree = grow(by_job(blocks, s.known, objective, s.unit, s.tasks), s.known, depth, rate, l2, least_weight, s.unit, gains)
        _append(model.nodes, tree, s.edges, depth)
        if former is not None:
            former.unpersist()
        former = blocks
        if k + 1 < rounds:
            blocks = _kept(_advanced(blocks, tree, s.known), (k + 1) % CUT == 0)
    blocks.unpersist()
    share = gains / gains.sum() if gains.sum() else gains
    model.gains = share.tolist()
    return model
