"""Exact Shapley values of tree ensembles, cover-weighted.

A subset S of the features values a tree at a row as the mean of its leaves where
nodes on features of S send the row on and all others are averaged by the weight
of the training rows on either side. For one leaf this is a product over the
features of its path: one factor is whether the row passes the feature's nodes
(1 or 0), the other the share of training weight that does. A feature's Shapley
value over one leaf is therefore

    leaf * (passes - share) * sum_s s! (k - s - 1)! / k! * e_s

with e_s the coefficients of prod over the other features of (passes * t + share).
The sum is the integral over t from 0 to 1 of prod (passes * t + share * (1 - t)),
a polynomial, so Gauss-Legendre nodes give it exactly.

It depends on the row only by which features it passes. So the values of a whole
part of a tree are tabled by the features passed on the way to the part and the
sides taken at the part's nodes, at most 2^``BITS`` entries, and rows, many at a
time, look them up. Contributions and the ensemble's mean add up to its output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .treewalk import Nodes

ROWS = 1 << 16  # rows worked on at once
CELLS = 1 << 20  # of leaves' tables worked out at once
BITS = 11  # of a part's table
BATCH = 1 << 12  # rows of a batch of results


@dataclass
class Part:
    """The subtree of a node: ``path`` are the features on the way to it, ``inner``
    its nodes, ``leaves`` its leaves as (value, features and shares of the whole
    path, (place in ``inner``, is left) of the steps from the part's root)."""
    path: list[int]
    inner: list[int]
    leaves: list[tuple]


@dataclass
class Branch:
    """A node above the parts, or a part."""
    at: int
    part: Part | None = None
    left: "Branch | None" = None
    right: "Branch | None" = None


@dataclass
class Forest:
    nodes: Nodes
    trees: list[Branch] = field(default_factory=list)


def leaves_of(nodes: Nodes) -> tuple[Forest, float]:
    """The trees cut into parts, and the ensemble's mean."""
    def inner_of(at: int, most: int) -> list[int]:
        """The nodes of a subtree that are not leaves, or more than ``most`` of them."""
        found, waiting = [], [at]
        while waiting and len(found) <= most:
            n = waiting.pop()
            if not nodes.is_leaf(n):
                found.append(n)
                waiting += [nodes.right[n], nodes.left[n]]
        return found

    def part(at: int, path: dict, reach: float, inner: list[int]) -> Part:
        nonlocal mean
        place, leaves = {n: i for i, n in enumerate(inner)}, []
        waiting = [(at, path, reach, ())]
        while waiting:
            n, shares, reach, steps = waiting.pop()
            if nodes.is_leaf(n):
                mean += reach * nodes.value[n]
                leaves.append((nodes.value[n], list(shares), list(shares.values()), steps))
            else:
                for child, is_left, share in ends(n):
                    f = nodes.feature[n]
                    waiting.append((child, shares | {f: shares.get(f, 1.0) * share}, reach * share, (*steps, (place[n], is_left))))
        return Part(list(path), inner, leaves)

    def ends(n: int) -> list[tuple]:
        return [(c, is_left, nodes.cover[c] / nodes.cover[n] if nodes.cover[n] else 0.5)
                for c, is_left in ((nodes.left[n], True), (nodes.right[n], False))]

    def cut(at: int, path: dict, reach: float) -> Branch:
        inner = inner_of(at, BITS)
        if not inner or len(path) + len(inner) <= BITS:
            return Branch(at, part(at, path, reach, inner))
        f = nodes.feature[at]
        left, right = (cut(c, path | {f: path.get(f, 1.0) * share}, reach * share) for c, _, share in ends(at))
        return Branch(at, None, left, right)

    mean = 0.0
    found = Forest(nodes, [cut(root, {}, 1.0) for root in nodes.roots])
    return found, mean


def leaf_values(value: np.ndarray, share: np.ndarray, passes: np.ndarray) -> np.ndarray:
    """(leaves, patterns, k): the Shapley values over each leaf. value: (leaves);
    share: (leaves, k); passes: (patterns, k)."""
    k = share.shape[1]
    nodes, weights = np.polynomial.legendre.leggauss(max(1, (k + 1) // 2))
    p, z = passes[None], share[:, None]
    out = np.zeros((len(value), len(passes), k))
    for t, w in zip((nodes + 1) / 2, weights / 2):
        factor = p * t + z * (1 - t)
        before, after = np.ones_like(factor), np.ones_like(factor)
        for j in range(1, k):
            before[:, :, j] = before[:, :, j - 1] * factor[:, :, j - 1]
            after[:, :, k - 1 - j] = after[:, :, k - j] * factor[:, :, k - j]
        out += w * before * after
    return out * (p - z) * value[:, None, None]


def _bits(patterns: np.ndarray, k: int) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(k)) & 1).astype(float)


def _tables(branch: Branch) -> dict[int, np.ndarray]:
    """The values of a tree's leaves by pattern, a leaf by its id()."""
    by_k: dict[int, list] = {}
    waiting = [branch]
    while waiting:
        b = waiting.pop()
        if b.part is None:
            waiting += [b.left, b.right]
            continue
        for leaf in b.part.leaves:
            if 0 < len(leaf[1]) <= BITS:
                by_k.setdefault(len(leaf[1]), []).append(leaf)
    out = {}
    for k, leaves in by_k.items():
        passes, step = _bits(np.arange(1 << k), k), max(1, CELLS // (k << k))
        for at in range(0, len(leaves), step):
            some = leaves[at:at + step]
            values = leaf_values(np.array([v for v, *_ in some], float), np.array([s for _, _, s, _ in some], float), passes)
            out |= {id(leaf): one for leaf, one in zip(some, values)}
    return out


def _pattern(leaf: tuple, nodes: Nodes, part: Part, index: np.ndarray) -> np.ndarray:
    """Which of a leaf's features are passed, of indices into a part's table."""
    k, features = len(part.path), leaf[1]
    out = index & ((1 << k) - 1)
    for j in range(k, len(features)):
        out = out | (1 << j)
    for place, is_left in leaf[3]:
        bit = 1 << features.index(nodes.feature[part.inner[place]])
        left = (index >> (k + place)) & 1 == 1
        out = np.where(left == is_left, out, out & ~bit)
    return out


def contributions(x: np.ndarray, forest: Forest) -> np.ndarray:
    """(rows, features): the Shapley values of the rows of x (NaN is null)."""
    nodes, columns = forest.nodes, np.ascontiguousarray(x.T, float)
    missing = np.isnan(columns)
    some = missing.any(axis=1)
    out = np.zeros(columns.shape)

    def to_left(n: int) -> np.ndarray:
        f = nodes.feature[n]
        left = columns[f] <= nodes.threshold[n]
        return left | missing[f] if nodes.null_left[n] and some[f] else left

    def add(part: Part, pattern: np.ndarray, tables: dict) -> None:
        index = pattern
        for place, n in enumerate(part.inner):
            index = index | (to_left(n).astype(np.int64) << (len(part.path) + place))
        size = len(part.path) + len(part.inner)
        if size > BITS:  # one leaf far down: only the patterns that rows have
            seen, index = np.unique(index, return_inverse=True)
        else:
            seen = np.arange(1 << size)
        values: dict[int, np.ndarray] = {}
        for leaf in part.leaves:
            features = leaf[1]
            if not features:
                continue
            mine = _pattern(leaf, nodes, part, seen)
            one = tables[id(leaf)][mine] if id(leaf) in tables else \
                leaf_values(np.array([leaf[0]], float), np.array([leaf[2]], float), _bits(mine, len(features)))[0]
            for j, f in enumerate(features):
                values[f] = values[f] + one[:, j] if f in values else one[:, j]
        for f, v in values.items():
            out[f] += np.ascontiguousarray(v).take(index)

    for tree in forest.trees:
        tables = _tables(tree)
        waiting = [(tree, [], np.zeros(len(x), np.int64))]
        while waiting:
            branch, path, pattern = waiting.pop()
            if branch.part is not None:
                add(branch.part, pattern, tables)
                continue
            f, left = nodes.feature[branch.at], to_left(branch.at)
            for child, passed in ((branch.left, left), (branch.right, ~left)):
                if f in path:
                    waiting.append((child, path, np.where(passed, pattern, pattern & ~(1 << path.index(f)))))
                else:
                    waiting.append((child, [*path, f], pattern | (passed.astype(np.int64) << len(path))))
    return out.T


def shapley(df: DataFrame, nodes: Nodes, features: list[str], id_col: str = "id") -> DataFrame:
    """(id, feature, contribution, mean): one row for each row and feature."""
    ship_package(df.sparkSession)
    forest, mean = leaves_of(nodes)

    def explained(t: pa.Table) -> Iterator[pa.RecordBatch]:
        x = np.column_stack([t.column(i + 1).to_numpy().astype(float) for i in range(len(features))])
        values = contributions(x, forest)
        for at in range(0, len(x), BATCH):
            some = values[at:at + BATCH]
            ids = t.column(0).take(pa.array(np.repeat(np.arange(at, at + len(some)), len(features)))).combine_chunks()
            names = pa.DictionaryArray.from_arrays(np.tile(np.arange(len(features)), len(some)), features).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, names, pa.array(some.ravel()), pa.array(np.full(some.size, mean))],
                                             [id_col, "feature", "contribution", "mean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                yield from explained(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from explained(pa.Table.from_batches(held))

    rows = df.select(id_col, *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, feature string, "
                                "contribution double, mean double")
