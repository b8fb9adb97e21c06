"""Sums over the leaves that a row reaches in an ensemble of binary trees, as a
column expression whose plan does not depend on the number of trees.

An ensemble is one flat table of nodes. A node sends a row to ``left`` when its
feature's value is at most ``threshold``, to ``right`` otherwise, and a null or
NaN to the side of ``null_left``; a leaf points to itself, so that walking on from
it changes nothing. The rows of an Arrow batch walk a tree together, a level at a
time, on arrays of nodes and values; the tables go to the tasks with the function."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package


@dataclass
class Nodes:
    """Flat nodes of all trees; ``roots`` are the first nodes of the trees,
    ``depth`` is the longest walk and ``cover`` the weight of the training rows
    that reached each node (where it is known)."""
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    null_left: list[bool] = field(default_factory=list)
    value: list = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    depth: int = 0
    cover: list[float] = field(default_factory=list)

    def add_leaf(self, value, cover: float = 0.0) -> int:
        at = len(self.feature)
        for column, x in ((self.feature, 0), (self.threshold, 0.0), (self.left, at), (self.right, at),
                          (self.null_left, False), (self.value, value), (self.cover, cover)):
            column.append(x)
        return at

    def set_split(self, at: int, feature: int, threshold: float, left: int, right: int, null_left: bool = False) -> None:
        self.feature[at], self.threshold[at], self.null_left[at] = feature, threshold, null_left
        self.left[at], self.right[at] = left, right

    def is_leaf(self, at: int) -> bool:
        return self.left[at] == at


class Walker:
    """The nodes as arrays; ``sums`` walks the columns of a batch of rows."""

    def __init__(self, nodes: Nodes, dtype: type):
        self.feature, self.threshold = np.array(nodes.feature, np.intp), np.array(nodes.threshold, np.float64)
        # the two ends of node k: right at 2k, left at 2k + 1
        self.ends = np.column_stack([nodes.right, nodes.left]).astype(np.intp).ravel()
        self.null_left = np.array(nodes.null_left, bool) if any(nodes.null_left) else None
        self.value = np.array(nodes.value, dtype)
        self.roots, self.depth = nodes.roots, nodes.depth

    def sums(self, columns: list[np.ndarray]) -> np.ndarray:
        """The sum over the trees, added in their order. Null is NaN, which is
        at most nothing, so it goes right unless told otherwise."""
        n = len(columns[0])
        x, rows = np.concatenate(columns), np.arange(n)
        first = self.feature * n  # of the node's feature in x
        missing = np.isnan(x) if self.null_left is not None else None
        if missing is not None and not missing.any():
            missing = None
        total = np.zeros(n, self.value.dtype)
        for root in self.roots:
            node = np.full(n, root, np.intp)
            for _ in range(self.depth):
                at = first.take(node) + rows
                to_left = x.take(at) <= self.threshold.take(node)
                if missing is not None:
                    to_left |= missing.take(at) & self.null_left.take(node)
                node = self.ends.take(2 * node + to_left)
            total += self.value.take(node)
        return total


def leaf_sum(nodes: Nodes, features: list[str | Column], kind: str = "double") -> Column:
    """Sum over all trees of the value of the leaf that the row reaches.
    ``kind`` is the type of the values; integers are added exactly."""
    if not nodes.roots:
        return F.lit(0).cast(kind)
    ship_package(SparkSession.builder.getOrCreate())  # a thread of a training job has no active session
    walker = Walker(nodes, np.float64 if kind == "double" else np.int64)

    @F.pandas_udf(kind)
    def walk(*columns: pd.Series) -> pd.Series:
        return pd.Series(walker.sums([c.to_numpy(np.float64) for c in columns]))

    # so that a filter on the sum is not pushed below it, which would walk every row twice
    walk = walk.asNondeterministic()
    return walk(*[(F.col(f) if isinstance(f, str) else f).cast("double") for f in features])
