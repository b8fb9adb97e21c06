"""Isolation forest on Spark (not part of Spark ML).

* Sample: every tree gets ``psi = min(max_samples, n)`` rows, dealt from the
  rows in the order of md5("id|round|seed"); a table with fewer than
  ``n_trees * psi`` rows is dealt in several rounds, each in an order of its
  own. The sample's size depends only on the parameters, never on the table.
* Fit: one tree per group (psi rows). A node takes a random feature among those
  that are not constant in it and a uniform split value between its least and
  greatest value; depth is limited to ceil(log2(psi)). The random numbers are
  digits of md5("tree|node|seed"), nodes numbered 1 for the root and 2k, 2k + 1
  for the children of k: the forest is a function of the rows and the seed, the
  same on any cluster and in any SQL engine.
* Score: a column expression (see ``treewalk``), batches of rows as arrays. A leaf's value
  is its depth plus c(its rows) in units of 1e-9, so path lengths add up as
  integers. score_samples = -2^(-E[path]/c(psi)); decision = score_samples -
  offset, where offset is the exact ``contamination`` quantile (linear
  interpolation) of the training scores, from the distributed order statistic.

Null and NaN features go to the right child when scored and take no part in a
node's least and greatest value; rows that hold one are not sampled.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .stats import order_statistics
from .treewalk import Nodes, leaf_sum

EULER_GAMMA = 0.5772156649015329
N_TREES = 200
MAX_SAMPLES = 256
CONTAMINATION = 0.05
SEED = 42
UNIT = 10 ** 9  # of path lengths

TREE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.ArrayType(T.LongType())),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("threshold", T.ArrayType(T.DoubleType())),
    T.StructField("size", T.ArrayType(T.IntegerType())),
])


def average_path_length(n: int) -> float:
    """c(n): mean path length of an unsuccessful search in a random binary
    search tree of n items (0 for n <= 1, 1 for n = 2)."""
    if n <= 2:
        return float(n == 2)
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def draws(tree: int, node: int, seed: int) -> tuple[float, float]:
    """Two numbers in [0, 1) for a node."""
    digits = hashlib.md5(f"{tree}|{node}|{seed}".encode()).hexdigest()
    return int(digits[:8], 16) / 2 ** 32, int(digits[8:16], 16) / 2 ** 32


def build_tree(x: np.ndarray, tree: int, seed: int, max_depth: int) -> dict[int, tuple[int, float, int]]:
    """node -> (feature, threshold, rows), feature -1 at a leaf."""
    found, waiting = {}, [(1, np.arange(len(x)), 0)]
    while waiting:
        node, rows, depth = waiting.pop()
        found[node] = (-1, 0.0, len(rows))
        if depth >= max_depth or len(rows) <= 1:
            continue
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if not len(usable):
            continue
        which, where = draws(tree, node, seed)
        f = int(usable[int(which * len(usable))])
        threshold = float(lo[f] + where * (hi[f] - lo[f]))
        found[node] = (f, threshold, len(rows))
        left = x[rows, f] <= threshold
        waiting += [(2 * node, rows[left], depth + 1), (2 * node + 1, rows[~left], depth + 1)]
    return found


@dataclass
class ForestModel:
    features: list[str]
    nodes: Nodes
    psi: int
    offset: float
    contamination: float = CONTAMINATION
    n_trees: int = field(default=0)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "ForestModel":
        doc = json.loads(text)
        return ForestModel(**(doc | {"nodes": Nodes(**doc["nodes"])}))

    def path_sum(self) -> Column:
        """Sum of the path lengths over all trees, in units of 1e-9."""
        return leaf_sum(self.nodes, self.features, "bigint")

    def score_of(self, path_sum: Column) -> Column:
        mean = path_sum.cast("double") / F.lit(float(self.n_trees)) / F.lit(float(UNIT))
        return -F.pow(F.lit(2.0), -mean / F.lit(average_path_length(self.psi) or 1.0))


def _flat(trees: list[dict[int, tuple[int, float, int]]], max_depth: int) -> Nodes:
    nodes = Nodes(depth=max_depth)
    for tree in trees:
        at = {}
        for name in sorted(tree):
            depth = name.bit_length() - 1
            at[name] = nodes.add_leaf(depth * UNIT + round(average_path_length(tree[name][2]) * UNIT))
        for name, (feature, threshold, _) in tree.items():
            if feature >= 0:
                nodes.set_split(at[name], feature, threshold, at[2 * name], at[2 * name + 1])
        nodes.roots.append(at[1])
    return nodes


def _sample(df: DataFrame, id_col: str, n_trees: int, psi: int, n: int, seed: int) -> DataFrame:
    """psi different rows for each tree. A round deals every row to at most
    one tree."""
    per_round = min(n_trees, max(1, n // psi))
    rounds = math.ceil(n_trees / per_round)
    need = per_round * psi
    # the least hashes: about the share of rows that a round needs, so that the
    # final sort gets little more than those
    share = min(1.0, (need + 8 * math.sqrt(need) + 100) / n)
    text = F.concat_ws("|", F.col("_id").cast("string"), F.col("_round").cast("string"), F.lit(str(seed)))
    keyed = df.select(F.col(id_col).alias("_id"), "*") \
        .withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_h", F.md5(text))
    if share < 1:
        keyed = keyed.where(F.substring("_h", 1, 8) <= F.lit(f"{int(share * 0xFFFFFFFF):08x}"))
    w = Window.partitionBy("_round").orderBy("_h", "_id")
    return keyed.withColumn("_rank", F.row_number().over(w) - 1).where(F.col("_rank") < need) \
        .withColumn("tree", (F.col("_round") * per_round + F.floor(F.col("_rank") / F.lit(psi))).cast("int")) \
        .where(F.col("tree") < n_trees)


def fit_forest(df: DataFrame, features: list[str], id_col: str = "id", n_trees: int = N_TREES,
               max_samples: int = MAX_SAMPLES, contamination: float = CONTAMINATION, seed: int = SEED) -> ForestModel:
    ship_package(df.sparkSession)
    rows = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features])
    whole = rows
    for f in features:
        whole = whole.where(F.col(f).isNotNull() & ~F.isnan(f))
    n = whole.count()
    if n == 0:
        raise ValueError("cannot fit an isolation forest on an empty table")
    psi = min(max_samples, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    sample = _sample(whole, id_col, n_trees, psi, n, seed)

    def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        tree = build_tree(pdf[features].to_numpy(dtype=float), t, seed, max_depth)
        feature, threshold, size = zip(*tree.values())
        return pd.DataFrame([{"tree": t, "node": list(tree), "feature": list(feature), "threshold": list(threshold),
                              "size": list(size)}])

    # One row per tree (n_trees rows, each at most 2 * psi nodes) reaches the
    # driver, to become constants of the scoring expression.
    got = sample.select("tree", *features).groupBy("tree").applyInPandas(fit_one, TREE_SCHEMA).collect()
    trees = [dict(zip(r.node, zip(r.feature, r.threshold, r["size"]))) for r in sorted(got, key=lambda r: r.tree)]
    model = ForestModel(list(features), _flat(trees, max_depth), psi, 0.0, contamination, len(trees))
    # The order statistic reads the path sums in three passes; they are worked
    # out once and kept for its duration.
    sums = rows.select(model.path_sum().alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
    place = F.lit(contamination) * (F.col("n") - 1)
    q = order_statistics(sums, "s", {"lo": F.floor(place), "hi": F.ceil(place)})
    q = q.select("n", model.score_of(F.col("lo")).alias("lo"), model.score_of(F.col("hi")).alias("hi")).first()
    sums.unpersist()
    p = contamination * (q["n"] - 1)
    model.offset = float(q["lo"] + (q["hi"] - q["lo"]) * (p - math.floor(p)))
    return model


def score(df: DataFrame, model: ForestModel, with_decision: bool = True) -> DataFrame:
    """Adds if_score_samples and, with the offset, if_score (decision value)
    and if_anomaly (decision < 0)."""
    out = df.withColumn("if_score_samples", model.score_of(model.path_sum()))
    if with_decision:
        out = out.withColumn("if_score", F.col("if_score_samples") - F.lit(model.offset)) \
            .withColumn("if_anomaly", F.col("if_score") < 0)
    return out
