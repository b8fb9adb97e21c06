"""Walks of tree ensembles over columns, against a walk row by row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weblog_engine.operators import treewalk
from weblog_engine.operators.treewalk import Nodes

NAMES = ["a", "b"]


def grown(rng: random.Random, depth: int, kind: str, null_left: bool) -> Nodes:
    nodes = Nodes(depth=depth)

    def grow(at: int, left: int) -> None:
        if left and rng.random() < 0.8:
            ends = [nodes.add_leaf(value()), nodes.add_leaf(value())]
            nodes.set_split(at, rng.randrange(2), rng.choice([-1.5, 0.0, 2.0, 7.25]), *ends, null_left and rng.random() < 0.5)
            for end in ends:
                grow(end, left - 1)

    def value():
        return rng.randrange(10 ** 12) if kind == "bigint" else rng.random()

    for _ in range(7):
        nodes.roots.append(nodes.add_leaf(value()))
        grow(nodes.roots[-1], depth)
    return nodes


def walked(nodes: Nodes, row: list) -> float:
    total = 0
    for at in nodes.roots:
        while not nodes.is_leaf(at):
            v = row[nodes.feature[at]]
            left = nodes.null_left[at] if v is None or math.isnan(v) else v <= nodes.threshold[at]
            at = nodes.left[at] if left else nodes.right[at]
        total += nodes.value[at]
    return total


@pytest.mark.parametrize("kind,null_left", [("bigint", False), ("double", False), ("double", True)])
def test_walk_matches_row_by_row(spark, kind, null_left):
    values = [None, float("nan"), float("-inf"), float("inf"), -1.5, 0.0, -0.0, 1.0, 2.0, 7.25, 9.0]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in values for b in values)]
    df = spark.createDataFrame(rows, "id int, a double, b double").repartition(3)
    nodes = grown(random.Random(5), 4, kind, null_left)
    got = {r.id: r.s for r in df.select("id", treewalk.leaf_sum(nodes, NAMES, kind).alias("s")).collect()}
    assert got == {i: walked(nodes, [a, b]) for i, a, b in rows}


def test_rows_are_walked_once_under_a_filter(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    nodes = grown(random.Random(6), 4, "double", False)
    x = df.withColumn("s", treewalk.leaf_sum(nodes, NAMES)).where(F.col("s") > 1).select("id", "s")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    assert "aggregate(" not in plan  # a fold of functions runs uncompiled: thousands of calls a row


def test_no_trees(spark):
    assert [r[0] for r in spark.range(2).select(treewalk.leaf_sum(Nodes(), [], "bigint")).collect()] == [0, 0]


def test_sum_in_a_thread(spark):
    """Candidates are fitted and scored from driver threads."""
    from concurrent.futures import ThreadPoolExecutor
    nodes = grown(random.Random(7), 3, "double", False)
    df = spark.range(3).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    with ThreadPoolExecutor(1) as pool:
        got = pool.submit(lambda: [r.s for r in df.select(treewalk.leaf_sum(nodes, NAMES).alias("s")).collect()]).result()
    assert got == [walked(nodes, [float(i), 1.0]) for i in range(3)]
