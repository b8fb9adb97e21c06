"""Boosted trees equal a plain program over all rows; nulls, ties, partitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblog_engine.operators import boost

FEATS = ["a", "b", "c"]


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randrange(6), rng.choice([None, 0.5, 1.5, 2.5]), round(rng.gauss(0, 1), 2)
        y = int((a > 3) != (b is None) or c > 1)
        out.append((i, float(a), b, c if i % 9 else float("nan"), y, 3 * a - (b or 5) + c))
    return out


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, "id long, a double, b double, c double, y int, v double").repartition(parts)


def plain(data, label, objective, rounds, depth, rate, l2, bins, positive_weight=1.0, centre=0.0, scale=1.0):
    """Every rule of the operator, row by row."""
    cols = [[r[k + 1] for r in data] for k in range(len(FEATS))]
    fine = lambda v: v is not None and v == v
    edges, binned = [], []
    for col in cols:
        known = sorted(v for v in col if fine(v))
        of = {v: bins * sum(x < v for x in known) // len(known) for v in set(known)}
        top = {}
        for v, b in of.items():
            top[b] = max(top.get(b, v), v)
        edges.append([top[b] for b in sorted(top)])
        binned.append([next(k for k, e in enumerate(edges[-1]) if v <= e) if fine(v) else None for v in col])
    groups = {}
    for i, r in enumerate(data):
        w = positive_weight if objective == "logistic" and r[label] == 1 else 1.0
        key = tuple(b[i] for b in binned)
        got = groups.setdefault(key, [0, 0])
        got[0] += round(w * boost.WEIGHT_UNIT)
        got[1] += round(w * (r[label] - centre) / scale * boost.LABEL_UNIT)
    keys = list(groups)
    w = [groups[k][0] / boost.WEIGHT_UNIT for k in keys]
    wy = [groups[k][1] / boost.LABEL_UNIT for k in keys]
    unit = 2.0 ** min(24, 51 - math.ceil(math.log2(sum(w))))
    base = -(0.5 * sum(w) - sum(wy)) / (0.25 * sum(w)) if objective == "logistic" else 0.0
    margin, trees = [base] * len(keys), []
    for _ in range(rounds):
        if objective == "logistic":
            p = [1 / (1 + math.exp(-m)) for m in margin]
            g = [round((q * a - b) * unit) / unit for q, a, b in zip(p, w, wy)]
            h = [round(q * (1 - q) * a * unit) / unit for q, a in zip(p, w)]
        else:
            g = [round((m * a - b) * unit) / unit for m, a, b in zip(margin, w, wy)]
            h = [round(a * unit) / unit for a in w]

        def grow(members, level):
            g0, h0 = sum(g[i] for i in members), sum(h[i] for i in members)
            leaf = -rate * g0 / (h0 + l2)
            best = None
            if level < depth:
                for f in range(len(FEATS)):
                    for null_left in (False, True):
                        for cut in range(len(edges[f])):
                            left = [i for i in members if (null_left if keys[i][f] is None else keys[i][f] <= cut)]
                            gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                            if hl < 1 or h0 - hl < 1:
                                continue
                            gain = gl * gl / (hl + l2) + (g0 - gl) ** 2 / (h0 - hl + l2) - g0 * g0 / (h0 + l2)
                            if gain > (best[0] if best else boost.LEAST_GAIN):
                                best = (gain, f, cut, null_left, left)
            if best is None:
                for i in members:
                    margin[i] += leaf
                return leaf
            _, f, cut, null_left, left = best
            right = [i for i in members if i not in set(left)]
            return (f, edges[f][cut], null_left, grow(left, level + 1), grow(right, level + 1))

        trees.append(grow(list(range(len(keys))), 0))
    return trees


def shape(nodes, at):
    if nodes.is_leaf(at):
        return nodes.value[at]
    return (nodes.feature[at], nodes.threshold[at], nodes.null_left[at], shape(nodes, nodes.left[at]), shape(nodes, nodes.right[at]))


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:3] == b[:3] and same(a[3], b[3]) and same(a[4], b[4])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and abs(a - b) < 1e-9


@pytest.mark.parametrize("objective", ["logistic", "squared"])
def test_equals_a_plain_program(spark, objective, monkeypatch):
    monkeypatch.setattr(boost, "BLOCK", 40)
    monkeypatch.setattr(boost, "CUT", 2)
    data = rows(150, 4)
    label = "y" if objective == "logistic" else "v"
    got = boost.fit(frame(spark, data), FEATS, label, objective, rounds=3, depth=3, bins=16, positive_weight=5.0)
    want = plain(data, 4 if objective == "logistic" else 5, objective, 3, 3, 0.1, 1.0 if objective == "logistic" else 0.0, 16,
                 5.0, got.centre, got.scale)
    assert len(want) == 3 and all(same(shape(got.nodes, r), t) for r, t in zip(got.nodes.roots, want))
    assert abs(sum(got.gains) - 1) < 1e-9
    # the score is the walk of these trees, nulls and NaN included
    again = boost.Boosted.from_json(got.to_json())

    def walk(t, x):
        while isinstance(t, tuple):
            v = x[t[0]]
            t = t[3] if (t[2] if v is None or v != v else v <= t[1]) else t[4]
        return t

    for r in frame(spark, data).select("a", "b", "c", again.score().alias("s")).collect():
        m = got.base + sum(walk(t, (r.a, r.b, r.c)) for t in want)
        assert abs(r.s - (1 / (1 + math.exp(-m)) if objective == "logistic" else got.centre + got.scale * m)) < 1e-9


def test_partitions_change_nothing(spark, monkeypatch):
    data = rows(200, 5)
    models = [boost.fit(frame(spark, data, n), FEATS, "y", rounds=2, depth=4, bins=32).to_json() for n in (1, 7)]
    monkeypatch.setattr(boost, "DRIVER_BYTES", 0)  # sums added up by Spark
    models.append(boost.fit(frame(spark, data, 3), FEATS, "y", rounds=2, depth=4, bins=32).to_json())
    assert models[0] == models[1] == models[2]


def test_levels_are_jobs_without_a_plan(spark, monkeypatch):
    kind = type(spark.range(1))
    plans, to_arrow = [], kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: plans.append(self) or to_arrow(self))
    monkeypatch.setattr(boost, "CUT", 2)
    m = boost.fit(frame(spark, rows(150, 4)), FEATS, "y", rounds=5, depth=3, bins=16)
    assert len(m.nodes.roots) == 5 and len(plans) == 1  # the edges


@pytest.mark.parametrize("objective, label", [("logistic", "y"), ("squared", "v")])
def test_one_task_takes_all_levels_of_a_small_table(spark, monkeypatch, objective, label):
    levels, level_sums = [], boost.level_sums
    monkeypatch.setattr(boost, "level_sums", lambda *a: levels.append(a) or level_sums(*a))
    data = rows(200, 5)
    fit = lambda: boost.fit(frame(spark, data), FEATS, label, objective, rounds=5, depth=4, bins=32).to_json()
    alone = fit()
    assert not levels  # no job a level
    monkeypatch.setattr(boost, "ALONE", 0)
    monkeypatch.setattr(boost, "BLOCK", 40)
    monkeypatch.setattr(boost, "CUT", 2)
    assert fit() == alone and len(levels) >= 5
    monkeypatch.setattr(boost, "DRIVER_BYTES", 0)  # sums added up by Spark
    assert fit() == alone


def test_one_task_takes_all_blocks(spark, monkeypatch):
    data = rows(200, 5)
    one = boost.fit(frame(spark, data), FEATS, "y", rounds=2, depth=4, bins=32).to_json()
    monkeypatch.setattr(boost, "BLOCK", 7)
    assert boost.fit(frame(spark, data), FEATS, "y", rounds=2, depth=4, bins=32).to_json() == one


def test_odd_tables(spark):
    data = [(i, None, None, None, i % 2, 1.0) for i in range(10)]
    m = boost.fit(frame(spark, data), FEATS, "y", rounds=2)
    assert [r.s for r in frame(spark, data).select(m.score().alias("s")).collect()] == [0.5] * 10
    flat = boost.fit(frame(spark, rows(30, 6)).withColumn("v", F.lit(2.0)), FEATS, "v", "squared", rounds=2)
    assert {r.s for r in frame(spark, data).select(flat.score().alias("s")).collect()} == {2.0}
    with pytest.raises(ValueError):
        boost.fit(frame(spark, data).where("id < 0"), FEATS, "y")


def test_one_task_keeps_nodes_and_derivatives(spark, monkeypatch):
    """Derivatives are taken once a round, and a level's walk is one step."""
    x = np.random.default_rng(1)
    bins = x.integers(0, 16, (3, 500)).astype("<u2")
    w = np.ones(500)
    y = x.integers(0, 2, 500) * 1.0
    block = tuple(a.tobytes() for a in (bins, w, y, np.zeros(500)))

    class Blocks:
        def mapPartitions(self, run):
            self.out = run(iter([block]))
            return self

        def first(self):
            return next(self.out)

    known = np.array([16, 16, 16])
    taken, gradients, walked, nodes_of = [], boost.gradients, [], boost.Tree.nodes_of
    monkeypatch.setattr(boost, "gradients", lambda *a: taken.append(1) or gradients(*a))

    def walk(tree, bins, known, node=None, reached=0):
        walked.append(max(tree.level) - reached)
        return nodes_of(tree, bins, known, node, reached)

    monkeypatch.setattr(boost.Tree, "nodes_of", walk)
    s = boost.Start([], known, Blocks(), 1, 2.0 ** 20, 0.0, 0.0, 1.0)
    trees, _ = boost.grown_alone(s, "logistic", 4, 4, 0.1, 1.0, 1.0)
    assert len(taken) == 4 and max(walked) == 1
    assert sum(walked) == sum(max(t.level) for t in trees)


def test_joint_bins_give_each_features_sums(monkeypatch):
    """Features added up together or alone, nulls among them: the same sums."""
    rng = np.random.default_rng(2)
    known, n = np.array([2, 40, 3, 2, 200, 7]), 5000
    bins = np.array([rng.integers(0, k + 1, n) for k in known], "<u2")
    node, g, h = rng.integers(0, 6, n), rng.integers(-99, 99, n).astype(float), rng.integers(0, 9, n).astype(float)
    alone = dict(boost.node_sums([(bins, node, g, h)], 6, [1, 4, 5], known, [[f] for f in range(6)]))
    groups = boost.together(known)
    assert len(groups) == 3 and sorted(sum(groups, [])) == list(range(6))
    joint = dict(boost.node_sums([(boost.joint(bins, known, groups), node, g, h)], 6, [1, 4, 5], known, groups))
    assert all(np.array_equal(alone[k], joint[k]) for k in (1, 4, 5))
    assert alone[4][0, 2, 3] == g[(node == 4) & (bins[2] == 3)].sum()
