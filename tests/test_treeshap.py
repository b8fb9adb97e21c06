"""Shapley values equal the sum over all subsets."""

import itertools
import math
import random

from weblog_engine.operators import boost, treeshap
from weblog_engine.operators.treewalk import Nodes

from test_boost import FEATS, frame, rows


def value(nodes, at, x, known):
    """The tree at x where only the features in ``known`` are looked at."""
    if nodes.is_leaf(at):
        return nodes.value[at]
    f, left, right = nodes.feature[at], nodes.left[at], nodes.right[at]
    if f in known:
        to_left = nodes.null_left[at] if x[f] is None or x[f] != x[f] else x[f] <= nodes.threshold[at]
        return value(nodes, left if to_left else right, x, known)
    return sum(nodes.cover[c] / nodes.cover[at] * value(nodes, c, x, known) for c in (left, right))


def brute(nodes, x, features):
    total = lambda known: sum(value(nodes, r, x, known) for r in nodes.roots)
    out = []
    for i in range(features):
        rest = [j for j in range(features) if j != i]
        out.append(sum(math.factorial(n) * math.factorial(features - n - 1) / math.factorial(features)
                       * (total({*s, i}) - total(set(s))) for n in range(features) for s in itertools.combinations(rest, n)))
    return out, total(set())


def test_equals_all_subsets(spark, monkeypatch):
    monkeypatch.setattr(treeshap, "CELLS", 64)
    data = rows(150, 4)
    m = boost.fit(frame(spark, data), FEATS, "y", rounds=3, depth=4, bins=16)
    got = {(r.id, r.feature): r for r in treeshap.shapley(frame(spark, data[:20]), m.nodes, FEATS).collect()}
    out = {r.id: r.m for r in frame(spark, data[:20]).select("id", (m.margin() - m.base).alias("m")).collect()}
    assert len(got) == 60
    for r in data[:20]:
        want, mean = brute(m.nodes, r[1:4], 3)
        assert all(abs(got[r[0], f].contribution - w) < 1e-9 for f, w in zip(FEATS, want))
        assert abs(got[r[0], "a"].mean - mean) < 1e-9
        assert abs(mean + sum(want) - out[r[0]]) < 1e-9


def test_one_leaf(spark):
    nodes = Nodes()
    nodes.roots.append(nodes.add_leaf(2.0, 5.0))
    got = treeshap.shapley(frame(spark, rows(5, 1)), nodes, FEATS).collect()
    assert {(r.contribution, r.mean) for r in got} == {(0.0, 2.0)}


def test_deep_random_trees():
    rng = random.Random(8)
    nodes = Nodes(depth=6)

    def grow(level, cover):
        at = nodes.add_leaf(rng.gauss(0, 1), cover)
        if level < 6 and cover > 2:
            part = rng.randrange(1, int(cover))
            nodes.set_split(at, rng.randrange(5), rng.random(), grow(level + 1, part), grow(level + 1, cover - part), rng.random() < 0.5)
        return at

    nodes.roots += [grow(0, 500), grow(0, 100)]
    leaves, mean = treeshap.leaves_of(nodes)
    import numpy as np
    for _ in range(10):
        x = [rng.choice([None, rng.random()]) for _ in range(5)]
        want, base = brute(nodes, x, 5)
        got = treeshap.contributions(np.array([[np.nan if v is None else v for v in x]]), leaves)[0]
        assert np.allclose(got, want) and abs(mean - base) < 1e-9


def test_models_of_every_kind(spark, sf_dir):
    """Mean and contributions add up to the output of the model."""
    from pyspark.sql import functions as F

    from weblog_engine.operators import explain, features, split, train
    from weblog_engine.sources.tables import weblogs
    f = split.split(features.engineer_features(weblogs(spark, sf_dir)), by="is_error").persist()
    tr, te = f.where("split = 'train'"), f.where("split = 'test'")
    feats = features.CLASSIFICATION_FEATURES
    log_odds = lambda p: math.log(p / (1 - p))
    for k, c in enumerate(train.classifier_candidates(5, 2, n_weighted_rows=800.0)):
        t, _ = train.fit_classifiers(tr, te, feats, "is_error", [c], concurrent=False)
        out = {r.id: r.score for r in train.positive_score(t.model.transform(f)).select("id", "score").collect()}
        got = explain.exact(t, f, n_rows=6).groupBy("id").agg(F.sum("contribution").alias("s"), F.first("mean").alias("m")).collect()
        assert len(got) == 6
        for r in got:
            want = out[r.id] if c.name == "random_forest" else log_odds(out[r.id])
            assert abs(r.s + r.m - want) < 1e-8, c.name
    for c in train.regressor_candidates(5, 2)[::2]:
        t, _ = train.fit_regressors(tr, te, feats, "response_time_ms", [c], concurrent=False)
        out = {r.id: r.prediction for r in t.model.transform(f).select("id", "prediction").collect()}
        got = explain.exact(t, f, n_rows=6).groupBy("id").agg(F.sum("contribution").alias("s"), F.first("mean").alias("m")).collect()
        assert all(abs(r.s + r.m - out[r.id]) < 1e-6 * max(1, abs(out[r.id])) for r in got), c.name


def test_parts_of_any_size(monkeypatch):
    """Tables of whole trees, of leaves alone, and none for long paths: the same values."""
    import numpy as np
    rng, nodes = random.Random(3), Nodes(depth=5)

    def grow(level, cover):
        at = nodes.add_leaf(rng.gauss(0, 1), cover)
        if level < 5 and cover > 2:
            part = rng.randrange(1, int(cover))
            nodes.set_split(at, rng.randrange(6), rng.random(), grow(level + 1, part), grow(level + 1, cover - part), rng.random() < 0.5)
        return at

    nodes.roots += [grow(0, 1000) for _ in range(3)]
    x = np.array([[np.nan if rng.random() < 0.1 else rng.random() for _ in range(6)] for _ in range(200)])
    got = []
    for bits in (16, 11, 2):
        monkeypatch.setattr(treeshap, "BITS", bits)
        forest, _ = treeshap.leaves_of(nodes)
        got.append(treeshap.contributions(x, forest))
    assert np.allclose(got[0], got[1]) and np.allclose(got[0], got[2])
