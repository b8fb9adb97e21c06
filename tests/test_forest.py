"""Forests grown by trees: cuts against all cuts, any partitioning, nulls, fallback."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblog_engine.operators import explain, forest, train
from weblog_engine.operators.native import NativeModel
from weblog_engine.session import scratch_path

FEATS = ["a", "b", "c"]


def frame(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *map(float, range(40))]), rng.randrange(3), round(rng.random(), 2), 0.0) for i in range(n)]
    rows = [(*r[:4], 3.0 * (r[1] or 0) + 20 * (r[2] == 1) + rng.random()) for r in rows]
    return spark.createDataFrame(rows, "id long, a double, b int, c double, y double").withColumn("slow", (F.col("y") > 60).cast("int"))


def table(n, seed=3):
    rng = np.random.default_rng(seed)
    known = np.array([5, 3, 8])
    bins = np.array([rng.integers(0, k + (k == 8), n) for k in known], np.uint8)  # the last feature has nulls
    y, w = rng.normal(size=n) + bins[0] * (bins[1] == 1), rng.choice([0.5, 2.0], n)
    return forest.table_of([(bins[:, :n // 2].tobytes(), y[:n // 2].tobytes(), w[:n // 2].tobytes()),
                            (bins[:, n // 2:].tobytes(), y[n // 2:].tobytes(), w[n // 2:].tobytes())], known)


def test_cuts_are_the_best_of_all():
    t = table(300)
    x = np.repeat(t.bins, np.diff([*t.starts, len(t.y)]), axis=1)  # bins by row
    got = forest.grow(t, 3, 3, 9, 4)
    drawn = np.random.default_rng([9, 4]).poisson(1.0, len(t.y)) * t.w

    def spread(on):
        return 0.0 if not drawn[on].sum() else float((drawn * t.y * t.y)[on].sum() - (drawn * t.y)[on].sum() ** 2 / drawn[on].sum())

    def check(at, on):
        assert abs(got["cover"][at] - drawn[on].sum()) < 1e-9
        assert abs(got["value"][at] - (drawn * t.y)[on].sum() / drawn[on].sum()) < 1e-9
        if got["feature"][at] < 0:
            return 0
        left = x[got["feature"][at]] <= got["cut"][at]
        mine = spread(on) - spread(on & left) - spread(on & ~left)
        every = [spread(on) - spread(on & (x[f] <= c)) - spread(on & (x[f] > c)) for f in range(3) for c in range(t.known[f] - 1)
                 if drawn[on & (x[f] <= c)].sum() and drawn[on & (x[f] > c)].sum()]
        assert abs(mine - max(every)) < 1e-6 and abs(mine - got["gain"][at]) < 1e-6
        return 1 + check(got["left"][at], on & left) + check(got["right"][at], on & ~left)

    assert check(0, np.ones(len(t.y), bool)) >= 4


def test_any_order_and_partitioning(spark):
    df = frame(spark, 500)
    one, other = (forest.fit(x, FEATS, "y", "mean", 5, 4).to_json() for x in (df.coalesce(1), df.orderBy(F.desc("id")).repartition(5)))
    assert one == other
    assert len(set(forest.Forest.from_json(one).nodes.threshold)) > 5


def test_learns_saves_and_adds_up(spark):
    """Both kinds predict, keep their scores when reloaded, and are explained."""
    df = frame(spark, 800)
    tr, te = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    clf, table = train.fit_classifiers(tr, te, FEATS, "slow", [train.classifier_candidates(20, 2, n_weighted_rows=640.0, by_trees=True)[1]])
    assert isinstance(clf.model, NativeModel) and clf.model.kind == "forest" and table.first().roc_auc > 0.95
    reg, table = train.fit_regressors(tr, te, FEATS, "y", [train.regressor_candidates(20, 2, by_trees=True)[1]])
    assert reg.model.kind == "forest" and table.first().r2 > 0.6
    assert abs(sum(reg.model.importances()) - 1) < 1e-9 and train.feature_importance(reg).first().feature == "a"
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    train.save_model(clf, path)
    scores = [{r.id: r.score for r in m.model.transform(te).collect()} for m in (clf, train.load_model(path))]
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores[0].values())
    parts = explain.exact(clf, te).groupBy("id").agg((F.sum("contribution") + F.first("mean")).alias("s")).collect()
    assert len(parts) == 160 and all(abs(r.s - scores[0][r.id]) < 1e-9 for r in parts)


def test_each_of_few_values_has_a_bin(spark):
    """Also a value rarer than a bin's share of the rows."""
    df = spark.range(2000).select((F.col("id") == 7).cast("double").alias("a"), (F.col("id") % 100).cast("double").alias("b"))
    edges = forest._edges(df, ["a", "b"], 32)
    assert edges[0].tolist() == [0.0, 1.0] and len(edges[1]) == 32


def test_large_tables_are_grown_by_levels(spark, monkeypatch):
    df = frame(spark, 100).withColumn("label", F.col("y"))
    c = train.regressor_candidates(3, 2, by_trees=True)[1]
    assert isinstance(train._fitted(c, df, FEATS), NativeModel)
    monkeypatch.setattr(forest, "TABLE_BYTES", 0)
    assert not isinstance(train._fitted(c, df.na.fill(0.0), FEATS), NativeModel)


def test_no_labelled_rows(spark):
    with pytest.raises(ValueError):
        forest.fit(frame(spark, 10).withColumn("y", F.lit(None).cast("double")), FEATS, "y", "mean", 2, 2)
