"""Mined negatives equal a full scan; odd rows; thresholds lose nothing."""

import math

import numpy as np
from pyspark.sql import functions as F

from weblog_engine.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, number string, best int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA)


def run(df):
    return hardneg.mine(df, F.col("vec_id") % 50 == 0,
                        label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def brute(rows):
    clean = set()
    for i, v, label in rows:
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v):
            x = tuple(max(-2 ** 53, min(2 ** 53, math.floor(256 * float(np.float32(c))))) for c in v)
            clean.add((i, (label + 1) % 10 if i % 7 == 0 else label, x))
    out = []
    for a in clean:
        if a[0] % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[2], r[2])), r[0], r[1]) for r in clean if r != a and len(r[2]) == len(a[2]))
        for s, p, _ in [r for r in scored if r[2] == a[1]][:5]:
            inside = [r for r in scored if r[2] != a[1] and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


def mined(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
                  for r in run(df).collect())


def clusters(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims)) * 0.1
    label = rng.integers(0, 10, n)
    v = centres[label] + rng.normal(size=(n, dims)) * 0.08 * np.linspace(1.5, 0.1, dims)
    return [(int(i), [float(c) for c in v[i]], int(label[i])) for i in range(n)]


def test_equals_full_scan(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 150)
    rows = clusters(600, 20, 2)
    rows += [(700 + i, rows[50][1], 3) for i in range(250)]  # one vector held by a third of the rows
    want = brute(rows)
    assert len(want) > 60 and mined(frame(spark, rows)) == want


def test_index_finds_all_that_reach(spark):
    rng = np.random.default_rng(4)
    rows = rng.integers(-90, 90, size=(500, 21)) * (rng.random(21) < 0.8)
    index = hardneg.Index(rows)
    for q in rows[:20]:
        v, rest = index.anchor(q)
        scores = rows @ q
        wanted = rng.random(500) < 0.5
        for t in (-1e9, 0, np.quantile(scores, 0.5), np.quantile(scores, 0.97), scores.max(), scores.max() + 1):
            ids, got = index.reaching(q, v, rest, wanted, t)
            assert ids.tolist() == np.flatnonzero(wanted & (scores >= t)).tolist() and (got == scores[ids]).all()


def test_odd_rows(spark):
    rows = clusters(200, 6, 3)
    rows += [(None, rows[0][1], 1), (250, None, 1), (300, [], 2), (350, rows[0][1], None), (400, [1.0, None], 1),
             (450, [float("nan")] * 6, 1), (500, [float("-inf")] * 6, 1), (0, rows[0][1], rows[0][2]), (50, rows[1][1], 4),
             (550, [1.0, 2.0], 1), (551, [2.0, 1.0], 1), (552, [1.0, 1.0], 2), (600, [0.0] * 6, 5), (601, [0.0] * 6, 5)]
    assert mined(frame(spark, rows)) == brute(rows)
    assert run(frame(spark, rows).limit(0)).count() == 0
    assert run(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)])).count() == 0  # no positive
    huge = [(50, [1e30, 1.0], 1), (51, [1e30, 2.0], 1), (52, [2.5e13, 1.0], 2), (53, [3e13, 0.0], 2)]
    got = run(frame(spark, huge)).collect()
    want = brute(huge)
    fits = lambda s: s if abs(s) < 2 ** 63 else None
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) \
        == [(*w[:4], fits(w[4]), fits(w[5])) for w in want] and want
