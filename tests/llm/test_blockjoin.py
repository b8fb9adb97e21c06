"""The block join equals a full product."""

import numpy as np

from weblog_engine.llm import blockjoin


def brute(rows, k, q_ids):
    clean = {(i, tuple(v)) for i, v in rows
             if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, q in sorted(clean):
        if i in q_ids:
            x = [(-float(np.dot(np.array(q, float), np.array(v, float))), j) for j, v in clean
                 if (j, v) != (i, q) and len(v) == len(q)]
            out += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(sorted(x)[:k])]
    return sorted(out)


def test_equals_full_product(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 24)).round(2).astype(np.float32)
    v[50:120] = v[50]
    v[130] *= 1000
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(500, None), (520, [0.0] * 24), (540, [float("nan")] * 24), (560, [None] * 24), (None, rows[0][1]),
             (0, rows[0][1]), (0, rows[0][1]), (0, rows[7][1]), (33, rows[8][1]), (600, []), (620, [1.0, 2.0]), (640, [2.0, 1.0])]
    df = spark.createDataFrame([(i, x, "q", 1) for i, x in rows], "vec_id long, embedding array<float>, dim string, cb int")
    monkeypatch.setattr(blockjoin, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(blockjoin, "BLOCK_CANDIDATES", 100)
    monkeypatch.setattr(blockjoin, "TILE", 32)
    got = blockjoin.nearest(df.where("vec_id % 20 = 0"), df).collect()
    back = [(i, [None if x is None else float(np.float32(x)) for x in r] if r is not None else r) for i, r in rows]
    want = brute(back, 20, range(0, 700, 20))
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == want
    assert blockjoin.nearest(df.limit(0), df).count() == 0
    assert blockjoin.nearest(df, df.limit(0)).count() == 0


def test_products_beyond_the_range_of_doubles(spark):
    rows = [(0, [1e160, 1.0]), (1, [2e160, 0.0]), (2, [1e170, 1.0]), (3, [1.0, 3.0]), (4, [-1e165, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = blockjoin.nearest(df.where("vec_id = 0"), df, k=3).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, np.inf), (2, np.inf), (3, 1e160)]
