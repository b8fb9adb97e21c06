"""Whitening equals a dense eigen decomposition; odd rows."""

import numpy as np

from weblog_engine.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 7) for i, v in rows], SCHEMA)


def brute(rows, want=4):
    ids, x = zip(*[(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows])
    u = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(u), u.sum(axis=0)
    a = u.astype(float) - np.array([float(t) / n for t in s])
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1][:want], q[:, ::-1][:, :want]
    x = np.array(x, dtype=object)
    dev = ((x * n - s) ** 2).sum(axis=1)
    w = (x.astype(float) - np.array([float(t) / n for t in s])) @ q / np.sqrt(e)
    return ids, n, dev, w, e / (a * a).sum() * n


def compare(got, rows, want=4):
    ids, n, dev, w, share = brute(rows, want)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) * want
    for k in range(want):
        mine = np.array([by[i, k + 1].whitened for i in ids])
        sign = np.sign(mine @ w[:, k])
        assert np.allclose(mine * sign, w[:, k], atol=1e-8), k
    for i, d in zip(ids, dev):
        r = by[i, 1]
        assert r.deviation == d and r.n == n and r.identity_error < 1e-8
        assert abs(r.explained - share[0]) < 1e-9 * share[0]


def test_equals_dense_decomposition(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 12)) * np.linspace(1, 0.9, 12)  # values close together
    v[40:140] = v[40]  # one vector held by a third of the rows
    rows = [(int(i), [float(c) for c in r]) for i, r in enumerate(v)]
    compare(whiten.whiten(frame(spark, rows)).collect(), rows)


def test_settles_before_the_space_is_used_up(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 30)) * (0.5 ** np.arange(30))
    rows = [(int(i), [float(c) for c in r * 40]) for i, r in enumerate(v)]
    compare(whiten.whiten(frame(spark, rows)).collect(), rows)


def test_repeated_values_are_all_found(spark):
    rows, k = [], 0
    for j in range(20):  # a multiple of the unit matrix in the first five dimensions
        for sign in (1, -1):
            v = [0.0] * 20
            v[j] = sign * (4.0 if j < 5 else 1.0)
            rows.append((k, v))
            k += 1
    got = whiten.whiten(frame(spark, rows)).collect()
    assert len(got) == 160
    assert {round(r.explained, 9) for r in got} == {round(16 / (5 * 16 + 15), 9)}
    assert got[0].identity_error < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    flat = [(int(i), [float(c) for c in r]) for i, r in enumerate(rng.normal(size=(50, 3)))]
    rows = flat + [(None, flat[0][1]), (3, flat[4][1]), (60, None), (61, []), (62, [1.0, None, 2.0]),
                   (63, [float("nan"), 0.0, 0.0]), (64, [float("inf"), 0.0, 0.0]), (65, [1.0, 2.0])]
    got = whiten.whiten(frame(spark, rows)).collect()
    assert len(got) == 52 * 3 and sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 3 for r in got) == 6
    assert {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {50}
    assert whiten.whiten(frame(spark, flat).limit(0)).count() == 0
    assert whiten.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # a plane in three dimensions has two components
    plane = [(i, [float(i % 7), float(i % 5), float(i % 7) + float(i % 5)]) for i in range(35)]
    assert {r.component for r in whiten.whiten(frame(spark, plane)).collect()} == {1, 2}
    # sums beyond 64 bits, entries beyond 64 bits
    huge = [(i, [1e30 * (i % 2), 3e12 * i, float(i)]) for i in range(6)]
    big = whiten.whiten(frame(spark, huge)).collect()
    assert {r.vec_id for r in big} == set(range(6)) and all(r.deviation is None for r in big)
