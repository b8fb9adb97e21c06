"""Few-valued drift tests against plain formulas."""

import math
import random

from pyspark.sql import functions as F

from weblog_engine.operators import drift, features, fewvalued
from weblog_engine.sources.tables import weblogs


def upper_gamma(a, x, steps=200_000):
    """Q(a, x) by the trapezoid rule on t = x + u/(1-u)."""
    total, h = 0.0, 1 / steps
    for k in range(steps):
        u = (k + 0.5) * h
        t = x + u / (1 - u)
        total += math.exp((a - 1) * math.log(t) - t - math.lgamma(a)) / (1 - u) ** 2
    return total * h


def test_special_functions(spark):
    zs = [0.0, 0.1, 0.7, 1.3, 2.49, 2.5, 2.6, 4.0, 9.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", fewvalued.erfc(F.col("z")).alias("v")).collect()
    assert all(abs(r.v - math.erfc(r.z)) < 1e-14 + 1e-12 * math.erfc(r.z) for r in got)
    cases = [(x, df) for x in (0.3, 2.0, 11.0, 40.0) for df in (1, 2, 3, 4, 7, 10)]
    got = spark.createDataFrame(cases, "x double, df long").select("x", "df", fewvalued.chi_square_sf(F.col("x"), F.col("df")).alias("p")).collect()
    for r in got:
        assert abs(r.p - upper_gamma(r.df / 2, r.x / 2)) < 1e-6, r
    edge = spark.createDataFrame([(0.0, 3), (5.0, 0), (2000.0, 2), (float("inf"), 3)], "x double, df long")
    assert [r.p for r in edge.select(fewvalued.chi_square_sf(F.col("x"), F.col("df")).alias("p")).coalesce(1).collect()][:3] == [1.0, 1.0, 0.0]


def frame(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None, b) for v, b in values], "a double, b int")


def test_scores(spark):
    rng = random.Random(2)
    ref = [(rng.choice([1, 1, 2, 3, None]), rng.randrange(2)) for _ in range(400)]
    cur = [(rng.choice([1, 2, 3, 3]), int(rng.random() < 0.7)) for _ in range(300)]
    got = {r.column: r for r in fewvalued.few_valued_tests(frame(spark, ref), frame(spark, cur), ["a", "b"]).collect()}
    for k, name in enumerate("ab"):
        x, y = [r[k] for r in ref if r[k] is not None], [r[k] for r in cur]
        values = sorted(set(x) | set(y))
        p, q = [x.count(v) / len(x) for v in values], [y.count(v) / len(y) for v in values]
        chi = sum((y.count(v) - a * len(y)) ** 2 / (a * len(y)) for v, a in zip(values, p))
        js = math.sqrt(sum(s * math.log(s / ((a + b) / 2)) for a, b in zip(p, q) for s in (a, b) if s) / 2)
        r = got[name]
        assert r.n_values == len(values) and abs(r.chi_square - chi) < 1e-9 and abs(r.js_distance - js) < 1e-12
        assert abs(r.chi_square_p - upper_gamma((len(values) - 1) / 2, chi / 2)) < 1e-6 and r.drift_detected
    r = got["b"]
    pool = (sum(x[1] for x in ref) + sum(x[1] for x in cur)) / 700
    z = (sum(x[1] for x in ref) / 400 - sum(x[1] for x in cur) / 300) / math.sqrt(pool * (1 - pool) * (1 / 400 + 1 / 300))
    assert abs(r.z - z) < 1e-9 and abs(r.z_p - math.erfc(abs(z) / math.sqrt(2))) < 1e-12 and r.stattest_name == "z"
    assert got["a"].z is None and got["a"].stattest_name == "chisquare"


def test_odd_columns(spark):
    ref = frame(spark, [(1, 0)] * 20)
    same = {r.column: r for r in fewvalued.few_valued_tests(ref, ref, ["a", "b"]).collect()}
    assert same["a"].chi_square_p == 1.0 and same["a"].js_distance == 0.0 and not same["a"].drift_detected
    new = fewvalued.few_valued_tests(ref, frame(spark, [(2, 0)] * 20), ["a"]).first()
    assert new.chi_square == math.inf and abs(new.js_distance - math.sqrt(math.log(2))) < 1e-12
    none = fewvalued.few_valued_tests(ref, frame(spark, [(None, 0)] * 5), ["a"]).first()
    assert none.drift_score is None and none.n_cur == 0


def test_gate_retrains(spark, sf_dir, tmp_path):
    """On drift the gate runs the training job, and its run is on record."""
    from weblog_engine.operators import training_job
    logs = weblogs(spark, sf_dir)
    ref = features.row_features(logs)
    drift.save_snapshot(ref, str(tmp_path / "ref"))
    moved = ref.select(*[(F.lit(7) if c in ("hour", "day_of_week", "is_business_hours", "is_error") else
                          F.col(c) * 9 + 1 if c in ("response_time_ms", "bytes_sent") else F.col(c)).alias(c) for c in ref.columns])
    runs = []
    job = lambda: runs.append(training_job.train_all(logs, str(tmp_path / "models"), 2, 2, 2))
    snapshot = drift.load_snapshot(spark, str(tmp_path / "ref"))
    calm = drift.drift_gate(drift.current_window(ref), snapshot, job).first()
    assert not runs and (calm.drift_detected, calm.action) == (False, "none")
    told = drift.drift_gate(drift.current_window(moved), snapshot, job).first()
    assert len(runs) == 1 and (told.drift_detected, told.action) == (True, "retrained")
    assert spark.read.parquet(str(tmp_path / "models" / "training_runs")).first().status == "success"
