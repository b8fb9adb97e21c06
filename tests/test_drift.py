"""Drift hand cases (FIXTURES F-7)."""

from pyspark.sql import functions as F

from weblog_engine.operators import drift, features
from weblog_engine.sources.tables import weblogs


def frames(spark, sf_dir):
    f = features.row_features(weblogs(spark, sf_dir))
    return f.where(F.dayofmonth("timestamp") <= 15), f.where(F.dayofmonth("timestamp") > 15)


def test_identical_frames_no_drift(spark, sf_dir):
    ref, _ = frames(spark, sf_dir)
    k = drift.ks_columns(ref, ref, ["response_time_ms", "hour"], buckets=3).collect()
    assert all(r["ks_statistic"] == 0.0 and r["p_value"] == 1.0 and not r["drift_detected"] for r in k)
    d = drift.dataset_drift(drift.ks_columns(ref, ref, ["response_time_ms"])).first()
    assert d["drift_share"] == 0.0 and not d["dataset_drift"]


def test_shifted_column_drifts(spark, sf_dir):
    ref, cur = frames(spark, sf_dir)
    cur2 = cur.withColumn("response_time_ms", F.col("response_time_ms") + 1000)
    k = {r["column"]: r for r in drift.ks_columns(ref, cur2, ["response_time_ms", "hour"]).collect()}
    assert k["response_time_ms"]["drift_detected"] and not k["hour"]["drift_detected"]
    # One of two columns drifting is not dataset drift (strictly more than half).
    d = drift.dataset_drift(drift.ks_columns(ref, cur2, ["response_time_ms", "hour"])).first()
    assert d["n_drifted_columns"] == 1 and d["drift_share"] == 0.5 and not d["dataset_drift"]
    w = {r["column"]: r for r in drift.wasserstein_columns(ref, cur2, ["response_time_ms", "hour"]).collect()}
    assert w["response_time_ms"]["drift_detected"]
    assert abs(w["response_time_ms"]["wasserstein"] - 1000.0) < 60


def test_ks_matches_known_value(spark):
    # Two samples with D = 0.5 at x in [2, 3).
    a = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]], "v double")
    b = spark.createDataFrame([(float(x),) for x in [3, 4, 5, 6]], "v double")
    r = drift.ks_columns(a, b, ["v"], buckets=2).first()
    assert r["ks_statistic"] == 0.5


def test_numeric_columns_excludes_id_and_one_hot(spark, sf_dir):
    ref, cur = frames(spark, sf_dir)
    cols = drift.numeric_columns(ref, cur)
    assert "id" not in cols and not any(c.startswith("method_") for c in cols)
    assert "response_time_ms" in cols and "is_error" in cols


def test_gate(spark, sf_dir):
    ref, cur = frames(spark, sf_dir)
    called = []
    cur2 = cur.withColumn("response_time_ms", F.col("response_time_ms") * 5) \
        .withColumn("hour", F.floor(F.col("hour") / 2).cast("int"))
    g = drift.drift_gate(cur2, ref, trainer=lambda: called.append(1),
                         columns=["response_time_ms", "hour", "status_code"]).first()
    assert g["drift_detected"] and g["action"] == "retrained" and called == [1]
    g2 = drift.drift_gate(cur, None).first()
    assert g2["action"] == "skipped"


def test_ks_exact_matches_enumeration():
    import itertools
    from fractions import Fraction

    def brute(m, n, d):
        total = hit = 0
        for pos in itertools.combinations(range(m + n), m):
            xs, i, j, dmax = set(pos), 0, 0, Fraction(0)
            for k in range(m + n):
                if k in xs:
                    i += 1
                else:
                    j += 1
                dmax = max(dmax, abs(Fraction(i, m) - Fraction(j, n)))
            total += 1
            hit += dmax >= d
        return hit / total

    for m, n, d in [(4, 5, Fraction(1, 2)), (5, 5, Fraction(3, 5)), (3, 7, Fraction(10, 21)), (6, 4, Fraction(1, 4))]:
        assert abs(drift.ks_exact_sf(float(d), m, n) - brute(m, n, d)) < 1e-12


def test_ks_exact_vs_asymptotic(spark, sf_dir):
    ref, cur = frames(spark, sf_dir)
    a = {r["column"]: r["p_value"] for r in drift.ks_columns(ref, cur, ["response_time_ms", "hour"],
                                                              p_method="asymptotic").collect()}
    e = {r["column"]: r["p_value"] for r in drift.ks_columns(ref, cur, ["response_time_ms", "hour"],
                                                              p_method="exact").collect()}
    assert all(abs(a[k] - e[k]) < 0.05 for k in a)
