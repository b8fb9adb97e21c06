"""Feature edge rows (FIXTURES F-3) and request validation (F-4)."""

import datetime as dt

from pyspark.sql import functions as F

from weblog_engine.operators import features
from weblog_engine.schema import WEBLOG_SCHEMA


def rows():
    base = dt.datetime(2025, 1, 5, 10, 0)          # a Sunday
    out = [(0, base, "GET", "/", 200, 100.0, None, None, 0),
           (1, dt.datetime(2025, 1, 10, 18, 59), "POST", "/", 500, 200.0, None, None, 0),   # Friday
           (2, dt.datetime(2025, 1, 10, 19, 0), "HEAD", "/", 404, 300.0, None, None, 0)]
    for i in range(3, 60):
        out.append((i, dt.datetime(2025, 1, 11, 0, 0) + dt.timedelta(minutes=i), "PUT", "/", 200,
                    float(i), None, None, 0))
    return out


def test_feature_edge_rows(spark):
    df = spark.createDataFrame(rows(), WEBLOG_SCHEMA)
    f = {r["id"]: r for r in features.engineer_features(df, buckets=4).collect()}
    assert (f[0]["day_of_week"], f[0]["is_business_hours"]) == (6, 0)
    assert (f[1]["day_of_week"], f[1]["hour"], f[1]["is_business_hours"]) == (4, 18, 1)
    assert (f[2]["hour"], f[2]["is_business_hours"]) == (19, 0)
    assert all(f[2][f"method_{m}"] == 0 for m in ("GET", "POST", "PUT", "DELETE", "PATCH"))
    assert f[1]["is_error"] == 1 and f[2]["is_error"] == 1 and f[0]["is_error"] == 0
    # Row 49 (0-based) is the first with a full 50-row window; row 59 drops the first ten.
    vals = [r[5] for r in rows()]
    assert abs(f[49]["rolling_avg_response"] - sum(vals[0:50]) / 50) < 1e-9
    assert abs(f[59]["rolling_avg_response"] - sum(vals[10:60]) / 50) < 1e-9
    assert abs(f[2]["rolling_avg_response"] - 200.0) < 1e-9
    assert f[59]["hourly_frequency"] == 57 - 0  # hours 0 on Jan 11: rows 3..59
    assert sorted(features.classification_features()) == sorted(features.CLASSIFICATION_FEATURES)
    assert len(features.classification_features()) == 10 and len(features.regression_features()) == 11


def test_anomaly_request_validation(spark):
    req = spark.createDataFrame([(200.0, "GET", 12), (15000.0, "GET", 3), (-5.0, "GET", 12), (300.0, "PUT", 24)],
                                "response_time_ms double, method string, hour int")
    good, bad = features.validate_requests(req, "anomaly")
    assert good.count() == 2
    assert {r["reject_reason"] for r in bad.collect()} == {"invalid response_time_ms", "invalid hour"}


def test_extra_methods_get_columns(spark):
    df = spark.createDataFrame(rows()[:3], WEBLOG_SCHEMA)
    f = features.row_features(df, extra_methods=["HEAD"])
    assert f.where(F.col("method_HEAD") == 1).count() == 1
