"""Counter resets and histogram quantiles (FIXTURES F-10)."""

import datetime as dt

from pyspark.sql import functions as F

from weblog_engine.operators import metricsq

T0 = dt.datetime(2025, 1, 15, 10, 0)


def test_counter_reset(spark):
    rows = [("c", {"job": "a"}, T0 + dt.timedelta(seconds=60 * i), v) for i, v in enumerate([10.0, 20.0, 5.0, 15.0])]
    s = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp_ntz, value double")
    inc = [r["increase"] for r in metricsq.counter_increases(s).orderBy("ts").collect()]
    assert inc == [None, 10.0, 5.0, 10.0]
    rate = [r["rate"] for r in metricsq.counter_rate(s).orderBy("ts").collect()]
    assert rate[-1] == 25.0 / 300


def test_histogram_quantile(spark):
    rows = [(T0, le, c) for le, c in [("0.1", 10.0), ("0.5", 60.0), ("1", 90.0), ("+Inf", 100.0)]]
    b = spark.createDataFrame(rows, "ts timestamp_ntz, le string, rate double")
    q50 = metricsq.histogram_quantile(0.5, b).first()["quantile"]
    assert abs(q50 - 0.42) < 1e-12
    assert metricsq.histogram_quantile(0.95, b).first()["quantile"] == 1.0


def test_instant_values(spark):
    rows = [("up", {"job": "a"}, T0, 1.0), ("up", {"job": "b"}, T0 - dt.timedelta(minutes=10), 1.0),
            ("up", {"job": "c"}, T0, 0.0)]
    s = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp_ntz, value double")
    got = {r["series"]: r["state"] for r in metricsq.instant_values(s, at=F.lit(T0)).collect()}
    assert got == {"job=a": "UP", "job=c": "DOWN"}  # the stale series is absent


def test_select_series_and_scale(spark):
    rows = [("jvm_memory_used_bytes", {"area": "heap", "job": "a"}, T0, 2.0 * 1024 * 1024),
            ("jvm_memory_used_bytes", {"area": "nonheap", "job": "a"}, T0, 1.0)]
    s = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp_ntz, value double")
    h = metricsq.select_series(s, "jvm_memory_used_bytes", area="heap")
    assert h.select(metricsq.scale(F.col("value"), 1 / 1024 / 1024).alias("mib")).first()["mib"] == 2.0
