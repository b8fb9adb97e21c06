"""Hand-computed statistics (100-row integration fixture, edge sizes)."""

import datetime as dt

from pyspark.sql import functions as F

from weblog_engine.operators import stats
from weblog_engine.schema import WEBLOG_SCHEMA


def fixture_rows(n=100):
    base = dt.datetime(2025, 1, 15, 10, 0)
    rows = []
    for i in range(n):
        status = 500 if i % 10 == 0 else (404 if i % 7 == 0 else 200)
        rows.append((i, base + dt.timedelta(minutes=i), "POST" if i % 3 == 0 else "GET",
                     "/api/test", status, 100.0 + 5 * i, None, "192.168.1.1", 1024))
    return rows


def test_summary_100_rows(spark):
    df = spark.createDataFrame(fixture_rows(), WEBLOG_SCHEMA)
    r = stats.stats_summary(df, buckets=3).first()
    assert r["total_records"] == 100
    assert r["mean_response_time"] == 347.5
    assert r["median_response_time"] == 347.5
    assert r["std_dev_response_time"] == 145.06
    assert r["percentile95_response_time"] == 570.0
    assert r["error_rate"] == 0.23
    assert (r["peak_hour"], r["peak_hour_count"]) == (10, 60)
    m = {x["method"]: x["count"] for x in stats.method_frequency(df).collect()}
    assert m == {"POST": 34, "GET": 66}
    s = {x["status_code"]: (x["count"], x["share"]) for x in stats.status_frequency(df).collect()}
    assert s == {500: (10, 0.1), 404: (13, 0.13), 200: (77, 0.77)}


def test_summary_empty(spark):
    df = spark.createDataFrame([], WEBLOG_SCHEMA)
    r = stats.stats_summary(df, buckets=3).first()
    assert r["total_records"] == 0
    assert r["mean_response_time"] == 0.0 and r["median_response_time"] == 0.0
    assert r["std_dev_response_time"] == 0.0 and r["percentile95_response_time"] == 0.0
    assert r["error_rate"] == 0.0 and r["peak_hour"] == 0 and r["peak_hour_count"] == 0
    assert stats.status_frequency(df).count() == 0


def test_summary_one_row(spark):
    df = spark.createDataFrame(fixture_rows(1), WEBLOG_SCHEMA)
    r = stats.stats_summary(df, buckets=3).first()
    assert r["std_dev_response_time"] == 0.0
    assert r["median_response_time"] == 100.0 and r["percentile95_response_time"] == 100.0


def test_order_statistics_with_ties(spark):
    vals = [5.0] * 40 + [1.0] * 30 + [9.0] * 31
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    n = F.col("n")
    r = stats.order_statistics(df, "x", {"lo": stats.median_rank_lo(n), "p95": stats.nearest_rank(0.95, n),
                                         "first": F.lit(0), "last": n - 1}, buckets=4).first()
    s = sorted(vals)
    assert r["lo"] == s[50] and r["first"] == 1.0 and r["last"] == 9.0
    assert r["p95"] == s[95]


def test_stats_document(spark):
    df = spark.createDataFrame(fixture_rows(), WEBLOG_SCHEMA)
    r = stats.stats_document(df, buckets=3).first()
    assert r["status_code_frequency_absolute"] == {500: 10, 404: 13, 200: 77}
    assert r["status_code_frequency_relative"] == {500: 0.1, 404: 0.13, 200: 0.77}
    assert r["method_frequency"] == {"POST": 34, "GET": 66}
    e = stats.stats_document(spark.createDataFrame([], WEBLOG_SCHEMA), buckets=3).first()
    assert e["status_code_frequency_absolute"] == {} and e["total_records"] == 0


def test_describe_columns(spark):
    df = spark.createDataFrame([(1.0, 10), (2.0, 10), (3.0, None), (4.0, 30)], "a double, b int")
    r = {x["column"]: x for x in stats.describe_columns(df, ["a", "b"], buckets=2).collect()}
    a = r["a"]
    assert (a["count"], a["mean"], a["min"], a["max"]) == (4, 2.5, 1.0, 4.0)
    assert (a["p25"], a["p50"], a["p75"]) == (1.75, 2.5, 3.25)
    assert r["b"]["count"] == 3 and r["b"]["p50"] == 10.0
