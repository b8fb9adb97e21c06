"""The bucketed / chunked forms equal the single-partition windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weblog_engine.operators import features, prefix
from weblog_engine.sources.tables import weblogs


def test_dense_index_and_rolling(spark, sf_dir):
    df = weblogs(spark, sf_dir)
    w = Window.orderBy("timestamp", "id")
    want = df.select("id", (F.row_number().over(w) - 1).alias("i"),
                     F.avg("response_time_ms").over(w.rowsBetween(-49, 0)).alias("ra"))
    got = prefix.dense_index(df, ["timestamp", "id"], buckets=7)
    got = prefix.rolling_mean(got, ["timestamp", "id"], "response_time_ms", 50, "ra",
                              chunk_rows=60, indexed=got)
    a = {r["id"]: (r["i"], r["ra"]) for r in want.collect()}
    b = {r["id"]: (r["_idx"], r["ra"]) for r in got.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]
        assert abs(a[k][1] - b[k][1]) < 1e-9


def test_hourly_frequency_buckets(spark, sf_dir):
    df = weblogs(spark, sf_dir)
    f = features.engineer_features(df, buckets=5, chunk_rows=55)
    w = Window.partitionBy(F.hour("timestamp")).orderBy("timestamp", "id")
    want = {r["id"]: r["hf"] for r in df.select("id", F.row_number().over(w).alias("hf")).collect()}
    got = {r["id"]: r["hourly_frequency"] for r in f.select("id", "hourly_frequency").collect()}
    assert want == got


def test_running_sums_grouped_nulls(spark):
    rows = [(i, float(i % 13), None if i % 5 == 0 else f"g{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, g string")
    got = prefix.running_sums(df, ["x", "id"], {"c": F.lit(1).cast("long")}, by=["g"], buckets=6)
    w = Window.partitionBy("g").orderBy("x", "id")
    want = {r["id"]: r["c"] for r in df.select("id", F.row_number().over(w).alias("c")).collect()}
    assert {r["id"]: r["c"] for r in got.collect()} == want


def test_exclusive_rolling(spark, sf_dir):
    df = weblogs(spark, sf_dir)
    f = features.engineer_features(df, exclude_current=True, buckets=3, chunk_rows=70)
    w = Window.orderBy("timestamp", "id").rowsBetween(-50, -1)
    want = {r["id"]: r["v"] for r in df.select("id", F.avg("response_time_ms").over(w).alias("v")).collect()}
    got = {r["id"]: r["rolling_avg_response"] for r in f.select("id", "rolling_avg_response").collect()}
    for k, v in want.items():
        assert (v is None and got[k] is None) or abs(v - got[k]) < 1e-9


def test_rolling_with_buckets_smaller_than_window(spark, sf_dir):
    df = weblogs(spark, sf_dir)
    w = Window.orderBy("timestamp", "id")
    want = {r["id"]: r["v"] for r in df.select(
        "id", F.avg("response_time_ms").over(w.rowsBetween(-49, 0)).alias("v")).collect()}
    want_x = {r["id"]: r["v"] for r in df.select(
        "id", F.avg("response_time_ms").over(w.rowsBetween(-50, -1)).alias("v")).collect()}
    for b in (37, 200):
        got = {r["id"]: r["rolling_avg_response"] for r in features.engineer_features(df, buckets=b)
               .select("id", "rolling_avg_response").collect()}
        assert all(abs(want[k] - got[k]) < 1e-9 for k in want)
        got_x = {r["id"]: r["rolling_avg_response"] for r in features.engineer_features(
            df, buckets=b, exclude_current=True).select("id", "rolling_avg_response").collect()}
        assert all((v is None and got_x[k] is None) or abs(v - got_x[k]) < 1e-9 for k, v in want_x.items())


def test_equal_leading_values_are_divided(spark):
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(F.lit(5000.0)).alias("x"))
    b = prefix.add_range_bucket(df, ["x", "id"], 8)
    sizes = [r["count"] for r in b.groupBy(prefix.BUCKET).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 20_000 / 8
    got = prefix.running_sums(df, ["x", "id"], {"c": F.lit(1).cast("long")}, buckets=8)
    w = Window.orderBy("x", "id")
    want = {r["id"]: r["c"] for r in df.select("id", F.row_number().over(w).alias("c")).collect()}
    assert {r["id"]: r["c"] for r in got.collect()} == want


def test_values_that_most_rows_share_take_no_ranges(spark):
    """Buckets of counted values are balanced by the counted rows: the few
    values of flags, repeated in most rows, leave the ranges to the others."""
    raw = spark.range(20_000).select(F.when(F.col("id") % 10 != 0, F.col("id") % 3).otherwise(F.col("id")).cast("double").alias("value"))
    counts = raw.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    b = prefix.add_range_bucket(counts, ["value"], 8, edge_source=raw)
    sizes = [r["count"] for r in b.groupBy(prefix.BUCKET).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8
    got = prefix.running_sums(counts, ["value"], {"c": F.col("n")}, buckets=8, edge_source=raw).orderBy("value").collect()
    total = 0
    for r in got:
        total += r.n
        assert r.c == total
    assert total == 20_000
