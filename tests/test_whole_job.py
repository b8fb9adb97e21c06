"""The training job and the explanations take every row."""

import datetime as dt

from pyspark.sql import functions as F

from weblog_engine.operators import explain, features, ols, train, training_job
from weblog_engine.operators.native import NativeModel
from weblog_engine.plans import models
from weblog_engine.schema import WEBLOG_SCHEMA

START = dt.datetime(2024, 3, 4)


def logs(spark, n):
    """n log rows, one a minute, every fifth an error."""
    e = spark.range(n).select(
        "id", (F.lit(START).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("timestamp"),
        F.element_at(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT")]), (F.col("id") % 3 + 1).cast("int")).alias("method"),
        F.lit("/a").alias("path"), F.when(F.col("id") % 5 == 0, 500).otherwise(200).alias("status_code"),
        ((F.col("id") * 7919) % 1000 + 1).cast("double").alias("response_time_ms"))
    return e.select(*[(F.col(f.name) if f.name in e.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in WEBLOG_SCHEMA])


def test_all_labelled_rows_are_fitted(spark, tmp_path, monkeypatch):
    """Each candidate is fitted on all rows of its training split, however many."""
    seen, fitted = {}, train._fitted

    def spy(c, rows, feats):
        seen[c.name] = rows.count()
        return fitted(c, rows, feats)

    monkeypatch.setattr(train, "_fitted", spy)
    n = 26_000
    t = training_job.train_all(logs(spark, n), str(tmp_path / "models"), 2, 2, 2)
    assert t.num_samples == n and len(seen) == 6
    assert set(seen.values()) == {n * 4 // 5}


def test_all_rows_are_explained(spark):
    f = features.engineer_features(logs(spark, 700))
    feats = features.REGRESSION_FEATURES
    t = train.Trained("regressor", "linear_regression", NativeModel("linear", ols.fit(f, feats, "response_time_ms")), feats)
    assert explain.exact(t, f).groupBy("id").count().where(F.col("count") == len(feats)).count() == 700


def test_additivity_of_all_rows(spark, tmp_path):
    """The query gives each row, also of those that share an id."""
    n = 600
    e = spark.range(n).select(
        (F.col("id") % 550).alias("event_id"), (F.lit(START).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"),
        ((F.col("id") * 31) % 97 + 1).cast("double").alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = models._additivity(spark, str(tmp_path)).collect()
    assert len(got) == n and len({r.id for r in got}) == 550
    assert all(abs(r.missing) < 1e-4 for r in got)
