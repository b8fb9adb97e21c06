"""Smaller code paths: ingest columns, evaluation tables, forest round trip,
RocksDB state, Shapley chain identity."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from weblog_engine.operators import explain, features, iforest, split, train
from weblog_engine.sources import ingest
from weblog_engine.sources.tables import weblogs
from weblog_engine.streaming import jobs


def test_with_ingest_columns(spark, sf_dir):
    good = weblogs(spark, sf_dir).drop("id")
    out = ingest.with_ingest_columns(good)
    assert out.select("id").distinct().count() == out.count()
    assert "created_at" in out.columns


def test_evaluation_tables_and_importance(spark, sf_dir):
    f = split.split(features.engineer_features(weblogs(spark, sf_dir)), by="is_error")
    tr, te = f.where("split = 'train'"), f.where("split = 'test'")
    t, _ = train.fit_classifiers(tr, te, features.CLASSIFICATION_FEATURES, "is_error",
                                 train.classifier_candidates(5, 3, n_weighted_rows=800.0), concurrent=False)
    tabs = train.evaluation_tables(t, te)
    assert set(tabs) == {"roc", "pr", "confusion", "report"}
    assert tabs["confusion"].agg(F.sum("count")).first()[0] == te.count()
    imp = train.feature_importance(t).collect()
    assert len(imp) == len(features.CLASSIFICATION_FEATURES)


def test_forest_json_round_trip(spark, sf_dir):
    f = features.row_features(weblogs(spark, sf_dir))
    cols = ["hour", "response_time_ms"]
    m = iforest.fit_forest(f, cols, n_trees=10)
    m2 = iforest.ForestModel.from_json(m.to_json())
    a = [r["if_score"] for r in iforest.score(f, m).orderBy("id").collect()]
    b = [r["if_score"] for r in iforest.score(f, m2).orderBy("id").collect()]
    assert a == b


def test_path_length_constants():
    assert iforest.average_path_length(1) == 0.0
    assert iforest.average_path_length(2) == 1.0
    c256 = iforest.average_path_length(256)
    assert abs(c256 - (2 * (np.log(255) + 0.5772156649015329) - 2 * 255 / 256)) < 1e-12


def test_rocksdb_state_window_stream(spark):
    root = tempfile.mkdtemp(prefix="rocks-")
    src, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as fh:
        fh.write('{"timestamp":"2025-01-15T00:01:00","method":"GET","statusCode":200,"responseTimeMs":4}\n'
                 '{"timestamp":"2025-01-15T00:07:00","method":"GET","statusCode":500,"responseTimeMs":6}\n')
    prev = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.use_rocksdb_state(spark)
    try:
        events, _ = jobs.event_stream(jobs.file_source(spark, src))
        q = jobs.start_window_job(events, out, ck)
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", prev)
    rows = spark.read.parquet(out).collect()
    assert [(r["count"], r["avg_response_time_ms"]) for r in rows] == [(1, 4.0)]


def test_shapley_matches_model_output(spark, sf_dir):
    f = split.split(features.engineer_features(weblogs(spark, sf_dir)), by="is_error")
    tr, te = f.where("split = 'train'"), f.where("split = 'test'")
    t, _ = train.fit_classifiers(tr, te, features.CLASSIFICATION_FEATURES, "is_error",
                                 [train.classifier_candidates(5, 3, n_weighted_rows=800.0)[1]], concurrent=False)
    c = explain.shapley(t, f, n_rows=4, n_chains=6, n_background=1)
    tot = {r["id"]: r for r in explain.base_and_total(t, f, c).collect()}
    # With one background row b, every chain adds up to f(x) - f(b).
    bg = explain.sample_rows(f, 1, 43)
    fb = train.positive_score(t.model.transform(bg)).first()["score"]
    for r in tot.values():
        assert abs(r["score"] - r["total"] - fb) < 1e-9


def test_failed_training_run_is_recorded(spark, sf_dir):
    import uuid

    import pytest

    from weblog_engine.operators import training_job
    from weblog_engine.session import scratch_path
    out = scratch_path(spark, f"failrun-{uuid.uuid4().hex}")
    empty = weblogs(spark, sf_dir).where(F.col("id") < 0)
    with pytest.raises(ValueError):
        training_job.train_all(empty, out, 2, 2, 2)
    r = spark.read.parquet(os.path.join(out, "training_runs")).first()
    assert r["status"] == "failed" and r["num_samples"] == 0
