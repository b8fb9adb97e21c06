"""Model invariants (FIXTURES F-4, F-5): learnable label, probability range,
best = max metric, interval bounds, reload gives identical scores, forest
flags ~contamination and the far outlier, Shapley sums."""

import uuid

import pytest
from pyspark.sql import functions as F

from weblog_engine.operators import anomaly, explain, features, iforest, score, split, train
from weblog_engine.session import scratch_path
from weblog_engine.sources.tables import weblogs

FEATS = features.CLASSIFICATION_FEATURES + ["response_time_ms"]


@pytest.fixture(scope="module")
def feats(spark, sf_dir):
    f = features.engineer_features(weblogs(spark, sf_dir))
    f = f.withColumn("slow", (F.col("response_time_ms") > 500).cast("int"))
    return split.split(f, by="slow").persist()


@pytest.fixture(scope="module")
def clf(feats):
    tr, te = feats.where("split = 'train'"), feats.where("split = 'test'")
    t, table = train.fit_classifiers(tr, te, FEATS, "slow",
                                     train.classifier_candidates(8, 5, n_weighted_rows=float(tr.count())))
    return t, table


def test_classifier_invariants(clf):
    t, table = clf
    rows = table.collect()
    assert [r["model"] for r in rows] == ["logistic_regression", "random_forest", "gradient_boosted_trees"]
    best = max(rows, key=lambda r: (r["roc_auc"], -r["position"]))
    assert t.best_name == best["model"]
    assert all(0.5 <= r["roc_auc"] <= 1.0 for r in rows)


def test_scoring_and_reload(spark, clf):
    t, _ = clf
    req = spark.createDataFrame([("GET", 14, 240.0, 2), ("post", 10, 500.0, 2), ("GET", 25, 240.0, 2),
                                 ("GET", 10, -10.0, 2), (None, 10, 100.0, 2)],
                                "method string, hour int, historical_avg_response double, day_of_week int")
    req = req.withColumn("response_time_ms", F.col("historical_avg_response"))
    out = {(r["method"], r["hour"], r["historical_avg_response"]): r for r in score.score_error(req, t).collect()}
    good = [r for r in out.values() if r["error_probability"] >= 0]
    assert len(good) == 2 and all(0 <= r["error_probability"] <= 1 for r in good)
    assert all(r["risk_level"] in ("LOW", "MEDIUM", "HIGH", "CRITICAL") for r in good)
    assert sum(r["risk_level"] == "UNKNOWN" for r in out.values()) == 3
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    train.save_model(t, path)
    again = train.load_model(path)
    a = sorted(r["error_probability"] for r in score.score_error(req, t).collect())
    b = sorted(r["error_probability"] for r in score.score_error(req, again).collect())
    assert a == b and again.best_name == t.best_name


def test_forests_keep_nodes_of_rows(spark, feats):
    """The same trees as without; the walk from the roots is spared."""
    cands = [*train.classifier_candidates(n_trees=4), *train.regressor_candidates(n_trees=4)]
    data = split.with_class_weights(feats, "is_error").withColumn("label", F.col("is_error").cast("double"))
    for c in (c for c in cands if c.name.startswith("random_forest")):
        assert c.estimator.getCacheNodeIds()
        kept, plain = (train._model_spec(FEATS, c.estimator.copy({c.estimator.cacheNodeIds: k})).fit(data).stages[-1].toDebugString
                       for k in (True, False))
        assert kept.split("\n", 1)[1] == plain.split("\n", 1)[1]


def test_kept_nodes_are_bounded(spark, feats, monkeypatch):
    """Of a table too large for that, forests walk again: the same trees."""
    data, fits, spec = feats.withColumn("label", F.col("response_time_ms")), [], train._model_spec
    monkeypatch.setattr(train, "_model_spec", lambda f, est: fits.append(est) or spec(f, est))
    c = train.regressor_candidates(n_trees=3)[1]
    kept = train._fitted(c, data, FEATS[:4])
    monkeypatch.setattr(train, "NODE_ID_BYTES", 0)
    walked = train._fitted(c, data, FEATS[:4])
    assert [e.getCacheNodeIds() for e in fits] == [True, False]
    a, b = (m.stages[-1].toDebugString.split("\n", 1)[1] for m in (kept, walked))
    assert a == b


def test_regressor_interval(spark, feats):
    tr, te = feats.where("split = 'train'"), feats.where("split = 'test'")
    t, table = train.fit_regressors(tr, te, features.REGRESSION_FEATURES, "response_time_ms",
                                    train.regressor_candidates(8, 5))
    assert t.best_name == max(table.collect(), key=lambda r: (r["r2"], -r["position"]))["model"]
    req = spark.createDataFrame([("GET", 14, 240.0, 2, 0), ("POST", 17, 800.0, 2, 0), ("GET", 3, 5.0, 2, 2)],
                                "method string, hour int, historical_avg_response double, day_of_week int, is_error int")
    rows = score.score_response_time(req, t).collect()
    ok = [r for r in rows if r["predicted_response_time_ms"] >= 0]
    assert len(ok) == 2
    assert all(r["lower_bound_ms"] >= 0 and r["upper_bound_ms"] >= r["lower_bound_ms"] for r in ok)


def test_isolation_forest(spark, feats):
    f = iforest.fit_forest(feats, FEATS, n_trees=40)
    s = iforest.score(feats, f)
    share = s.agg(F.avg(F.col("if_anomaly").cast("double"))).first()[0]
    assert abs(share - 0.05) < 0.01
    det = anomaly.fit_moments(feats, FEATS)
    req = spark.createDataFrame([(1, 15000.0, "GET", 3), (2, 200.0, "GET", 12)],
                                "id long, response_time_ms double, method string, hour int")
    rf = features.request_features(req.withColumn("historical_avg_response", F.col("response_time_ms")))
    rf = rf.withColumn("response_time_ms", F.col("historical_avg_response"))
    res = {r["id"]: r for r in anomaly.combine(iforest.score(anomaly.zscore_detect(rf, det), f)).collect()}
    assert res[1]["is_anomaly"] and res[1]["details"]["z_score"]["is_anomaly"]
    assert not res[2]["details"]["z_score"]["is_anomaly"]


def test_shapley_sums(spark, feats, clf):
    t, _ = clf
    c = explain.shapley(t, feats, n_rows=5, n_chains=4, n_background=4)
    per = c.groupBy("id").agg(F.count("*").alias("k")).collect()
    assert len(per) == 5 and all(r["k"] == len(FEATS) for r in per)


def test_fallback_detector_defaults(spark):
    req = spark.createDataFrame([(1, 250.0 + 150.0 * 4)], "id long, response_time_ms double")
    r = anomaly.combine(anomaly.zscore_detect(req, None)).first()
    assert r["z_score"] == 4.0 and r["is_anomaly"] and r["score"] == -0.5


def test_alerts_with_forest(spark, feats):
    f = iforest.fit_forest(feats, features.CLASSIFICATION_FEATURES, n_trees=20)
    det = anomaly.fit_moments(feats, features.CLASSIFICATION_FEATURES)
    logs = feats.select("id", "timestamp", "method", "response_time_ms", "status_code", "hour")
    a = anomaly.alerts(logs, det, forest_scorer=lambda x: iforest.score(x, f))
    rows = a.collect()
    assert rows and all(r["alert_type"] == "anomaly_detected" and not r["acknowledged"] and r["severity"] in ("HIGH", "MEDIUM") for r in rows)
    z_only = anomaly.alerts(logs, det).count()
    assert len(rows) >= z_only


def test_detect_requests_public_api(spark, feats):
    det = anomaly.fit_detector(feats, features.CLASSIFICATION_FEATURES, n_trees=20)
    req = spark.createDataFrame([(200.0, "GET", 12), (15000.0, "GET", 3), (-5.0, "GET", 12)] +
                                [(300.0, m, 12) for m in ("GET", "POST", "PUT", "DELETE", "PATCH")],
                                "response_time_ms double, method string, hour int")
    out = anomaly.detect_requests(req, det).collect()
    assert len(out) == 8
    bad = [r for r in out if r["reject_reason"] is not None]
    assert [(r["response_time_ms"], r["is_anomaly"], r["reject_reason"]) for r in bad] == [(-5.0, None, "invalid response_time_ms")]
    big = [r for r in out if r["response_time_ms"] == 15000.0][0]
    assert big["is_anomaly"] and big["details"]["z_score"]["is_anomaly"]
    b = anomaly.detect_batch(feats, det)
    assert b.where("is_anomaly").count() > 0


def test_features_of_queries_are_worked_out_once(spark, sf_dir):
    """Models read the features many times; no read goes back to the windows."""
    from weblog_engine.operators import features
    from weblog_engine.plans import models
    from weblog_engine.sources.tables import weblogs
    got = models._features(spark, sf_dir)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = features.engineer_features(weblogs(spark, sf_dir)).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
