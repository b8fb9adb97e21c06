"""Metrics on hand cases."""

from weblog_engine.operators import metrics, split


def test_auc_hand_case(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    assert metrics.roc_auc(df, buckets=2).first()["roc_auc"] == 0.75


def test_auc_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert metrics.roc_auc(df).first()["roc_auc"] == 0.5


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    cm = {(r["label"], r["prediction"]): r["count"] for r in metrics.confusion(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    rep = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert rep["accuracy"]["f1"] == 0.6
    assert abs(rep["1"]["precision"] - 0.5) < 1e-12 and abs(rep["0"]["recall"] - 2 / 3) < 1e-12


def test_interval_clip(spark):
    df = spark.createDataFrame([(10.0,), (500.0,)], "prediction double")
    rows = metrics.interval_95(df, rmse=100.0).orderBy("prediction").collect()
    assert rows[0]["lower_bound_ms"] == 0.0 and rows[1]["upper_bound_ms"] == 696.0
    fb = metrics.interval_95(df).orderBy("prediction").collect()
    assert fb[1]["lower_bound_ms"] == 304.0


def test_stratified_split_sizes(spark):
    df = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(101)], "id long, label int")
    s = split.split(df, by="label", buckets=3)
    c = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert c[(1, "test")] == 6 and c[(0, "test")] == 15


def test_accuracy_f1_from_counts_matches_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (1, 1)], "label int, prediction int")
    cm = {(r["label"], r["prediction"]): r["count"] for r in metrics.confusion(df).collect()}
    a = metrics.accuracy_f1_from_counts(cm)
    b = metrics.accuracy_f1(df).first()
    assert abs(a["accuracy"] - b["accuracy"]) < 1e-12 and abs(a["f1_weighted"] - b["f1_weighted"]) < 1e-12


def test_curves_documented_example(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    roc = sorted(((r["threshold"], r["fpr"], r["tpr"])
                  for r in metrics.roc_points(df, buckets=2, drop_intermediate=True).collect()), reverse=True)
    assert roc == [(float("inf"), 0.0, 0.0), (0.8, 0.0, 0.5), (0.4, 0.5, 0.5), (0.35, 0.5, 1.0), (0.1, 1.0, 1.0)]
    pr = metrics.pr_points(df, buckets=2, end_point=True).collect()
    got = sorted(((r["threshold"] if r["threshold"] is not None else 9.0), round(r["precision"], 6), r["recall"])
                 for r in pr)
    assert got == [(0.1, 0.5, 1.0), (0.35, 0.666667, 1.0), (0.4, 0.5, 0.5), (0.8, 1.0, 0.5), (9.0, 1.0, 0.0)]


def test_split_multi_equals_single_splits(spark):
    df = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i in range(300)], "id long, label int")
    m = {r["id"]: (r["a"], r["b"]) for r in split.split_multi(df, {"a": "label", "b": None}, buckets=3).collect()}
    a = {r["id"]: r["split"] for r in split.split(df, by="label", buckets=5).collect()}
    b = {r["id"]: r["split"] for r in split.split(df, buckets=2).collect()}
    assert all(m[k] == (a[k], b[k]) for k in m)
