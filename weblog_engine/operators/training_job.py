"""The whole training job: features -> reference snapshot -> splits ->
classifiers and regressors -> anomaly detector -> saved models and
bookkeeping rows."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from . import anomaly, drift, features, iforest, split, train


@dataclass
class TrainResult:
    run_id: str
    version: str
    num_samples: int
    classifier: train.Trained
    regressor: train.Trained
    detector: anomaly.Detector
    classifier_table: DataFrame
    regressor_table: DataFrame
    features: DataFrame
    paths: dict


def _fit_detector(feats: DataFrame, clf_f: list[str], baseline: str, forest_trees: int) -> anomaly.Detector:
    return anomaly.fit_detector(feats, clf_f, baseline, n_trees=forest_trees)


def train_all(logs: DataFrame, out_dir: str, n_trees: int = train.CLF_FOREST_TREES,
              boost_rounds: int = train.CLF_BOOST_ROUNDS, forest_trees: int = iforest.N_TREES,
              label: str = "is_error", baseline: str = "response_time_ms",
              clf_features: list[str] | None = None, reg_features: list[str] | None = None,
              chunk_rows: int = 1_000_000) -> TrainResult:
    """Run the training job. All candidates are fitted on every row of their
    training split. A failure is recorded as a 'failed' run row before the error
    is raised again."""
    spark = logs.sparkSession
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    run_id = uuid.uuid4().hex
    try:
        return _train_all(logs, out_dir, n_trees, boost_rounds, forest_trees, label, baseline,
                          clf_features, reg_features, chunk_rows, started, run_id)
    except Exception:
        completed = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        train.run_row(spark, run_id, "failed", 0, None, None, started, completed) \
            .write.mode("append").parquet(os.path.join(out_dir, "training_runs"))
        raise


def _train_all(logs, out_dir, n_trees, boost_rounds, forest_trees, label, baseline,
               clf_features, reg_features, chunk_rows, started, run_id) -> TrainResult:
    spark = logs.sparkSession
    version = train.model_version(started)
    # The feature table with both split labels feeds many passes: materialise
    # it once (reliable checkpoint in the shared folder).
    f = features.engineer_features(logs, chunk_rows=chunk_rows)
    f = split.split_multi(f, {"split_clf": label, "split_reg": None})
    feats = pin(f)
    n = feats.count()
    if n == 0:
        raise ValueError("no training data")
    clf_f = clf_features or features.classification_features()
    reg_f = reg_features or features.regression_features()
    paths = {k: os.path.join(out_dir, k) for k in ("reference", "classifier", "regressor", "detector",
                                                    "training_runs", "model_metadata")}
    drift.save_snapshot(feats.drop("split_clf", "split_reg"), paths["reference"])

    clf_train, clf_test = feats.where(F.col("split_clf") == "train"), feats.where(F.col("split_clf") == "test")
    reg_train, reg_test = feats.where(F.col("split_reg") == "train"), feats.where(F.col("split_reg") == "test")

    n_train = clf_train.count()
    # Classifiers, regressors and the detector are independent: run them
    # as concurrent Spark jobs.
    (clf, clf_table), (reg, reg_table), det = train.run_concurrently([
        lambda: train.fit_classifiers(
            clf_train, clf_test, clf_f, label,
            train.classifier_candidates(n_trees, boost_rounds, n_weighted_rows=float(n_train), by_trees=True)),
        lambda: train.fit_regressors(
            reg_train, reg_test, reg_f, "response_time_ms",
            train.regressor_candidates(n_trees, boost_rounds, by_trees=True)),
        lambda: _fit_detector(feats, clf_f, baseline, forest_trees),
    ])
    clf.version = reg.version = version

    train.save_model(clf, paths["classifier"])
    train.save_model(reg, paths["regressor"])
    anomaly.save_detector(spark, det, paths["detector"])
    completed = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    train.run_row(spark, run_id, "success", n, clf, reg, started, completed) \
        .write.mode("append").parquet(paths["training_runs"])
    train.model_rows(spark, clf, paths["classifier"], completed) \
        .unionByName(train.model_rows(spark, reg, paths["regressor"], completed)) \
        .unionByName(train.detector_row(spark, det, version, paths["detector"], completed)) \
        .write.mode("append").parquet(paths["model_metadata"])
    return TrainResult(run_id, version, n, clf, reg, det, clf_table, reg_table, feats, paths)
