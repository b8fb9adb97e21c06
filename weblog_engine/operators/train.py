"""Train, compare and keep the best model (Spark ML pipelines), plus the
run and model bookkeeping tables."""

from __future__ import annotations

import datetime as dt
import json
import os
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MODEL_METADATA_SCHEMA, TRAINING_RUNS_SCHEMA
from . import forest, metrics
from .native import BoostedFit, ForestFit, LinearFit, NativeModel
from .split import SEED, with_class_weights
from .treewalk import Nodes

# Reference hyper-parameters.
CLF_LOGISTIC_MAX_ITER = 1000
CLF_FOREST_TREES, CLF_FOREST_DEPTH = 200, 10
CLF_BOOST_ROUNDS, CLF_BOOST_DEPTH, CLF_BOOST_RATE, CLF_BOOST_POS_WEIGHT = 200, 6, 0.1, 5.0
REG_FOREST_TREES, REG_FOREST_DEPTH = 200, 12
REG_BOOST_ROUNDS, REG_BOOST_DEPTH, REG_BOOST_RATE = 200, 6, 0.1

NODE_ID_BYTES = 1 << 30  # of the kept nodes of a forest's rows, at most


@dataclass
class Candidate:
    name: str
    estimator: object
    weight: str | None = None          # 'balanced' or None
    by_trees: ForestFit | None = None  # the same forest for tables that fit a task

    @property
    def native(self) -> bool:
        """One of this package's models: fitted on every row."""
        return isinstance(self.estimator, (BoostedFit, LinearFit))


def classifier_candidates(n_trees: int = CLF_FOREST_TREES, boost_rounds: int = CLF_BOOST_ROUNDS,
                          seed: int = SEED, n_weighted_rows: float | None = None, by_trees: bool = False) -> list[Candidate]:
    """Logistic regression (L2, C=1 on the weighted loss: regParam = 1/sum(w)),
    random forest and second-order boosted trees, with the reference's class
    weighting. Forests keep each row's node of each tree from level to level: the
    same trees, without a walk from all roots for every group of nodes. Groups are
    bounded by trees and depth, so these nodes are not checkpointed. With
    ``by_trees`` tasks grow whole trees of a table that fits them (see ``forest``).
    The logistic fit standardises internally: with raw feature scales (hour
    vs. a rolling mean in ms) L-BFGS needs hundreds of distributed
    iterations, and with a penalty this small the optimum barely moves."""
    reg = 1.0 / n_weighted_rows if n_weighted_rows else 0.0
    return [
        Candidate("logistic_regression",
                  LogisticRegression(maxIter=CLF_LOGISTIC_MAX_ITER, regParam=reg, elasticNetParam=0.0,
                                     standardization=True, weightCol="weight"), "balanced"),
        Candidate("random_forest",
                  RandomForestClassifier(numTrees=n_trees, maxDepth=CLF_FOREST_DEPTH, seed=seed,
                                         weightCol="weight", cacheNodeIds=True, checkpointInterval=-1), "balanced",
                  ForestFit("share", n_trees, CLF_FOREST_DEPTH, seed, "weight") if by_trees else None),
        Candidate("gradient_boosted_trees",
                  BoostedFit("logistic", boost_rounds, CLF_BOOST_DEPTH, CLF_BOOST_RATE, CLF_BOOST_POS_WEIGHT)),
    ]


def regressor_candidates(n_trees: int = REG_FOREST_TREES, boost_rounds: int = REG_BOOST_ROUNDS,
                         seed: int = SEED, by_trees: bool = False) -> list[Candidate]:
    return [
        Candidate("linear_regression", LinearFit()),
        Candidate("random_forest_regressor",
                  RandomForestRegressor(numTrees=n_trees, maxDepth=REG_FOREST_DEPTH, seed=seed, cacheNodeIds=True,
                                        checkpointInterval=-1), None,
                  ForestFit("mean", n_trees, REG_FOREST_DEPTH, seed) if by_trees else None),
        Candidate("gradient_boosting", BoostedFit("squared", boost_rounds, REG_BOOST_DEPTH, REG_BOOST_RATE)),
    ]


@dataclass
class Trained:
    kind: str                       # 'classifier' | 'regressor'
    best_name: str
    model: PipelineModel | NativeModel
    features: list[str]
    metrics: dict = field(default_factory=dict)     # name -> metric dict
    version: str = ""

    @property
    def best_metrics(self) -> dict:
        return self.metrics.get(self.best_name, {})


def _model_spec(features: list[str], est) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), est])


def positive_score(pred: DataFrame) -> DataFrame:
    """The probability of label 1 as ``score`` (this package's models give it
    under that name)."""
    return pred.withColumn("score", vector_to_array("probability")[1]) if "probability" in pred.columns else pred


def _weighted(df: DataFrame, label: str, mode: str | None) -> DataFrame:
    return with_class_weights(df, label) if mode == "balanced" else df


def _fitted(c: Candidate, rows: DataFrame, features: list[str]) -> PipelineModel | NativeModel:
    if c.native:
        return c.estimator.fit(rows, features, "label")
    rows, est = _weighted(rows, "label", c.weight), c.estimator
    if isinstance(est, (RandomForestClassifier, RandomForestRegressor)):
        n = rows.count()
        if c.by_trees and forest.fits(n, len(features)):
            return c.by_trees.fit(rows, features, "label")
        small = 4 * n * est.getNumTrees() <= NODE_ID_BYTES
        est = est.copy({est.cacheNodeIds: small and est.getCacheNodeIds()})
    return _model_spec(features, est).fit(rows)


def run_concurrently(tasks: list) -> list:
    """Run independent Spark jobs from driver threads. Small fits leave most
    executor slots idle; concurrent jobs share them."""
    if len(tasks) <= 1:
        return [t() for t in tasks]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        futures = [pool.submit(t) for t in tasks]
        return [f.result() for f in futures]


def fit_classifiers(train: DataFrame, test: DataFrame, features: list[str], label: str = "is_error",
                    candidates: list[Candidate] | None = None,
                    concurrent: bool = True) -> tuple[Trained, DataFrame]:
    """Fit each candidate on all of ``train``, score the test split, and keep the
    best by ROC-AUC (first candidate wins ties). Returns the winner and a metrics
    table (one row per candidate). Only metric values reach the driver."""
    spark = train.sparkSession
    tr = train.withColumn("label", F.col(label).cast("double"))
    te = test.withColumn("label", F.col(label).cast("double"))
    if candidates is None:
        candidates = classifier_candidates(n_weighted_rows=float(tr.count()))

    def one(pos, c):
        m = _fitted(c, tr, features)
        # Three metric passes read the same scored test split: keep it
        # (three narrow columns) for their duration only.
        pred = positive_score(m.transform(te)).select(F.col("label").cast("int").alias("label"),
                                                      "score", F.col("prediction").cast("int").alias("prediction"))
        pred = pred.persist(StorageLevel.MEMORY_AND_DISK)
        auc = metrics.roc_auc(pred).first()["roc_auc"]
        cm = {(r["label"], r["prediction"]): r["count"] for r in metrics.confusion(pred).collect()}
        pred.unpersist()
        af = metrics.accuracy_f1_from_counts(cm)
        return m, (pos, c.name, float(auc) if auc is not None else None, float(af["f1_weighted"]),
                   float(af["accuracy"]), json.dumps({f"{a}{b}": v for (a, b), v in sorted(cm.items())}))

    tasks = [lambda pos=pos, c=c: one(pos, c) for pos, c in enumerate(candidates)]
    done = run_concurrently(tasks) if concurrent else [t() for t in tasks]
    models = {c.name: m for c, (m, _) in zip(candidates, done)}
    rows = [r for _, r in done]
    table = spark.createDataFrame(rows, "position int, model string, roc_auc double, f1_score double, "
                                        "accuracy double, confusion string")
    best = table.orderBy(F.desc_nulls_last("roc_auc"), "position").first()["model"]
    mets = {r[1]: {"roc_auc": r[2], "f1_score": r[3], "accuracy": r[4]} for r in rows}
    return Trained("classifier", best, models[best], features, mets), table


def fit_regressors(train: DataFrame, test: DataFrame, features: list[str], label: str = "response_time_ms",
                   candidates: list[Candidate] | None = None,
                   concurrent: bool = True) -> tuple[Trained, DataFrame]:
    """Fit each candidate; keep the best by R^2 (first wins ties)."""
    spark = train.sparkSession
    tr = train.withColumn("label", F.col(label).cast("double"))
    te = test.withColumn("label", F.col(label).cast("double"))
    cands = candidates or regressor_candidates()

    def one(pos, c):
        m = _fitted(c, tr, features)
        r = metrics.regression_metrics(m.transform(te)).first()
        return m, (pos, c.name, float(r["rmse"]), float(r["mae"]),
                   float(r["r2"]) if r["r2"] is not None else None)

    tasks = [lambda pos=pos, c=c: one(pos, c) for pos, c in enumerate(cands)]
    done = run_concurrently(tasks) if concurrent else [t() for t in tasks]
    models = {c.name: m for c, (m, _) in zip(cands, done)}
    rows = [r for _, r in done]
    table = spark.createDataFrame(rows, "position int, model string, rmse double, mae double, r2 double")
    best = table.orderBy(F.desc_nulls_last("r2"), "position").first()["model"]
    mets = {r[1]: {"rmse": r[2], "mae": r[3], "r2": r[4]} for r in rows}
    return Trained("regressor", best, models[best], features, mets), table


def evaluation_tables(trained: Trained, test: DataFrame, label: str = "is_error") -> dict[str, DataFrame]:
    """Curve and report tables of a fitted classifier on a test split."""
    pred = positive_score(trained.model.transform(test.withColumn("label", F.col(label).cast("double")))) \
        .select(F.col("label").cast("int").alias("label"), "score",
                F.col("prediction").cast("int").alias("prediction"))
    return {"roc": metrics.roc_points(pred), "pr": metrics.pr_points(pred),
            "confusion": metrics.confusion(pred), "report": metrics.class_report(pred)}


def feature_importance(trained: Trained) -> DataFrame:
    """(feature, importance) of a tree model, most important first; linear
    models report the absolute coefficients."""
    spark = SparkSession.getActiveSession()
    est = trained.model if isinstance(trained.model, NativeModel) else trained.model.stages[-1]
    if isinstance(est, NativeModel):
        vals = est.importances()
    elif hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    elif hasattr(est, "coefficients"):
        vals = [abs(x) for x in est.coefficients.toArray().tolist()]
    else:
        vals = [0.0] * len(trained.features)
    rows = [(f, float(v)) for f, v in zip(trained.features, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# -------------------------------------------------------- save and load

def save_model(trained: Trained, path: str) -> str:
    """Pipeline model plus a sidecar with features and metrics, so a
    reloaded regressor keeps its RMSE for prediction intervals."""
    spark = SparkSession.getActiveSession()
    native = trained.model.kind if isinstance(trained.model, NativeModel) else None
    if native:
        spark.createDataFrame([(trained.model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").json(
            os.path.join(path, "model"))
    else:
        trained.model.write().overwrite().save(os.path.join(path, "model"))
    side = json.dumps({"kind": trained.kind, "best_name": trained.best_name, "features": trained.features,
                       "metrics": trained.metrics, "version": trained.version, "native": native})
    spark.createDataFrame([(side,)], "meta string").coalesce(1).write.mode("overwrite").json(
        os.path.join(path, "meta"))
    return path


def load_model(path: str) -> Trained:
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
    where = os.path.join(path, "model")
    if meta.get("native"):
        model = NativeModel.from_json(meta["native"], spark.read.json(where).first()["model"])
    else:
        model = PipelineModel.load(where)
    return Trained(meta["kind"], meta["best_name"], model, meta["features"], meta["metrics"], meta["version"])


def forest_nodes(model: PipelineModel, path: str) -> Nodes:
    """A Spark ML random forest classifier as flat nodes, from the table of its
    nodes: it is written to ``path`` and read back. Leaves hold the share of
    label 1 over the number of trees, so a walk adds up to the probability. The
    nodes are bounded by the parameters (trees, depth)."""
    spark = SparkSession.getActiveSession()
    model.stages[-1].write().overwrite().save(path)
    rows = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).orderBy("treeID", "id").collect()
    nodes, at = Nodes(), {}
    trees = max((r.treeID for r in rows), default=-1) + 1
    for r in rows:
        total = sum(r.impurityStats)
        at[r.treeID, r.id] = nodes.add_leaf(r.impurityStats[1] / total / trees if total else 0.0, total)
    for r in rows:
        if r.leftChild >= 0:
            nodes.set_split(at[r.treeID, r.id], r.feature, r.threshold, at[r.treeID, r.leftChild], at[r.treeID, r.rightChild])
    nodes.roots = [at[t, 0] for t in range(trees)]
    nodes.depth = max((t.depth for t in model.stages[-1].trees), default=0)
    return nodes


def model_version(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now()).strftime("v%Y%m%d_%H%M%S")


# ------------------------------------------------------------ bookkeeping

def run_row(spark: SparkSession, run_id: str, status: str, num_samples: int, clf: Trained | None,
            reg: Trained | None, started: dt.datetime, completed: dt.datetime) -> DataFrame:
    return spark.createDataFrame([(run_id, status, num_samples, clf.best_name if clf else None,
                                   reg.best_name if reg else None,
                                   json.dumps(clf.metrics) if clf else None,
                                   json.dumps(reg.metrics) if reg else None, started, completed)],
                                 TRAINING_RUNS_SCHEMA)


def model_rows(spark: SparkSession, trained: Trained, path: str, trained_at: dt.datetime) -> DataFrame:
    rows = [(name, trained.kind, trained.version, json.dumps(m), path if name == trained.best_name else None,
             name == trained.best_name, trained_at) for name, m in trained.metrics.items()]
    return spark.createDataFrame(rows, MODEL_METADATA_SCHEMA)


def detector_row(spark: SparkSession, det, version: str, path: str, trained_at: dt.datetime) -> DataFrame:
    about = json.dumps({"n_samples": det.n_samples, "contamination": det.contamination, "baseline": det.baseline})
    return spark.createDataFrame([("isolation_forest" if det.forest else "zscore", "anomaly_detector", version, about,
                                   path, True, trained_at)], MODEL_METADATA_SCHEMA)


def active_models(meta: DataFrame) -> DataFrame:
    """The newest best model per type is the active one (the metadata table
    has one row per trained model, so each type's partition is small)."""
    best = meta.where(F.col("file_path").isNotNull())
    w = Window.partitionBy("model_type").orderBy(F.desc("trained_at"), F.desc("version"))
    return best.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn") \
        .withColumn("is_active", F.lit(True))


def model_health(meta: DataFrame | None, snapshot_available: bool) -> DataFrame:
    """Which model types have an active model; healthy iff a classifier is."""
    spark = SparkSession.getActiveSession()
    if meta is None:
        return spark.createDataFrame([(False, False, False, snapshot_available, False)],
                                     "classifier boolean, regressor boolean, anomaly_detector boolean, "
                                     "reference_data boolean, healthy boolean")
    a = active_models(meta).agg(*[F.max((F.col("model_type") == t).cast("int")).cast("boolean").alias(t)
                                  for t in ("classifier", "regressor", "anomaly_detector")])
    return a.select(*[F.coalesce(F.col(t), F.lit(False)).alias(t) for t in ("classifier", "regressor",
                                                                           "anomaly_detector")],
                    F.lit(snapshot_available).alias("reference_data"),
                    F.coalesce(F.col("classifier"), F.lit(False)).alias("healthy"))
