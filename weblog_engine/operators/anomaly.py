"""Anomaly detection: batch z-score, z-score against training moments,
isolation forest (see ``iforest``) and their combination."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up, with_scalar
from ..schema import WEBLOG_COLUMNS
from .stats import feature_moments

Z_THRESHOLD = 3.0
# Fallback moments when no detector was fitted.
FALLBACK_MEAN = 250.0
FALLBACK_STD = 150.0
STD_FLOOR = 1e-6


def batch_zscore(df: DataFrame, col: str = "response_time_ms",
                 threshold: float = Z_THRESHOLD) -> DataFrame:
    """abs((x - mean) / population std) over the whole batch; flag > threshold.
    The moments come from one aggregate used as a scalar subquery (no join);
    a zero std gives NULL z and no flag."""
    m = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))
    x = with_scalar(df, "_st", m)
    z = F.abs(F.try_divide(F.col(col) - F.col("_st.m"), F.when(F.col("_st.s") != 0, F.col("_st.s"))))
    return x.withColumn("z_score", z).drop("_st") \
        .withColumn("z_anomaly", F.coalesce(F.col("z_score") > threshold, F.lit(False)))


@dataclass
class Detector:
    """Fitted anomaly detector: per-feature moments, the z baseline and an
    optional isolation forest."""
    features: list[str]
    means: list[float]
    stds: list[float]
    n_samples: int
    baseline: str = "response_time_ms"
    baseline_mean: float = FALLBACK_MEAN
    baseline_std: float = FALLBACK_STD
    forest: object | None = None          # iforest.ForestModel
    contamination: float = 0.05
    extra: dict = field(default_factory=dict)


def save_detector(spark, det: Detector, path: str) -> str:
    """The detector as one JSON document (its size is that of the forest)."""
    doc = {k: v for k, v in det.__dict__.items() if k != "forest"} | {
        "forest": det.forest.to_json() if det.forest else None}
    spark.createDataFrame([(json.dumps(doc),)], "detector string").coalesce(1).write.mode("overwrite").json(path)
    return path


def load_detector(spark, path: str) -> Detector:
    from .iforest import ForestModel
    doc = json.loads(spark.read.json(path).first()["detector"])
    forest = doc.pop("forest")
    return Detector(**doc, forest=ForestModel.from_json(forest) if forest else None)


def fit_moments(df: DataFrame, features: list[str], baseline: str = "response_time_ms") -> Detector:
    """Mean and population std per feature (one pass; feature-count rows reach
    the driver). ``baseline`` names the column whose moments drive the
    single-request z-score: ``response_time_ms`` (default) or ``hour``, which
    reproduces the reference's use of feature 0."""
    cols = list(dict.fromkeys(features + ([baseline] if baseline not in features else [])))
    rows = feature_moments(df, cols).orderBy("position").collect()
    if not rows or rows[0]["n_samples"] == 0:
        return Detector(features, [], [], 0, baseline)
    by = {r["feature"]: r for r in rows}
    return Detector(
        features=features,
        means=[by[f]["mean"] for f in features],
        stds=[by[f]["std"] for f in features],
        n_samples=rows[0]["n_samples"],
        baseline=baseline,
        baseline_mean=by[baseline]["mean"],
        baseline_std=by[baseline]["std"],
    )


def zscore_columns(x: Column, det: Detector | None, threshold: float = Z_THRESHOLD):
    """(z, flag, normalised) Columns against training moments:
    z = (x - mean) / max(std, 1e-6); normalised = -1 if z > t, +1 if z < -t, else 0."""
    mean = det.baseline_mean if det and det.n_samples else FALLBACK_MEAN
    std = det.baseline_std if det and det.n_samples else FALLBACK_STD
    std = max(std if std is not None else FALLBACK_STD, STD_FLOOR)
    z = (x - F.lit(float(mean))) / F.lit(float(std))
    flag = F.abs(z) > F.lit(threshold)
    norm = F.when(z > threshold, F.lit(-1.0)).when(z < -threshold, F.lit(1.0)).otherwise(F.lit(0.0))
    return z, flag, norm


def zscore_detect(requests: DataFrame, det: Detector | None, col: str = "response_time_ms",
                  threshold: float = Z_THRESHOLD) -> DataFrame:
    z, flag, norm = zscore_columns(F.col(col), det, threshold)
    return requests.withColumn("z_score", z).withColumn("z_anomaly", flag) \
        .withColumn("z_score_normalized", norm)


def combine(scored: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Combine z columns with forest columns (``if_score`` decision value,
    ``if_anomaly``; absent forest = 0.0 / false) into the result shape:
    is_anomaly, score (4dp) and nested details."""
    cols = scored.columns
    if_score = F.col("if_score") if "if_score" in cols else F.lit(0.0)
    if_flag = F.col("if_anomaly") if "if_anomaly" in cols else F.lit(False)
    details = F.struct(
        F.struct(round_half_up(F.col("z_score"), 4).alias("value"),
                 F.col("z_anomaly").alias("is_anomaly"),
                 F.lit(threshold).alias("threshold")).alias("z_score"),
        F.struct(round_half_up(if_score, 4).alias("score"),
                 if_flag.alias("is_anomaly")).alias("isolation_forest"),
    )
    return scored.withColumn("is_anomaly", F.col("z_anomaly") | if_flag) \
        .withColumn("score", round_half_up((F.col("z_score_normalized") + if_score) / 2, 4)) \
        .withColumn("details", details)


# Alert severity rules.
SEVERITY_RULES = ("zscore", "reference")


def severity(rule: str = "zscore") -> Column:
    """``reference``: HIGH if score > 0.8 else MEDIUM. ``zscore`` (default):
    HIGH if abs(z) >= 6 else MEDIUM, because the combined score of a high
    outlier is negative and never exceeds 0.8."""
    if rule == "reference":
        return F.when(F.col("score") > 0.8, "HIGH").otherwise("MEDIUM")
    if rule == "zscore":
        return F.when(F.abs(F.col("z_score")) >= 6.0, "HIGH").otherwise("MEDIUM")
    raise ValueError(f"unknown severity rule {rule}; expected one of {SEVERITY_RULES}")


def alerts(logs: DataFrame, det: Detector | None, rule: str = "zscore",
           forest_scorer=None, hourly_frequency: int = 50, day_of_week: int = 2) -> DataFrame:
    """Score each log (batch or streaming) and keep the anomalous ones as
    alert rows {alert_type, timestamp, severity, log_data, details}.
    Missing values default to method GET, the current hour and 0 ms. With
    ``forest_scorer`` (e.g. ``lambda d: iforest.score(d, forest)``) each log
    also gets the request feature row (weekday ``day_of_week``, rolling mean
    = its response time, hourly frequency constant) scored by the forest."""
    from ..functions.scalar import is_business_hours
    from ..schema import KNOWN_METHODS
    req = logs.select(
        "*",
        F.upper(F.coalesce(F.col("method"), F.lit("GET"))).alias("_m"),
        F.coalesce(F.hour("timestamp"), F.hour(F.current_timestamp())).alias("_h"),
        F.coalesce(F.col("response_time_ms"), F.lit(0.0)).cast("double").alias("_rt"),
    )
    scored = zscore_detect(req, det, "_rt")
    if forest_scorer is not None:
        dow = F.lit(day_of_week)
        feats = {"hour": F.col("_h"), "day_of_week": dow,
                 "is_business_hours": is_business_hours(F.col("_h"), dow),
                 **{f"method_{m}": (F.col("_m") == m).cast("int") for m in KNOWN_METHODS},
                 "rolling_avg_response": F.col("_rt"),
                 "hourly_frequency": F.lit(hourly_frequency).cast("long")}
        x = scored.drop(*[c for c in feats if c in scored.columns])
        scored = forest_scorer(x.select("*", *[v.alias(k) for k, v in feats.items()]))
    res = combine(scored).where(F.col("is_anomaly"))
    # the whole log row, and the whole result
    log_data = F.to_json(F.struct(*[c for c in logs.columns if c in WEBLOG_COLUMNS], F.col("_h").alias("hour")))
    result = F.to_json(F.struct("is_anomaly", "score", "details"))
    return res.select(
        F.lit("anomaly_detected").alias("alert_type"),
        severity(rule).alias("severity"),
        log_data.alias("log_data"),
        result.alias("anomaly_details"),
        F.lit(False).alias("acknowledged"),
        F.localtimestamp().alias("created_at"),
        F.col("timestamp"), F.col("score"), F.col("id"),
    )


def fit_detector(df: DataFrame, features: list[str], baseline: str = "response_time_ms",
                 contamination: float = 0.05, n_trees: int = 200, id_col: str = "id") -> Detector:
    """Training moments plus an isolation forest on ``features``."""
    from . import iforest
    det = fit_moments(df, features, baseline)
    det.forest = iforest.fit_forest(df, features, id_col=id_col, n_trees=n_trees,
                                    contamination=contamination)
    det.contamination = contamination
    return det


def detect_requests(requests: DataFrame, det: Detector) -> DataFrame:
    """Anomaly check of request rows (response_time_ms, method[, hour,
    day_of_week]): the request's own response time stands in for the rolling
    mean; result is is_anomaly, score and nested details per row. An invalid
    row (see ``validate_requests``) is kept with a ``reject_reason`` and no result."""
    from . import iforest
    from .features import request_features, validate_requests
    req = requests if "hour" in requests.columns else requests.withColumn("hour", F.lit(12))
    good, bad = validate_requests(req, "anomaly")
    feats = request_features(good.withColumn("historical_avg_response", F.col("response_time_ms")))
    z = zscore_detect(feats, det)
    scored = iforest.score(z, det.forest) if det.forest is not None else z
    done = combine(scored).withColumn("reject_reason", F.lit(None).cast("string"))
    return done.unionByName(bad, allowMissingColumns=True)


def detect_batch(df: DataFrame, det: Detector, col: str = "response_time_ms") -> DataFrame:
    """Batch check: forest flag (on the detector's features) OR batch z-score
    flag; anomaly_score = forest decision value. No forest: false / 0.0."""
    from . import iforest
    if det is None or det.forest is None:
        return df.withColumn("is_anomaly", F.lit(False)).withColumn("anomaly_score", F.lit(0.0))
    s = batch_zscore(iforest.score(df, det.forest), col)
    return s.withColumn("is_anomaly", F.col("if_anomaly") | F.col("z_anomaly")) \
        .withColumn("anomaly_score", F.col("if_score"))
