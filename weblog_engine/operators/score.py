"""Scoring request tables with the kept models, and the audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import exact_sum, risk_band, round_half_up
from .features import request_features, validate_requests
from .metrics import interval_95
from .train import Trained, positive_score


def _require(model: Trained | None, kind: str) -> Trained:
    if model is None:
        raise RuntimeError(f"no trained {kind} available; train first")
    return model


def score_error(requests: DataFrame, model: Trained | None, hourly_frequency: int = 50) -> DataFrame:
    """Error probability (4dp), risk band and model name per valid request;
    rejected requests get probability -1 and band UNKNOWN."""
    m = _require(model, "classifier")
    good, bad = validate_requests(requests, "error")
    feats = request_features(good, hourly_frequency)
    scored = positive_score(m.model.transform(feats))
    ok = scored.select(*requests.columns,
                       round_half_up("score", 4).alias("error_probability"),
                       risk_band("score").alias("risk_level"),
                       F.lit(m.best_name).alias("model_used"))
    rej = bad.select(*requests.columns, F.lit(-1.0).alias("error_probability"),
                     F.lit("UNKNOWN").alias("risk_level"), F.lit(None).cast("string").alias("model_used"))
    return ok.unionByName(rej)


def score_response_time(requests: DataFrame, model: Trained | None, hourly_frequency: int = 50) -> DataFrame:
    """Predicted response time (2dp) with a 95 % interval from the model's
    test RMSE (0.2 * prediction when no RMSE is known)."""
    m = _require(model, "regressor")
    req = requests if "is_error" in requests.columns else requests.withColumn("is_error", F.lit(0))
    req = req.withColumn("is_error", F.coalesce(F.col("is_error"), F.lit(0)))
    good, bad = validate_requests(req, "response_time")
    feats = request_features(good, hourly_frequency)
    pred = m.model.transform(feats)
    rmse = m.best_metrics.get("rmse")
    out = interval_95(pred, "prediction", rmse)
    ok = out.select(*req.columns, round_half_up("prediction", 2).alias("predicted_response_time_ms"),
                    "lower_bound_ms", "upper_bound_ms", "confidence_level",
                    F.lit(m.best_name).alias("model_used"))
    rej = bad.select(*req.columns, F.lit(-1.0).alias("predicted_response_time_ms"),
                     F.lit(None).cast("double").alias("lower_bound_ms"),
                     F.lit(None).cast("double").alias("upper_bound_ms"),
                     F.lit(0.95).alias("confidence_level"), F.lit(None).cast("string").alias("model_used"))
    return ok.unionByName(rej)


def audit_rows(scored: DataFrame, prediction_type: str, version: str, input_cols: list[str],
               result_cols: list[str], latency_col: str | None = None,
               created_col: str | None = None) -> DataFrame:
    """Prediction audit table rows: type, input JSON, result JSON, model
    version, latency, creation time."""
    return scored.select(
        F.lit(prediction_type).alias("prediction_type"),
        F.to_json(F.struct(*input_cols)).alias("input_data"),
        F.to_json(F.struct(*result_cols)).alias("result"),
        F.lit(version).alias("model_version"),
        (F.col(latency_col).cast("double") if latency_col else F.lit(None).cast("double")).alias("latency_ms"),
        (F.col(created_col).cast("timestamp_ntz") if created_col else F.localtimestamp()).alias("created_at"))


def prediction_volume(audit: DataFrame) -> DataFrame:
    """Gauges: all predictions and per type."""
    return audit.agg(F.count(F.lit(1)).alias("predictions_total"),
                     F.count_if(F.col("prediction_type") == "error").alias("error_predictions"),
                     F.count_if(F.col("prediction_type") == "response_time").alias("response_time_predictions"))


def prediction_failures(requests: DataFrame, kind: str = "error") -> DataFrame:
    """Failure counter: per method, how many prediction requests came and how
    many failed validation."""
    from .features import reject_reason
    failed = reject_reason(requests.columns, kind).isNotNull()
    return requests.groupBy("method").agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("failures"))


def prediction_metrics(audit: DataFrame, step: str = "5 minutes") -> DataFrame:
    """Per time step: prediction counters by type and the latency timer
    (count, exact sum, max)."""
    g = audit.groupBy(F.window("created_at", step).alias("w")).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if(F.col("prediction_type") == "error").alias("error_predictions"),
        F.count_if(F.col("prediction_type") == "response_time").alias("response_time_predictions"),
        F.count("latency_ms").alias("latency_count"),
        exact_sum("latency_ms").alias("latency_sum_ms"),
        F.max("latency_ms").alias("latency_max_ms"))
    return g.select(F.col("w.start").alias("window_start"), *[c for c in g.columns if c != "w"])
