"""Every registered query. Each reads the driver tables (or data Spark
derives from them) in full; the oracle SQL computes the same result in DuckDB
over the same parquet views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources.tables import weblogs
from .registry import register
from .sql import r, with_weblogs

# ---------------------------------------------------------------- A: scans

register("weblogs_scan", with_weblogs() + """
SELECT * FROM weblogs""")(lambda spark, d: weblogs(spark, d))

register("error_events", with_weblogs() + """
SELECT id, "timestamp", method, path, status_code, response_time_ms,
       CAST(status_code >= 500 AS INTEGER) AS is_server_error
FROM weblogs WHERE status_code >= 400""")(
    lambda spark, d: weblogs(spark, d).where(F.col("status_code") >= 400).select(
        "id", "timestamp", "method", "path", "status_code", "response_time_ms",
        (F.col("status_code") >= 500).cast("int").alias("is_server_error")))

register("count_all", with_weblogs() + """
SELECT count(*) AS total_records FROM weblogs""")(
    lambda spark, d: weblogs(spark, d).agg(F.count(F.lit(1)).alias("total_records")))

# ------------------------------------------------------- D: aggregations

register("status_frequency", with_weblogs() + f"""
SELECT status_code, count(*) AS "count",
       {r('count(*) / CAST((SELECT count(*) FROM weblogs) AS DOUBLE)', 4)} AS share
FROM weblogs GROUP BY status_code""")(lambda spark, d: stats.status_frequency(weblogs(spark, d)))

register("method_frequency", with_weblogs() + """
SELECT method, count(*) AS "count" FROM weblogs GROUP BY method""")(
    lambda spark, d: stats.method_frequency(weblogs(spark, d)))

register("hour_frequency", with_weblogs() + """
SELECT CAST(hour("timestamp") AS INTEGER) AS hour, count(*) AS "count"
FROM weblogs GROUP BY 1""")(lambda spark, d: stats.hour_frequency(weblogs(spark, d)))

register("peak_hour", with_weblogs("""h AS (SELECT CAST(hour("timestamp") AS INTEGER) AS hour,
                                         count(*) AS c FROM weblogs GROUP BY 1)""") + """
SELECT CAST(coalesce(max(hour), 0) AS INTEGER) AS peak_hour,
       CAST(coalesce(max(c), 0) AS BIGINT) AS peak_hour_count
FROM (SELECT hour, c FROM h ORDER BY c DESC, hour ASC LIMIT 1)""")(
    lambda spark, d: stats.peak_hour(weblogs(spark, d)))

_SUMMARY_SQL = with_weblogs(
    """v AS (SELECT response_time_ms AS x,
                    row_number() OVER (ORDER BY response_time_ms) - 1 AS k FROM weblogs)""",
    """n AS (SELECT count(*) AS n FROM weblogs)""",
    """q AS (SELECT max(CASE WHEN k = floor((n - 1) / 2) THEN x END) AS lo,
                    max(CASE WHEN k = floor(n / 2) THEN x END) AS hi,
                    max(CASE WHEN k = greatest(0, least(ceil(CAST(0.95 AS DOUBLE) * n) - 1, n - 1))
                        THEN x END) AS p95
             FROM v, n)""",
    """h AS (SELECT CAST(hour("timestamp") AS INTEGER) AS hour, count(*) AS c
             FROM weblogs GROUP BY 1 ORDER BY c DESC, hour ASC LIMIT 1)""",
) + f"""
SELECT count(*) AS total_records,
       {r('coalesce(CAST(sum(CAST(response_time_ms AS DECIMAL(38, 6))) AS DOUBLE) / count(response_time_ms), 0)', 2)} AS mean_response_time,
       {r('coalesce((SELECT (lo + hi) / CAST(2 AS DOUBLE) FROM q), 0)', 2)} AS median_response_time,
       {r('coalesce(stddev_samp(response_time_ms), 0)', 2)} AS std_dev_response_time,
       {r('coalesce((SELECT p95 FROM q), 0)', 2)} AS percentile95_response_time,
       {r('coalesce(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) / CAST(nullif(count(*), 0) AS DOUBLE), 0)', 4)} AS error_rate,
       (SELECT hour FROM h) AS peak_hour,
       (SELECT c FROM h) AS peak_hour_count
FROM weblogs"""

register("stats_summary", _SUMMARY_SQL)(lambda spark, d: stats.stats_summary(weblogs(spark, d)))

register("describe", with_weblogs() + f"""
SELECT count(*) AS record_count,
       {r('coalesce(avg(CASE WHEN status_code >= 400 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0)', 4)} AS error_rate,
       {r('CAST(sum(CAST(response_time_ms AS DECIMAL(38, 6))) AS DOUBLE) / count(response_time_ms)', 4)} AS mean_response_time,
       {r('stddev_samp(response_time_ms)', 4)} AS std_response_time,
       min(response_time_ms) AS min_response_time,
       max(response_time_ms) AS max_response_time,
       min("timestamp") AS first_timestamp,
       max("timestamp") AS last_timestamp
FROM weblogs""")(lambda spark, d: stats.describe(weblogs(spark, d)))

# ------------------------------------------------ C/E: features, windows

from ..operators import anomaly, features  # noqa: E402
from ..functions.scalar import round_half_up  # noqa: E402

_FEATURE_SELECT = """
  CAST(hour("timestamp") AS INTEGER) AS hour,
  CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
  CAST(hour("timestamp") BETWEEN 8 AND 18 AND isodow("timestamp") - 1 <= 4 AS INTEGER) AS is_business_hours,
  CAST(method = 'GET' AS INTEGER) AS method_GET,
  CAST(method = 'POST' AS INTEGER) AS method_POST,
  CAST(method = 'PUT' AS INTEGER) AS method_PUT,
  CAST(method = 'DELETE' AS INTEGER) AS method_DELETE,
  CAST(method = 'PATCH' AS INTEGER) AS method_PATCH,
  CAST(status_code >= 400 AS INTEGER) AS is_error"""

_FEATURES_CTE = f"""feats AS (
  SELECT id, "timestamp", method, status_code, response_time_ms, {_FEATURE_SELECT},
    CAST(sum(CAST(response_time_ms AS DECIMAL(38, 6))) OVER (ORDER BY "timestamp", id
                                ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS DOUBLE)
      / count(response_time_ms) OVER (ORDER BY "timestamp", id
                                ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rolling_avg_response,
    row_number() OVER (PARTITION BY hour("timestamp") ORDER BY "timestamp", id) AS hourly_frequency
  FROM weblogs)"""

_FEATURE_COLS = ["id", "timestamp", "method", "status_code", "response_time_ms"] + \
    features.REGRESSION_FEATURES


def _feature_frame(spark, d):
    f = features.engineer_features(weblogs(spark, d))
    return f.select(*[round_half_up(c, 4).alias(c) if c == "rolling_avg_response" else F.col(c)
                      for c in _FEATURE_COLS])


register("feature_frame", with_weblogs(_FEATURES_CTE) + f"""
SELECT {', '.join('"timestamp"' if c == 'timestamp' else (r(c, 4) + ' AS ' + c if c == 'rolling_avg_response' else c) for c in _FEATURE_COLS)}
FROM feats""")(_feature_frame)


def _rolling_exclusive(spark, d):
    from ..operators import prefix
    logs = weblogs(spark, d).select("id", "timestamp", "response_time_ms")
    idx = prefix.dense_index(logs, ["timestamp", "id"])
    f = prefix.rolling_mean(idx, ["timestamp", "id"], "response_time_ms", 50, "rolling_avg_response",
                            exclude_current=True, indexed=idx)
    return f.select("id", round_half_up("rolling_avg_response", 4).alias("rolling_avg_response"))


register("rolling_avg_exclusive", with_weblogs() + f"""
SELECT id, {r('CAST(sum(CAST(response_time_ms AS DECIMAL(38, 6))) OVER (ORDER BY "timestamp", id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS DOUBLE) / count(response_time_ms) OVER (ORDER BY "timestamp", id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)', 4)}
       AS rolling_avg_response
FROM weblogs""")(_rolling_exclusive)

_MOMENT_FEATURES = features.CLASSIFICATION_FEATURES


def _feature_moments(spark, d):
    f = features.engineer_features(weblogs(spark, d))
    m = stats.feature_moments(f, _MOMENT_FEATURES)
    return m.select("position", "feature", round_half_up("mean", 6).alias("mean"),
                    round_half_up("std", 6).alias("std"), "n_samples", "n_features")


register("feature_moments", with_weblogs(_FEATURES_CTE) + "\n UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS feature, {r(f'avg(CAST({c} AS DOUBLE))', 6)} AS mean,
       {r(f'stddev_pop(CAST({c} AS DOUBLE))', 6)} AS std, count(*) AS n_samples,
       {len(_MOMENT_FEATURES)} AS n_features FROM feats"""
    for i, c in enumerate(_MOMENT_FEATURES)))(_feature_moments)


def _batch_zscore(spark, d):
    z = anomaly.batch_zscore(weblogs(spark, d))
    return z.select("id", round_half_up("z_score", 6).alias("z_score"), "z_anomaly")


register("batch_zscore", with_weblogs(
    "m AS (SELECT avg(response_time_ms) AS m, stddev_pop(response_time_ms) AS s FROM weblogs)") + f"""
SELECT id, {r('abs((response_time_ms - m) / nullif(s, 0))', 6)} AS z_score,
       coalesce(abs((response_time_ms - m) / nullif(s, 0)) > 3, false) AS z_anomaly
FROM weblogs, m""")(_batch_zscore)


def _zscore_detect(spark, d):
    logs = weblogs(spark, d)
    det = anomaly.fit_moments(features.row_features(logs), ["hour", "response_time_ms"])
    res = anomaly.combine(anomaly.zscore_detect(logs, det))
    return res.select("id", round_half_up("z_score", 4).alias("z_score"), "z_anomaly",
                      "z_score_normalized", "is_anomaly", "score")


register("zscore_detect", with_weblogs(
    """m AS (SELECT avg(response_time_ms) AS m,
                    greatest(stddev_pop(response_time_ms), CAST(1e-6 AS DOUBLE)) AS s FROM weblogs)""",
    "z AS (SELECT id, (response_time_ms - m) / s AS z FROM weblogs, m)") + f"""
SELECT id, {r('z', 4)} AS z_score, abs(z) > 3 AS z_anomaly,
       CASE WHEN z > 3 THEN CAST(-1 AS DOUBLE) WHEN z < -3 THEN CAST(1 AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS z_score_normalized,
       abs(z) > 3 AS is_anomaly,
       {r('(CASE WHEN z > 3 THEN CAST(-1 AS DOUBLE) WHEN z < -3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(0 AS DOUBLE)) / 2', 4)} AS score
FROM z""")(_zscore_detect)


def _alerts(spark, d):
    logs = weblogs(spark, d)
    det = anomaly.fit_moments(features.row_features(logs), ["hour", "response_time_ms"])
    a = anomaly.alerts(logs, det)
    return a.select("id", "alert_type", "severity", "score", "acknowledged",
                    F.get_json_object("log_data", "$.path").alias("path"),
                    F.get_json_object("anomaly_details", "$.is_anomaly").alias("is_anomaly"))


register("alert_stream_batch", with_weblogs(
    """m AS (SELECT avg(response_time_ms) AS m,
                    greatest(stddev_pop(response_time_ms), CAST(1e-6 AS DOUBLE)) AS s FROM weblogs)""",
    "z AS (SELECT id, path, (response_time_ms - m) / s AS z FROM weblogs, m)") + f"""
SELECT id, 'anomaly_detected' AS alert_type,
       CASE WHEN abs(z) >= 6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       {r('(CASE WHEN z > 3 THEN CAST(-1 AS DOUBLE) WHEN z < -3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / 2', 4)} AS score,
       false AS acknowledged, path, 'true' AS is_anomaly
FROM z WHERE abs(z) > 3""")(_alerts)


# Requests derived from the log table: each log row asks for a score.
def _requests(spark, d):
    logs = weblogs(spark, d)
    return logs.select("id", F.lower(F.col("method")).alias("method"),
                       F.hour("timestamp").alias("hour"),
                       (F.col("response_time_ms") - F.lit(100.0)).alias("historical_avg_response"),
                       F.weekday("timestamp").alias("day_of_week"))


_REQUESTS_CTE = """requests AS (
  SELECT id, lower(method) AS method, CAST(hour("timestamp") AS INTEGER) AS hour,
         response_time_ms - CAST(100 AS DOUBLE) AS historical_avg_response,
         CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week FROM weblogs)"""


def _request_features(spark, d):
    good, _ = features.validate_requests(_requests(spark, d), "error")
    f = features.request_features(good)
    return f.select("id", "method", "hour", "day_of_week", "is_business_hours",
                    "method_GET", "method_POST", "method_PUT", "method_DELETE", "method_PATCH",
                    "rolling_avg_response", "hourly_frequency")


register("request_features", with_weblogs(_REQUESTS_CTE) + """
SELECT id, upper(trim(method)) AS method, hour, day_of_week,
       CAST(hour BETWEEN 8 AND 18 AND day_of_week <= 4 AS INTEGER) AS is_business_hours,
       CAST(upper(trim(method)) = 'GET' AS INTEGER) AS method_GET,
       CAST(upper(trim(method)) = 'POST' AS INTEGER) AS method_POST,
       CAST(upper(trim(method)) = 'PUT' AS INTEGER) AS method_PUT,
       CAST(upper(trim(method)) = 'DELETE' AS INTEGER) AS method_DELETE,
       CAST(upper(trim(method)) = 'PATCH' AS INTEGER) AS method_PATCH,
       historical_avg_response AS rolling_avg_response,
       CAST(50 AS BIGINT) AS hourly_frequency
FROM requests WHERE historical_avg_response > 0 AND hour BETWEEN 0 AND 23
  AND day_of_week BETWEEN 0 AND 6 AND method IS NOT NULL AND length(trim(method)) > 0""")(
    _request_features)


def _request_rejects(spark, d):
    _, bad = features.validate_requests(_requests(spark, d), "error")
    return bad.select("id", "reject_reason")


register("request_rejects", with_weblogs(_REQUESTS_CTE) + """
SELECT id, 'invalid historical_avg_response' AS reject_reason
FROM requests WHERE NOT (historical_avg_response > 0)""")(_request_rejects)

# --------------------------------------- H: split, weights, evaluation

from ..operators import metrics, split as splitting  # noqa: E402
from ..functions.scalar import risk_band, with_scalar  # noqa: E402


def _labelled(spark, d):
    return weblogs(spark, d).select("id", (F.col("status_code") >= 400).cast("int").alias("label"))


register("split_stratified", with_weblogs(
    """l AS (SELECT id, CAST(status_code >= 400 AS INTEGER) AS label,
                    row_number() OVER (PARTITION BY status_code >= 400
                                       ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) AS pos,
                    count(*) OVER (PARTITION BY status_code >= 400) AS gn FROM weblogs)""") + """
SELECT id, label, CASE WHEN pos <= ceil(CAST(0.2 AS DOUBLE) * gn) THEN 'test' ELSE 'train' END AS split
FROM l""")(lambda spark, d: splitting.split(_labelled(spark, d), by="label")
           .select("id", "label", "split"))

register("split_random", with_weblogs(
    """l AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) AS pos,
                    count(*) OVER () AS gn FROM weblogs)""") + """
SELECT id, CASE WHEN pos <= ceil(CAST(0.2 AS DOUBLE) * gn) THEN 'test' ELSE 'train' END AS split
FROM l""")(lambda spark, d: splitting.split(weblogs(spark, d).select("id")).select("id", "split"))

register("class_weights", with_weblogs(
    "l AS (SELECT CAST(status_code >= 400 AS INTEGER) AS label FROM weblogs)") + """
SELECT label, count(*) AS n_c,
       CAST((SELECT count(*) FROM l) AS DOUBLE) / ((SELECT count(DISTINCT label) FROM l) * count(*)) AS weight
FROM l GROUP BY label""")(lambda spark, d: splitting.class_weights(_labelled(spark, d)))


# Deterministic scorer over the log table: label = is_error,
# score = least(response_time_ms / 5000, 1) (has ties).
def _scored(spark, d):
    return weblogs(spark, d).select(
        "id", (F.col("status_code") >= 400).cast("int").alias("label"),
        F.least(F.col("response_time_ms") / F.lit(5000.0), F.lit(1.0)).alias("score"))


_SCORED_CTE = """scored AS (
  SELECT id, CAST(status_code >= 400 AS INTEGER) AS label,
         least(response_time_ms / CAST(5000 AS DOUBLE), CAST(1 AS DOUBLE)) AS score FROM weblogs)"""
_SC_CTE = """sc AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos,
                           CAST(sum(1 - label) AS BIGINT) AS neg FROM scored GROUP BY score)"""
_TOT_CTE = """tot AS (SELECT CAST(sum(label) AS BIGINT) AS P, CAST(sum(1 - label) AS BIGINT) AS N FROM scored)"""

register("roc_auc", with_weblogs(_SCORED_CTE, _SC_CTE, _TOT_CTE, """pb AS (
  SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                           AND 1 PRECEDING), 0) AS neg_below FROM sc)""") + """
SELECT (SELECT sum(CAST(pos AS DOUBLE) * (CAST(neg_below AS DOUBLE) + CAST(0.5 AS DOUBLE) * neg)) FROM pb)
         / CAST(P * N AS DOUBLE) AS roc_auc, P AS n_pos, N AS n_neg
FROM tot""")(lambda spark, d: metrics.roc_auc(_scored(spark, d)))

register("roc_curve", with_weblogs(_SCORED_CTE, _SC_CTE, _TOT_CTE, """c AS (
  SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM sc)""") + """
SELECT score AS threshold, tp, fp, tp / CAST(P AS DOUBLE) AS tpr, fp / CAST(N AS DOUBLE) AS fpr
FROM c, tot""")(lambda spark, d: metrics.roc_points(_scored(spark, d)))

register("pr_curve", with_weblogs(_SCORED_CTE, _SC_CTE, _TOT_CTE, """c AS (
  SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM sc)""") + """
SELECT score AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(P AS DOUBLE) AS recall
FROM c, tot""")(lambda spark, d: metrics.pr_points(_scored(spark, d)))

# Predicted class: score >= 0.1 (0.5 would predict no errors at all).
_THRESH = 0.1
_PRED_CTE = f"""pr AS (SELECT label, CAST(score >= CAST({_THRESH} AS DOUBLE) AS INTEGER) AS prediction
                      FROM scored)"""


def _pred(spark, d):
    return metrics.predictions(_scored(spark, d), threshold=_THRESH)


register("confusion_matrix", with_weblogs(_SCORED_CTE, _PRED_CTE) + """
SELECT a.label, b.prediction,
       CAST((SELECT count(*) FROM pr WHERE pr.label = a.label AND pr.prediction = b.prediction) AS BIGINT) AS "count"
FROM (VALUES (0), (1)) a(label), (VALUES (0), (1)) b(prediction)""")(
    lambda spark, d: metrics.confusion(_pred(spark, d)))

_REPORT_CTES = [_SCORED_CTE, _PRED_CTE, """c AS (SELECT
   CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS c00,
   CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS c01,
   CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS c10,
   CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS c11 FROM pr)""",
                """k AS (SELECT
   coalesce(c00 / CAST(nullif(c00 + c10, 0) AS DOUBLE), 0) AS p0,
   coalesce(c00 / CAST(nullif(c00 + c01, 0) AS DOUBLE), 0) AS r0,
   coalesce(c11 / CAST(nullif(c11 + c01, 0) AS DOUBLE), 0) AS p1,
   coalesce(c11 / CAST(nullif(c11 + c10, 0) AS DOUBLE), 0) AS r1,
   CAST(c00 + c01 AS DOUBLE) AS s0, CAST(c10 + c11 AS DOUBLE) AS s1,
   CAST(c00 + c01 + c10 + c11 AS DOUBLE) AS n,
   coalesce((c00 + c11) / CAST(nullif(c00 + c01 + c10 + c11, 0) AS DOUBLE), 0) AS acc FROM c)""",
                """f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0,
                                  coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM k)"""]

register("classification_report", with_weblogs(*_REPORT_CTES) + """
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f UNION ALL
SELECT '1', p1, r1, f1, s1 FROM f UNION ALL
SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f UNION ALL
SELECT 'weighted avg', coalesce((p0 * s0 + p1 * s1) / nullif(n, 0), 0),
       coalesce((r0 * s0 + r1 * s1) / nullif(n, 0), 0), coalesce((f0 * s0 + f1 * s1) / nullif(n, 0), 0), n FROM f
UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f""")(
    lambda spark, d: metrics.class_report(_pred(spark, d)))

register("accuracy_f1", with_weblogs(*_REPORT_CTES) + """
SELECT acc AS accuracy, coalesce((f0 * s0 + f1 * s1) / nullif(n, 0), 0) AS f1_weighted FROM f""")(
    lambda spark, d: metrics.accuracy_f1(_pred(spark, d)))


# Deterministic regressor: prediction = 100 + 20 * hour.
def _reg(spark, d):
    return weblogs(spark, d).select(
        "id", F.col("response_time_ms").alias("label"),
        (F.lit(100.0) + F.lit(20.0) * F.hour("timestamp")).alias("prediction"))


_REG_CTE = """reg AS (SELECT id, response_time_ms AS label,
                      CAST(100 AS DOUBLE) + CAST(20 AS DOUBLE) * hour("timestamp") AS prediction FROM weblogs)"""


def _reg_metrics(spark, d):
    m = metrics.regression_metrics(_reg(spark, d))
    return m.select(*[round_half_up(c, 6).alias(c) for c in ("rmse", "mae", "r2")], "n_samples")


register("regression_metrics", with_weblogs(_REG_CTE) + f"""
SELECT {r('sqrt(sum((prediction - label) * (prediction - label)) / count(*))', 6)} AS rmse,
       {r('sum(abs(prediction - label)) / count(*)', 6)} AS mae,
       {r('1 - sum((prediction - label) * (prediction - label)) / (var_pop(label) * count(*))', 6)} AS r2,
       count(*) AS n_samples FROM reg""")(_reg_metrics)


def _interval(spark, d):
    reg = _reg(spark, d)
    rmse = metrics.regression_metrics(reg).select(round_half_up("rmse", 6).alias("rmse"))
    out = metrics.interval_95(with_scalar(reg, "fit", rmse), rmse=F.col("fit.rmse"))
    return out.select("id", round_half_up("prediction", 2).alias("predicted_response_time_ms"),
                      "lower_bound_ms", "upper_bound_ms", "confidence_level")


register("interval_95", with_weblogs(_REG_CTE, f"""m AS (
  SELECT {r('sqrt(sum((prediction - label) * (prediction - label)) / count(*))', 6)} AS rmse FROM reg)""") + f"""
SELECT id, {r('prediction', 2)} AS predicted_response_time_ms,
       {r('greatest(CAST(0 AS DOUBLE), prediction - CAST(1.96 AS DOUBLE) * rmse)', 2)} AS lower_bound_ms,
       {r('prediction + CAST(1.96 AS DOUBLE) * rmse', 2)} AS upper_bound_ms,
       CAST(0.95 AS DOUBLE) AS confidence_level
FROM reg, m""")(_interval)


def _risk(spark, d):
    s = _scored(spark, d)
    return s.select("id", round_half_up("score", 4).alias("error_probability"),
                    risk_band("score").alias("risk_level"))


register("risk_band", with_weblogs(_SCORED_CTE) + f"""
SELECT id, {r('score', 4)} AS error_probability,
       CASE WHEN score < 0.15 THEN 'LOW' WHEN score < 0.40 THEN 'MEDIUM'
            WHEN score < 0.70 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
FROM scored""")(_risk)

# ------------------------------------------------------------ I: drift

from ..operators import drift  # noqa: E402

_DRIFT_COLS = ["status_code", "response_time_ms", "bytes_sent", "hour", "day_of_week",
               "is_business_hours", "is_error"]


def _drift_frames(spark, d):
    f = features.row_features(weblogs(spark, d))
    first = F.dayofmonth("timestamp") <= 15
    return f.where(first), f.where(~first)


_DRIFT_LONG = f"""f AS (SELECT *, CASE WHEN day("timestamp") <= 15 THEN 0 ELSE 1 END AS src,
  {_FEATURE_SELECT} FROM weblogs)""", "long AS (" + " UNION ALL ".join(
    f"SELECT src, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM f" for c in _DRIFT_COLS) + ")"
_DRIFT_PREFIX = ["""counts AS (SELECT "column", value,
     CAST(sum(CASE WHEN src = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_ref,
     CAST(sum(CASE WHEN src = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_cur
   FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2)""",
                 """cum AS (SELECT "column", value,
     sum(n_ref) OVER (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING) AS c_ref,
     sum(n_cur) OVER (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING) AS c_cur,
     lead(value) OVER (PARTITION BY "column" ORDER BY value) AS next_value FROM counts)""",
                 """sizes AS (SELECT "column", CAST(sum(n_ref) AS BIGINT) AS N_ref,
     CAST(sum(n_cur) AS BIGINT) AS N_cur FROM counts GROUP BY 1)""",
                 """sd AS (SELECT "column", stddev_pop(value) AS std_ref FROM long
     WHERE src = 0 AND value IS NOT NULL GROUP BY 1)"""]


def _kolmogorov_sql(lam: str) -> str:
    big = (f"2 * list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, 101), "
           f"lambda k: pow(CAST(-1 AS DOUBLE), k - 1) * exp(CAST(-2 AS DOUBLE) * k * k * {lam} * {lam}))), "
           f"lambda a, b: a + b)")
    small = (f"list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, 101), "
             f"lambda k: exp(-((2 * k - 1) * (2 * k - 1)) * CAST(3.141592653589793 AS DOUBLE) * "
             f"CAST(3.141592653589793 AS DOUBLE) / (CAST(8 AS DOUBLE) * {lam} * {lam})))), lambda a, b: a + b)"
             f" * CAST(2.5066282746310002 AS DOUBLE) / {lam}")
    return (f"least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CASE WHEN {lam} <= 0 THEN CAST(1 AS DOUBLE) "
            f"WHEN {lam} < 1.18 THEN CAST(1 AS DOUBLE) - {small} ELSE {big} END))")


def _ks(spark, d):
    ref, cur = _drift_frames(spark, d)
    k = drift.ks_columns(ref, cur)
    return k.select("column", round_half_up("ks_statistic", 9).alias("ks_statistic"),
                    round_half_up("p_value", 6).alias("p_value"), "drift_detected", "n_ref", "n_cur")


_KS_SQL = with_weblogs(*_DRIFT_LONG, *_DRIFT_PREFIX, """d AS (
  SELECT "column", max(abs(c_ref / CAST(N_ref AS DOUBLE) - c_cur / CAST(N_cur AS DOUBLE))) AS ks_statistic,
         any_value(N_ref) AS N_ref, any_value(N_cur) AS N_cur
  FROM cum JOIN sizes USING ("column") GROUP BY 1)""", """l AS (
  SELECT *, (sqrt(N_ref * N_cur / (N_ref + N_cur)) + CAST(0.12 AS DOUBLE)
             + CAST(0.11 AS DOUBLE) / sqrt(N_ref * N_cur / (N_ref + N_cur))) * ks_statistic AS lam FROM d)""",
                       f"""p AS (SELECT *, {_kolmogorov_sql('lam')} AS p_value FROM l)""")

register("ks_drift", _KS_SQL + f"""
SELECT "column", {r('ks_statistic', 9)} AS ks_statistic, {r('p_value', 6)} AS p_value,
       p_value < 0.05 AS drift_detected, N_ref AS n_ref, N_cur AS n_cur FROM p""")(_ks)


def _dataset_drift(spark, d):
    ref, cur = _drift_frames(spark, d)
    return drift.dataset_drift(drift.ks_columns(ref, cur))


register("dataset_drift", _KS_SQL + """
SELECT count(*) AS n_columns, CAST(sum(CAST(p_value < 0.05 AS INTEGER)) AS BIGINT) AS n_drifted_columns,
       sum(CAST(p_value < 0.05 AS INTEGER)) / CAST(greatest(count(*), 1) AS DOUBLE) AS drift_share,
       sum(CAST(p_value < 0.05 AS INTEGER)) > 0.5 * count(*) AS dataset_drift FROM p""")(_dataset_drift)


def _wasserstein(spark, d):
    ref, cur = _drift_frames(spark, d)
    w = drift.wasserstein_columns(ref, cur)
    return w.select("column", round_half_up("wasserstein", 6).alias("wasserstein"),
                    round_half_up("drift_score", 6).alias("drift_score"), "drift_detected")


register("wasserstein_drift", with_weblogs(*_DRIFT_LONG, *_DRIFT_PREFIX, """w AS (
  SELECT "column", sum(abs(c_ref / CAST(N_ref AS DOUBLE) - c_cur / CAST(N_cur AS DOUBLE))
                       * coalesce(next_value - value, 0)) AS wasserstein
  FROM cum JOIN sizes USING ("column") GROUP BY 1)""") + f"""
SELECT "column", {r('wasserstein', 6)} AS wasserstein,
       {r('wasserstein / nullif(std_ref, 0)', 6)} AS drift_score,
       coalesce(wasserstein / nullif(std_ref, 0) > 0.1, wasserstein > 0) AS drift_detected
FROM w JOIN sd USING ("column")""")(_wasserstein)

# -------------------------------------------------- F: sorts and top-k

register("latest_5000", with_weblogs() + """
SELECT id, "timestamp", method, status_code, response_time_ms FROM weblogs
ORDER BY "timestamp" DESC, id DESC LIMIT 5000""")(
    lambda spark, d: weblogs(spark, d).orderBy(F.desc("timestamp"), F.desc("id")).limit(5000)
    .select("id", "timestamp", "method", "status_code", "response_time_ms"))

register("sample_cap", with_weblogs() + """
SELECT id, method, response_time_ms FROM weblogs
ORDER BY md5(CAST(id AS VARCHAR) || '42'), id LIMIT 200""")(
    lambda spark, d: weblogs(spark, d).orderBy(splitting.hash_order("id", 42), "id").limit(200)
    .select("id", "method", "response_time_ms"))

# ---------------------------------------------- J: streaming batch twin

from ..streaming import windows  # noqa: E402

_WIN_CTE = f"""win AS (
  SELECT method, time_bucket(INTERVAL 5 MINUTE, "timestamp") AS window_start,
         time_bucket(INTERVAL 5 MINUTE, "timestamp") + INTERVAL 5 MINUTE AS window_end,
         count(*) AS "count",
         {r('CAST(sum(CAST(response_time_ms AS DECIMAL(38, 6))) AS DOUBLE) / count(*)', 2)} AS avg_response_time_ms,
         CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS error_count
  FROM weblogs GROUP BY 1, 2, 3)"""

register("tumbling_5m", with_weblogs(_WIN_CTE) + "SELECT * FROM win")(
    lambda spark, d: windows.windowed_stats(weblogs(spark, d)))

register("window_result_json", with_weblogs(_WIN_CTE) + """
SELECT method AS key,
       '{"method":"' || method || '","window_start":"' || strftime(window_start, '%Y-%m-%dT%H:%M:%SZ')
       || '","window_end":"' || strftime(window_end, '%Y-%m-%dT%H:%M:%SZ') || '","count":' || "count"
       || ',"avg_response_time_ms":' || printf('%.2f', avg_response_time_ms)
       || ',"error_count":' || error_count || '}' AS value
FROM win""")(lambda spark, d: windows.encode_windows(windows.windowed_stats(weblogs(spark, d))))

# ------------------------------------------------- A/B: sources, sinks

import threading  # noqa: E402
import uuid  # noqa: E402

from ..session import scratch_path  # noqa: E402
from ..sources import ingest  # noqa: E402

# Upload written from the log table: mixed-case header with spaces, an
# unknown column, timestamps in the four accepted formats (by method) and a
# non-numeric response time on slow server errors (rejected rows).
_TS_FMT = {"GET": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "POST": "yyyy-MM-dd HH:mm:ss",
           "PUT": "yyyy-MM-dd'T'HH:mm:ss", "DELETE": "dd/MM/yyyy HH:mm:ss",
           "PATCH": "yyyy-MM-dd'T'HH:mm"}


_STAGED: dict = {}
_STAGE_LOCK = threading.Lock()


def _staged(kind, spark, d, make):
    """Derived input files (an upload, message files) are written once per
    application and data folder and shared by the queries that read them."""
    key = (kind, spark.sparkContext.applicationId, d)
    with _STAGE_LOCK:
        if key not in _STAGED:
            _STAGED[key] = make(spark, d)
        return _STAGED[key]


def _upload(spark, d) -> str:
    return _staged("upload", spark, d, _write_upload)


def _write_upload(spark, d) -> str:
    logs = weblogs(spark, d)
    ts_text = F.coalesce(*[F.when(F.col("method") == m, F.date_format("timestamp", f))
                           for m, f in _TS_FMT.items()])
    bad = (F.col("status_code") >= 500) & (F.col("response_time_ms") > 1000)
    rt_text = F.when(bad, F.lit("slow")).otherwise(F.col("response_time_ms").cast("string"))
    out = logs.select(ts_text.alias("TimeStamp"), F.lower("method").alias(" Method "),
                      F.col("path").alias("Path"), F.col("status_code").alias("Status Code"),
                      rt_text.alias("response_time_ms"), F.col("id").alias("event_kind"),
                      F.col("bytes_sent").alias("Bytes Sent"))
    path = scratch_path(spark, f"upload-{uuid.uuid4().hex}.csv")
    ingest.write_csv(out, path)
    return path


_UPLOAD_TS = """CASE method WHEN 'GET' THEN "timestamp"
                WHEN 'PATCH' THEN date_trunc('minute', "timestamp")
                ELSE date_trunc('second', "timestamp") END"""


def _csv_ingest(spark, d):
    return ingest.ingest_csv(spark, _upload(spark, d)).good


register("csv_ingest", with_weblogs() + f"""
SELECT {_UPLOAD_TS} AS "timestamp", method, path, status_code, response_time_ms,
       CAST(NULL AS VARCHAR) AS user_agent, CAST(NULL AS VARCHAR) AS ip_address, bytes_sent
FROM weblogs WHERE NOT (status_code >= 500 AND response_time_ms > 1000)""")(_csv_ingest)


def _csv_rejects(spark, d):
    ing = ingest.ingest_csv(spark, _upload(spark, d))
    return ing.rejects.select("timestamp", "method", "status_code", "reject_reason")


register("csv_rejects", with_weblogs() + f"""
SELECT {_UPLOAD_TS} AS "timestamp", method, status_code, 'bad response_time_ms' AS reject_reason
FROM weblogs WHERE status_code >= 500 AND response_time_ms > 1000""")(_csv_rejects)


def _csv_counts(spark, d):
    return ingest.ingest_csv(spark, _upload(spark, d)).counts


register("csv_ingest_counts", with_weblogs() + """
SELECT count(*) FILTER (WHERE NOT (status_code >= 500 AND response_time_ms > 1000)) AS processed,
       count(*) FILTER (WHERE status_code >= 500 AND response_time_ms > 1000) AS failed
FROM weblogs""")(_csv_counts)


def _csv_records(spark, d):
    """An upload whose fields hold quotes and line breaks, cut into records by
    quote parity."""
    from ..sources.records import read_records
    note = F.concat("path", F.lit(', "'), "method", F.lit('"\n"'), F.col("status_code").cast("string"), F.lit('"'))
    path = scratch_path(spark, f"records-{uuid.uuid4().hex}")
    weblogs(spark, d).select("id", note.alias("note")).write.option("escape", '"').option("quoteAll", True).csv(path)
    fields = F.from_csv("record", F.lit("id long, note string"), {"escape": '"', "mode": "FAILFAST"})
    return read_records(spark, path).where("record <> ''").select(fields.alias("f")).select("f.id", "f.note")


register("csv_records", with_weblogs() + """
SELECT id, path || ', "' || method || '"' || chr(10) || '"' || status_code || '"' AS note FROM weblogs""")(_csv_records)


def _event_roundtrip(spark, d):
    msgs = ingest.encode_events(weblogs(spark, d))
    rows, _ = ingest.decode_events(msgs)
    return rows


register("event_roundtrip", with_weblogs() + "SELECT * FROM weblogs")(_event_roundtrip)


def _event_errors(spark, d):
    msgs = ingest.encode_events(weblogs(spark, d))
    rows, _ = ingest.decode_events(msgs)
    return rows.where(F.col("status_code") >= 400).select("id", "method", "status_code")


register("event_error_filter", with_weblogs() + """
SELECT id, method, status_code FROM weblogs WHERE status_code >= 400""")(_event_errors)


def _event_keys(spark, d):
    return ingest.encode_events(weblogs(spark, d)).groupBy("key").agg(
        F.count(F.lit(1)).alias("messages"))


register("event_publish_keys", with_weblogs() + """
SELECT method AS key, count(*) AS messages FROM weblogs GROUP BY method""")(_event_keys)

# ----------------------------------------------------- J: streaming runs

import os  # noqa: E402

from ..streaming import jobs  # noqa: E402


_MESSAGE_PARTS = 3


def _stage_messages(spark, d, root: str, parts: int = _MESSAGE_PARTS) -> str:
    """Messages of the log table (JSON lines) under ``root/staged/_part=p``,
    one part per stretch of days, in event-time order of the parts."""
    msgs = ingest.encode_events(weblogs(spark, d)).select("value") \
        .withColumn("_part", F.least(F.lit(parts - 1),
                                     F.floor((F.dayofmonth(F.get_json_object("value", "$.timestamp")
                                                           .cast("timestamp")) - 1) / 10).cast("int")))
    staged = os.path.join(root, "staged")
    msgs.write.partitionBy("_part").text(staged)
    return staged


def _run_stream(spark, d, start, parts: int = _MESSAGE_PARTS) -> str:
    """Drive a streaming query over the log table's messages as they would
    arrive: the stretches of days are moved (atomic renames) into the
    source folder one after another, and each arrival is processed before
    the next, so event time only moves forward between micro-batches. Each
    run has its own folders (source, output, checkpoint) under a fresh root."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    staged = _stage_messages(spark, d, root, parts)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    src = os.path.join(root, "in")
    fs = path(src).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(src))
    events, _ = jobs.event_stream(jobs.file_source(spark, src))
    q = start(events, root)
    try:
        for p in range(parts):
            part_dir = path(os.path.join(staged, f"_part={p}"))
            if not fs.exists(part_dir):
                continue
            for st in fs.listStatus(part_dir):
                name = st.getPath().getName()
                if name.startswith("part-"):
                    fs.rename(st.getPath(), path(os.path.join(src, f"{p:04d}-{name}")))
            q.processAllAvailable()
    finally:
        q.stop()
    return root


def _stream_windows(spark, d):
    root = _run_stream(spark, d, lambda ev, r: jobs.start_window_job(
        ev, os.path.join(r, "out"), os.path.join(r, "ckpt")))
    out = spark.read.parquet(os.path.join(root, "out"))
    return out.select("method", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "count", "avg_response_time_ms", "error_count")


register("stream_window_5m", with_weblogs(_WIN_CTE) + """
SELECT * FROM win WHERE window_end <= (SELECT max("timestamp") FROM weblogs)""")(_stream_windows)


def _open_windows(spark, d):
    root = _run_stream(spark, d, lambda ev, r: jobs.start_window_job(
        ev, os.path.join(r, "out"), os.path.join(r, "ckpt")))
    out = jobs.open_windows(spark, os.path.join(root, "ckpt"))
    return out.select("method", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "count", "avg_response_time_ms", "error_count")


register("open_windows", with_weblogs(_WIN_CTE) + """
SELECT * FROM win WHERE window_end > (SELECT max("timestamp") FROM weblogs)""")(_open_windows)


def _offset_table(spark, d):
    """The log table's messages arrive in part, then once more from the start."""
    from ..streaming import offsets
    messages = weblogs(spark, d).select(
        F.lit(jobs.RAW_TOPIC).alias("topic"), (F.col("id") % 4).cast("int").alias("partition"),
        F.floor(F.col("id") / 4).alias("offset"), "id", "method", "status_code")
    target = scratch_path(spark, f"offsets-{uuid.uuid4().hex}")
    for part in (messages.where("offset < 200"), messages, messages):
        offsets.append(part, target)
    offsets.compact(spark, target, messages.schema)
    return offsets.read_table(spark, target, messages.schema)


register("offset_table", with_weblogs() + f"""
SELECT '{jobs.RAW_TOPIC}' AS topic, CAST(id % 4 AS INTEGER) AS "partition", id // 4 AS "offset", id, method, status_code
FROM weblogs""")(_offset_table)


def _stream_persist(spark, d):
    root = _run_stream(spark, d, lambda ev, r: jobs.persist_stream(
        ev, os.path.join(r, "table"), os.path.join(r, "ckpt")))
    t = spark.read.parquet(os.path.join(root, "table"))
    return t.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "timestamp" else F.col(c)
                      for c in ["id", "timestamp", "method", "path", "status_code", "response_time_ms",
                                "user_agent", "ip_address", "bytes_sent"]])


register("stream_to_table", with_weblogs() + "SELECT * FROM weblogs")(_stream_persist)


def _stream_alerts(spark, d):
    logs = weblogs(spark, d)
    det = anomaly.fit_moments(features.row_features(logs), ["hour", "response_time_ms"])
    root = _run_stream(spark, d, lambda ev, r: jobs.start_alert_job(
        ev, det, os.path.join(r, "alerts"), os.path.join(r, "ckpt")))
    return spark.read.parquet(os.path.join(root, "alerts")).select("id", "alert_type", "severity", "score")


register("stream_alerts", with_weblogs(
    """m AS (SELECT avg(response_time_ms) AS m,
                    greatest(stddev_pop(response_time_ms), CAST(1e-6 AS DOUBLE)) AS s FROM weblogs)""",
    "z AS (SELECT id, (response_time_ms - m) / s AS z FROM weblogs, m)") + f"""
SELECT id, 'anomaly_detected' AS alert_type,
       CASE WHEN abs(z) >= 6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       {r('(CASE WHEN z > 3 THEN CAST(-1 AS DOUBLE) WHEN z < -3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / 2', 4)} AS score
FROM z WHERE abs(z) > 3""")(_stream_alerts)

# ------------------------------------------- K: metric time-series queries

from ..operators import metricsq  # noqa: E402

_BUCKET_TEXT = ["0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "+Inf"]
_SAMPLES_CTE = [f"""per AS (
  SELECT time_bucket(INTERVAL 1 MINUTE, "timestamp") + INTERVAL 1 MINUTE AS ts, method,
         CAST(count(*) AS DOUBLE) AS n,
         sum(CAST(response_time_ms / CAST(1000 AS DOUBLE) AS DECIMAL(38, 9))) AS s
  FROM weblogs GROUP BY 1, 2)""",
                """cum AS (SELECT ts, method,
         sum(n) OVER (PARTITION BY method ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cn,
         CAST(sum(s) OVER (PARTITION BY method ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cs FROM per)""",
                "perb AS (SELECT time_bucket(INTERVAL 1 MINUTE, \"timestamp\") + INTERVAL 1 MINUTE AS ts, " +
                ", ".join(f"CAST(count(*) FILTER (WHERE response_time_ms / CAST(1000 AS DOUBLE) <= "
                          f"{'CAST(' + repr(b) + ' AS DOUBLE)' if b != float('inf') else 'CAST(\'inf\' AS DOUBLE)'})"
                          f" AS DOUBLE) AS b{i}" for i, b in enumerate(metricsq.LATENCY_BUCKETS)) +
                " FROM weblogs GROUP BY 1)",
                "longb AS (" + " UNION ALL ".join(f"SELECT ts, '{t}' AS le, b{i} AS n FROM perb"
                                                  for i, t in enumerate(_BUCKET_TEXT)) + ")",
                """samples AS (
  SELECT 'http_server_requests_seconds_count' AS metric, 'method=' || method AS series, ts, cn AS value FROM cum
  UNION ALL SELECT 'http_server_requests_seconds_sum', 'method=' || method, ts, cs FROM cum
  UNION ALL SELECT 'http_server_requests_seconds_bucket', 'le=' || le, ts,
                   sum(n) OVER (PARTITION BY le ORDER BY ts ROWS UNBOUNDED PRECEDING) FROM longb)""",
                """inc AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN NULL
                       WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE value END AS increase
  FROM samples WINDOW w AS (PARTITION BY metric, series ORDER BY ts))""",
                """rates AS (SELECT metric, series, ts,
     coalesce(sum(increase) OVER (PARTITION BY metric, series ORDER BY epoch_us(ts)
                                  RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW), 0) / CAST(300 AS DOUBLE) AS rate
  FROM inc)"""]


def _samples(spark, d):
    return metricsq.request_samples(weblogs(spark, d))


def _sample_view(spark, d):
    s = _samples(spark, d)
    return s.select("metric", metricsq.series_key().alias("series"), "ts", round_half_up("value", 6).alias("value"))


register("metric_samples", with_weblogs(*_SAMPLES_CTE[:5]) + f"""
SELECT metric, series, ts, {r('value', 6)} AS value FROM samples""")(_sample_view)


def _counter_rate(spark, d):
    rt = metricsq.counter_rate(_samples(spark, d).where(F.col("metric") == "http_server_requests_seconds_count"))
    return rt.select("series", "ts", round_half_up("rate", 6).alias("rate"),
                     round_half_up(metricsq.scale(F.col("rate"), 60), 6).alias("rate_per_min"))


register("counter_rate_5m", with_weblogs(*_SAMPLES_CTE) + f"""
SELECT series, ts, {r('rate', 6)} AS rate, {r('rate * CAST(60 AS DOUBLE)', 6)} AS rate_per_min
FROM rates WHERE metric = 'http_server_requests_seconds_count'""")(_counter_rate)


def _mean_latency(spark, d):
    m = metricsq.rate_ratio(_samples(spark, d), "http_server_requests_seconds_sum",
                            "http_server_requests_seconds_count", 1000.0)
    return m.select("series", "ts", round_half_up("value", 4).alias("mean_latency_ms"))


register("mean_latency_ms", with_weblogs(*_SAMPLES_CTE) + f"""
SELECT a.series, a.ts, {r('a.rate / nullif(b.rate, 0) * CAST(1000 AS DOUBLE)', 4)} AS mean_latency_ms
FROM rates a JOIN rates b ON a.series = b.series AND a.ts = b.ts
WHERE a.metric = 'http_server_requests_seconds_sum' AND b.metric = 'http_server_requests_seconds_count'""")(
    _mean_latency)


def _hq(q):
    def run(spark, d):
        s = _samples(spark, d).where(F.col("metric") == "http_server_requests_seconds_bucket")
        rates = metricsq.counter_rate(s).withColumn("le", F.col("labels")["le"])
        h = metricsq.histogram_quantile(q, rates)
        return h.select("ts", round_half_up("quantile", 6).alias("quantile"))
    return run


def _hq_sql(q):
    return with_weblogs(*_SAMPLES_CTE, """br AS (
  SELECT ts, CASE WHEN substr(series, 4) = '+Inf' THEN CAST('inf' AS DOUBLE)
                  ELSE CAST(substr(series, 4) AS DOUBLE) END AS le, sum(rate) AS c
  FROM rates WHERE metric = 'http_server_requests_seconds_bucket' GROUP BY 1, 2)""", """b AS (
  SELECT ts, le, c, coalesce(lag(le) OVER (PARTITION BY ts ORDER BY le), 0) AS prev_le,
         coalesce(lag(c) OVER (PARTITION BY ts ORDER BY le), 0) AS prev_c,
         max(c) OVER (PARTITION BY ts) AS total FROM br)""", f"""h AS (
  SELECT ts, arg_min(struct_pack(le := le, prev_le := prev_le, c := c, prev_c := prev_c, total := total), le) AS h
  FROM b WHERE c >= CAST({q} AS DOUBLE) * total AND total > 0 GROUP BY ts)""") + f"""
SELECT ts, {r(f"CASE WHEN h.le = CAST('inf' AS DOUBLE) THEN h.prev_le ELSE coalesce(h.prev_le + (h.le - h.prev_le) * ((CAST({q} AS DOUBLE) * h.total - h.prev_c) / nullif(h.c - h.prev_c, 0)), h.le) END", 6)} AS quantile
FROM h"""


register("histogram_p95", _hq_sql(0.95))(_hq(0.95))
register("histogram_p99", _hq_sql(0.99))(_hq(0.99))


def _instant(spark, d):
    return metricsq.instant_values(_samples(spark, d)).select(
        "metric", "series", round_half_up("value", 6).alias("value"), "state")


register("instant_values", with_weblogs(*_SAMPLES_CTE[:5]) + f"""
SELECT metric, series, {r("arg_max(value, ts)", 6)} AS value,
       CASE WHEN metric = 'up' THEN CASE WHEN arg_max(value, ts) >= 1 THEN 'UP' ELSE 'DOWN' END END AS state
FROM samples WHERE ts > (SELECT max(ts) FROM samples) - INTERVAL 300 SECOND GROUP BY 1, 2""")(_instant)

# ---------------------------------------------- H/I: scoring records

from ..operators import explain, score  # noqa: E402

# Audit of deterministic scoring (type 'error': every request; type
# 'response_time': requests that did not fail).


def _audit(spark, d):
    s = weblogs(spark, d).withColumn("score", F.least(F.col("response_time_ms") / F.lit(5000.0), F.lit(1.0))) \
        .withColumn("error_probability", round_half_up("score", 4)).withColumn("risk_level", risk_band("score")) \
        .withColumn("latency", F.col("bytes_sent") / F.lit(1000.0))
    err = score.audit_rows(s, "error", "v_fixed", ["method"], ["error_probability", "risk_level"],
                           "latency", "timestamp")
    rt = score.audit_rows(s.where(F.col("status_code") < 400), "response_time", "v_fixed", ["method"],
                          ["error_probability"], "latency", "timestamp")
    return err.unionByName(rt)


_AUDIT_CTE = f"""audit AS (
  SELECT 'error' AS prediction_type, method, {r('least(response_time_ms / CAST(5000 AS DOUBLE), CAST(1 AS DOUBLE))', 4)} AS p,
         bytes_sent / CAST(1000 AS DOUBLE) AS latency_ms, "timestamp" AS created_at FROM weblogs
  UNION ALL
  SELECT 'response_time', method, {r('least(response_time_ms / CAST(5000 AS DOUBLE), CAST(1 AS DOUBLE))', 4)},
         bytes_sent / CAST(1000 AS DOUBLE), "timestamp" FROM weblogs WHERE status_code < 400)"""


def _audit_view(spark, d):
    a = _audit(spark, d)
    return a.select("prediction_type", F.get_json_object("input_data", "$.method").alias("method"),
                    F.get_json_object("result", "$.error_probability").cast("double").alias("p"),
                    "model_version", "latency_ms", "created_at")


register("prediction_audit", with_weblogs(_AUDIT_CTE) + """
SELECT prediction_type, method, p, 'v_fixed' AS model_version, latency_ms, created_at FROM audit""")(_audit_view)

register("prediction_volume", with_weblogs(_AUDIT_CTE) + """
SELECT count(*) AS predictions_total, count(*) FILTER (WHERE prediction_type = 'error') AS error_predictions,
       count(*) FILTER (WHERE prediction_type = 'response_time') AS response_time_predictions FROM audit""")(
    lambda spark, d: score.prediction_volume(_audit(spark, d)))

register("prediction_metrics", with_weblogs(_AUDIT_CTE) + """
SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, count(*) AS predictions,
       count(*) FILTER (WHERE prediction_type = 'error') AS error_predictions,
       count(*) FILTER (WHERE prediction_type = 'response_time') AS response_time_predictions,
       count(latency_ms) AS latency_count,
       CAST(sum(CAST(latency_ms AS DECIMAL(38, 6))) AS DOUBLE) AS latency_sum_ms,
       max(latency_ms) AS latency_max_ms
FROM audit GROUP BY 1""")(lambda spark, d: score.prediction_metrics(_audit(spark, d)))

register("prediction_failures", with_weblogs(_REQUESTS_CTE) + """
SELECT method, count(*) AS requests, count(*) FILTER (WHERE NOT (historical_avg_response > 0)) AS failures
FROM requests GROUP BY 1""")(lambda spark, d: score.prediction_failures(_requests(spark, d)))


def _hq_method(spark, d):
    rates = metricsq.counter_rate(metricsq.bucket_samples(weblogs(spark, d), by=("method",))) \
        .withColumn("le", F.col("labels")["le"]).withColumn("method", F.col("labels")["method"])
    h = metricsq.histogram_quantile(0.95, rates, by=["method"])
    return h.select("method", "ts", round_half_up(metricsq.scale(F.col("quantile"), 1000), 4).alias("p95_ms"))


register("histogram_p95_ms_by_method", with_weblogs(
    "perm AS (SELECT method, time_bucket(INTERVAL 1 MINUTE, \"timestamp\") + INTERVAL 1 MINUTE AS ts, " +
    ", ".join(f"CAST(count(*) FILTER (WHERE response_time_ms / CAST(1000 AS DOUBLE) <= "
              f"CAST('{'inf' if b == float('inf') else repr(b)}' AS DOUBLE)) AS DOUBLE) AS b{i}"
              for i, b in enumerate(metricsq.LATENCY_BUCKETS)) + " FROM weblogs GROUP BY 1, 2)",
    "longm AS (" + " UNION ALL ".join(f"SELECT method, ts, '{t}' AS le, b{i} AS n FROM perm"
                                      for i, t in enumerate(_BUCKET_TEXT)) + ")",
    """samples AS (SELECT method, le, ts, sum(n) OVER (PARTITION BY method, le ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value
  FROM longm)""",
    """inc AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN NULL
                       WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE value END AS increase
  FROM samples WINDOW w AS (PARTITION BY method, le ORDER BY ts))""",
    """br AS (SELECT method, ts, CASE WHEN le = '+Inf' THEN CAST('inf' AS DOUBLE) ELSE CAST(le AS DOUBLE) END AS le,
     coalesce(sum(increase) OVER (PARTITION BY method, le ORDER BY epoch_us(ts)
                                  RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW), 0) / CAST(300 AS DOUBLE) AS c
  FROM inc)""",
    """b AS (SELECT method, ts, le, c, coalesce(lag(le) OVER (PARTITION BY method, ts ORDER BY le), 0) AS prev_le,
         coalesce(lag(c) OVER (PARTITION BY method, ts ORDER BY le), 0) AS prev_c,
         max(c) OVER (PARTITION BY method, ts) AS total FROM br)""",
    """h AS (SELECT method, ts, arg_min(struct_pack(le := le, prev_le := prev_le, c := c, prev_c := prev_c, total := total), le) AS h
  FROM b WHERE c >= CAST(0.95 AS DOUBLE) * total AND total > 0 GROUP BY 1, 2)""") + f"""
SELECT method, ts, {r("CASE WHEN h.le = CAST('inf' AS DOUBLE) THEN h.prev_le ELSE coalesce(h.prev_le + (h.le - h.prev_le) * ((CAST(0.95 AS DOUBLE) * h.total - h.prev_c) / nullif(h.c - h.prev_c, 0)), h.le) END * CAST(1000 AS DOUBLE)", 4)} AS p95_ms
FROM h""")(_hq_method)

# --------------------------------------------- A/B/F: scans, sinks, sorts

register("sorted_logs", with_weblogs() + """
SELECT id, "timestamp", method, status_code FROM weblogs ORDER BY "timestamp", id""")(
    lambda spark, d: weblogs(spark, d).orderBy("timestamp", "id").select("id", "timestamp", "method",
                                                                          "status_code"))


def _fallback(spark, d):
    def database():
        raise RuntimeError("no database configured")

    def empty_csv():
        return weblogs(spark, d).where(F.col("status_code") < 0)

    return ingest.load_first_nonempty([database, empty_csv, lambda: weblogs(spark, d)])


register("source_fallback", with_weblogs() + "SELECT * FROM weblogs")(_fallback)


def _append(spark, d):
    logs = weblogs(spark, d)
    path = scratch_path(spark, f"append-{uuid.uuid4().hex}")
    first = F.dayofmonth("timestamp") <= 15
    ingest.append_table(logs.where(first), path)
    ingest.append_table(logs.where(~first), path)
    return spark.read.parquet(path)


register("table_append", with_weblogs() + "SELECT * FROM weblogs")(_append)


def _snapshot(spark, d):
    f = features.row_features(weblogs(spark, d)).select("id", "hour", "day_of_week", "is_error",
                                                        "response_time_ms")
    path = scratch_path(spark, f"snapshot-{uuid.uuid4().hex}")
    n = drift.save_snapshot(f, path)
    return drift.load_snapshot(spark, path).withColumn("snapshot_rows", F.lit(n).cast("long"))


register("reference_snapshot", with_weblogs() + """
SELECT id, CAST(hour("timestamp") AS INTEGER) AS hour, CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
       CAST(status_code >= 400 AS INTEGER) AS is_error, response_time_ms,
       (SELECT count(*) FROM weblogs) AS snapshot_rows FROM weblogs""")(_snapshot)


def _series_filter(spark, d):
    s = metricsq.select_series(_samples(spark, d), "http_server_requests_seconds_bucket", le="+Inf")
    return s.select("ts", F.col("value").alias("requests_total"),
                    metricsq.scale(F.col("value"), 1 / 1000).alias("requests_thousands"))


register("series_filter", with_weblogs(*_SAMPLES_CTE[:5]) + f"""
SELECT ts, value AS requests_total, value * CAST({1 / 1000!r} AS DOUBLE) AS requests_thousands
FROM samples WHERE metric = 'http_server_requests_seconds_bucket' AND series = 'le=+Inf'""")(_series_filter)

_DESC_CTE = """c AS (
  SELECT score, pos, row_number() OVER (ORDER BY score DESC) AS k,
         CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM sc)"""

register("roc_curve_compact", with_weblogs(_SCORED_CTE, _SC_CTE, _TOT_CTE, _DESC_CTE, """n AS (
  SELECT score, tp, fp, lag(tp) OVER w AS tp_p, lead(tp) OVER w AS tp_n, lag(fp) OVER w AS fp_p,
         lead(fp) OVER w AS fp_n FROM c WINDOW w AS (ORDER BY k))""", """kept AS (
  SELECT CAST('inf' AS DOUBLE) AS score, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp
  UNION ALL
  SELECT score, tp, fp FROM n WHERE tp_p IS NULL OR tp_n IS NULL
     OR tp_n - 2 * tp + tp_p <> 0 OR fp_n - 2 * fp + fp_p <> 0)""") + """
SELECT score AS threshold, tp, fp, tp / CAST(P AS DOUBLE) AS tpr, fp / CAST(N AS DOUBLE) AS fpr
FROM kept, tot""")(lambda spark, d: metrics.roc_points(_scored(spark, d), drop_intermediate=True))

register("pr_curve_full_recall", with_weblogs(_SCORED_CTE, _SC_CTE, _TOT_CTE, _DESC_CTE) + """
SELECT score AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(P AS DOUBLE) AS recall
FROM c, tot WHERE tp - pos < P
UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)""")(
    lambda spark, d: metrics.pr_points(_scored(spark, d), stop_at_full_recall=True))

register("pr_curve_endpoint", with_weblogs(_SCORED_CTE, _SC_CTE, _TOT_CTE, _DESC_CTE) + """
SELECT score AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(P AS DOUBLE) AS recall
FROM c, tot
UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)""")(
    lambda spark, d: metrics.pr_points(_scored(spark, d), end_point=True))


def _drift_auto(spark, d):
    ref, cur = _drift_frames(spark, d)
    rep = drift.drift_report(ref, cur, "preset")
    return rep.select("column", "stattest_name", round_half_up("drift_score", 6).alias("drift_score"),
                      "drift_detected", "n_ref", "n_cur")


_KS_CTES = [*_DRIFT_LONG, *_DRIFT_PREFIX, """d AS (
  SELECT "column", max(abs(c_ref / CAST(N_ref AS DOUBLE) - c_cur / CAST(N_cur AS DOUBLE))) AS ks_statistic,
         any_value(N_ref) AS N_ref, any_value(N_cur) AS N_cur
  FROM cum JOIN sizes USING ("column") GROUP BY 1)""", """l AS (
  SELECT *, (sqrt(N_ref * N_cur / (N_ref + N_cur)) + CAST(0.12 AS DOUBLE)
             + CAST(0.11 AS DOUBLE) / sqrt(N_ref * N_cur / (N_ref + N_cur))) * ks_statistic AS lam FROM d)""",
             f"""p AS (SELECT *, {_kolmogorov_sql('lam')} AS p_value FROM l)"""]

register("drift_report_auto", with_weblogs(*_KS_CTES, """w AS (
  SELECT "column", sum(abs(c_ref / CAST(N_ref AS DOUBLE) - c_cur / CAST(N_cur AS DOUBLE))
                       * coalesce(next_value - value, 0)) AS wasserstein, any_value(N_ref) AS N_ref,
         any_value(N_cur) AS N_cur
  FROM cum JOIN sizes USING ("column") GROUP BY 1)""") + f"""
SELECT "column", 'wasserstein_distance_norm' AS stattest_name,
       {r('wasserstein / nullif(std_ref, 0)', 6)} AS drift_score,
       coalesce(wasserstein / nullif(std_ref, 0) > 0.1, wasserstein > 0) AS drift_detected,
       N_ref AS n_ref, N_cur AS n_cur
FROM w JOIN sd USING ("column") WHERE N_ref > 1000
UNION ALL
SELECT "column", 'ks_2samp', {r('p_value', 6)}, p_value < 0.05, N_ref, N_cur FROM p WHERE N_ref <= 1000""")(_drift_auto)


def _document(spark, d):
    """The document's maps as text, entries in order of their keys."""
    def text(m, value):
        entries = F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"].cast("string"), value(e["value"])))
        return F.array_join(F.array_sort(entries), ",")
    doc = stats.stats_document(weblogs(spark, d))
    whole = lambda v: v.cast("string")
    return doc.select(
        "total_records", text("status_code_frequency_absolute", whole).alias("status_absolute"),
        text("status_code_frequency_relative", lambda v: F.round(v * 10000).cast("long").cast("string")).alias("status_per_10000"),
        text("method_frequency", whole).alias("methods"))


register("stats_document", with_weblogs(
    """st AS (SELECT CAST(status_code AS VARCHAR) AS k, count(*) AS c,
                     CAST(floor(count(*) / CAST((SELECT count(*) FROM weblogs) AS DOUBLE) * 10000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS s
              FROM weblogs GROUP BY 1)""",
    "me AS (SELECT method AS k, count(*) AS c FROM weblogs GROUP BY 1)") + """
SELECT (SELECT count(*) FROM weblogs) AS total_records,
       (SELECT string_agg(k || '=' || c, ',' ORDER BY k || '=' || c) FROM st) AS status_absolute,
       (SELECT string_agg(k || '=' || s, ',' ORDER BY k || '=' || s) FROM st) AS status_per_10000,
       (SELECT string_agg(k || '=' || c, ',' ORDER BY k || '=' || c) FROM me) AS methods""")(_document)


def _ks_exact(spark, d):
    ref, cur = _drift_frames(spark, d)
    k = drift.ks_columns(ref, cur, p_method="auto")
    return k.select("column", "ks_statistic", "p_value", "drift_detected", "n_ref", "n_cur")


register("ks_drift_exact")(_ks_exact)

_DESCRIBE_COLS = ["status_code", "response_time_ms", "bytes_sent"]


def _describe_columns(spark, d):
    out = stats.describe_columns(weblogs(spark, d), _DESCRIBE_COLS)
    return out.select("column", "count", *[round_half_up(c, 6).alias(c)
                                            for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


register("describe_columns", with_weblogs("long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM weblogs WHERE {c} IS NOT NULL"
    for c in _DESCRIBE_COLS) + ")") + f"""
SELECT "column", count(*) AS "count",
       {r('CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) / count(value)', 6)} AS mean,
       {r('stddev_samp(value)', 6)} AS std, {r('min(value)', 6)} AS min,
       {r('quantile_cont(value, 0.25)', 6)} AS p25, {r('quantile_cont(value, 0.5)', 6)} AS p50,
       {r('quantile_cont(value, 0.75)', 6)} AS p75, {r('max(value)', 6)} AS max
FROM long GROUP BY 1""")(_describe_columns)
