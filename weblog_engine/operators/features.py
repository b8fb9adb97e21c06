"""Feature engineering over a web-log table and over scoring requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import day_of_week, hour_of_day, is_business_hours, is_error, method_one_hot
from ..schema import KNOWN_METHODS
from .prefix import (BUCKET, add_range_bucket, bucket_window_columns, default_buckets, edge_fix_fits,
                     rolling_mean, rolling_mean_from_buckets, running_sums_multi)

# Ordered feature lists of the two model families.
CLASSIFICATION_FEATURES = [
    "hour", "day_of_week", "is_business_hours",
    "method_GET", "method_POST", "method_PUT", "method_DELETE", "method_PATCH",
    "rolling_avg_response", "hourly_frequency",
]
REGRESSION_FEATURES = CLASSIFICATION_FEATURES + ["is_error"]

ORDER = ["timestamp", "id"]


def classification_features() -> list[str]:
    return list(CLASSIFICATION_FEATURES)


def regression_features() -> list[str]:
    return list(REGRESSION_FEATURES)


def row_features(df: DataFrame, ts: str = "timestamp", extra_methods=None) -> DataFrame:
    """Per-row features (no ordering needed): hour, weekday, business-hour
    flag, method one-hot (the five known methods always present) and is_error."""
    methods = list(KNOWN_METHODS) + [m for m in (extra_methods or []) if m not in KNOWN_METHODS]
    h = hour_of_day(ts)
    d = day_of_week(ts)
    return df.select("*", h.alias("hour"), d.alias("day_of_week"),
                     is_business_hours(h, d).alias("is_business_hours"),
                     *method_one_hot("method", methods),
                     is_error("status_code").alias("is_error"))


def engineer_features(df: DataFrame, window: int = 50, exclude_current: bool = False,
                      chunk_rows: int = 1_000_000, extra_methods=None,
                      buckets: int | None = None) -> DataFrame:
    """All training features. Ordered features follow the global order
    (timestamp, id):

    * ``rolling_avg_response``: mean response time of the last ``window``
      rows (min 1 row), including the current row unless ``exclude_current``;
    * ``hourly_frequency``: 1-based running count of rows with the same hour.

    Both are computed from range buckets of the timestamp (see ``prefix``),
    so no task holds more than one bucket or one chunk of rows, even when a
    single hour of day holds most of the table.
    """
    base = row_features(df, extra_methods=extra_methods)
    b = add_range_bucket(base, ORDER, buckets)
    one = F.lit(1).cast("long")
    specs = [("_idx", one, [], False), ("hourly_frequency", one, ["hour"], True)]
    n_buckets = buckets or default_buckets(base)
    if edge_fix_fits(n_buckets, window):
        # One shuffle: the rolling frame is taken inside the bucket pass and
        # only bucket-edge rows are recomputed from a bounded side set.
        wc = bucket_window_columns(window, "response_time_ms", ORDER, exclude_current=exclude_current)
        x = running_sums_multi(base, ORDER, specs, bucketed=b.select("*", *[c.alias(n) for n, c in wc.items()]),
                               buckets=n_buckets, group_domains={"hour": 24})
        out = rolling_mean_from_buckets(x, "response_time_ms", window, "rolling_avg_response",
                                        exclude_current=exclude_current, chunk_rows=chunk_rows)
        return out.drop("_idx", BUCKET)
    x = running_sums_multi(base, ORDER, specs, bucketed=b, buckets=n_buckets,
                           group_domains={"hour": 24}).drop(BUCKET)
    out = rolling_mean(x, ORDER, "response_time_ms", window, "rolling_avg_response",
                       chunk_rows=chunk_rows, exclude_current=exclude_current, indexed=x)
    return out.drop("_idx")


def request_features(requests: DataFrame, hourly_frequency: int = 50,
                     default_day_of_week: int = 2) -> DataFrame:
    """Feature rows for scoring requests ``(method, hour,
    historical_avg_response[, day_of_week])``. The historical average stands
    in for the rolling mean; the hourly frequency is a constant."""
    cols = requests.columns
    dow = F.coalesce(F.col("day_of_week"), F.lit(default_day_of_week)) \
        if "day_of_week" in cols else F.lit(default_day_of_week)
    m = F.upper(F.trim(F.col("method")))
    out = requests.withColumn("method", m) \
        .withColumn("day_of_week", dow.cast("int")) \
        .withColumn("hour", F.col("hour").cast("int"))
    return out.select(
        "*",
        is_business_hours(F.col("hour"), F.col("day_of_week")).alias("is_business_hours"),
        *method_one_hot("method"),
        F.col("historical_avg_response").cast("double").alias("rolling_avg_response"),
        F.lit(hourly_frequency).cast("long").alias("hourly_frequency"),
    )


def reject_reason(cols: list[str], kind: str = "error"):
    """Why a request row with these columns is invalid, NULL where it is not.
    ``kind`` is ``error`` / ``response_time`` (method, hour 0-23, average > 0,
    weekday 0-6, is_error 0/1) or ``anomaly`` (response time > 0, hour,
    weekday)."""
    checks = []
    if "method" in cols:
        checks.append(("method", F.col("method").isNotNull() & (F.length(F.trim(F.col("method"))) > 0)))
    if "hour" in cols:
        checks.append(("hour", F.col("hour").between(0, 23)))
    if "historical_avg_response" in cols and kind != "anomaly":
        checks.append(("historical_avg_response", F.col("historical_avg_response") > 0))
    if "day_of_week" in cols:
        checks.append(("day_of_week", F.col("day_of_week").isNull() | F.col("day_of_week").between(0, 6)))
    if "is_error" in cols and kind == "response_time":
        checks.append(("is_error", F.col("is_error").isNull() | F.col("is_error").isin(0, 1)))
    if "response_time_ms" in cols and kind == "anomaly":
        checks.append(("response_time_ms", F.col("response_time_ms") > 0))
    reason = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"invalid {name}")).otherwise(reason)
    return reason


def validate_requests(requests: DataFrame, kind: str = "error") -> tuple[DataFrame, DataFrame]:
    """Split requests into (valid, rejected with reason)."""
    tagged = requests.withColumn("_reject", reject_reason(requests.columns, kind))
    good = tagged.where(F.col("_reject").isNull()).drop("_reject")
    bad = tagged.where(F.col("_reject").isNotNull()).withColumnRenamed("_reject", "reject_reason")
    return good, bad
