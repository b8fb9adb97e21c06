"""Canonical table schemas."""

from pyspark.sql import types as T

WEBLOG_COLUMNS = ["id", "timestamp", "method", "path", "status_code",
                  "response_time_ms", "user_agent", "ip_address", "bytes_sent"]

WEBLOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("status_code", T.IntegerType(), False),
    T.StructField("response_time_ms", T.DoubleType(), False),
    T.StructField("user_agent", T.StringType(), True),
    T.StructField("ip_address", T.StringType(), True),
    T.StructField("bytes_sent", T.IntegerType(), True),
])

# The header names an upload may carry, after normalisation.
KNOWN_HEADER_NAMES = ["timestamp", "method", "path", "status_code",
                      "response_time_ms", "user_agent", "ip_address", "bytes_sent"]
REQUIRED_HEADER_NAMES = ["timestamp", "method", "status_code", "response_time_ms"]

# The five HTTP methods that always get a one-hot column.
KNOWN_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]

# Stream payload: camelCase field names of a log event.
EVENT_JSON_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("statusCode", T.StringType()),
    T.StructField("responseTimeMs", T.StringType()),
    T.StructField("userAgent", T.StringType()),
    T.StructField("ipAddress", T.StringType()),
    T.StructField("bytesSent", T.StringType()),
])

TRAINING_RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("status", T.StringType()),
    T.StructField("num_samples", T.LongType()),
    T.StructField("best_classifier", T.StringType()),
    T.StructField("best_regressor", T.StringType()),
    T.StructField("classifier_metrics", T.StringType()),
    T.StructField("regressor_metrics", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
])

MODEL_METADATA_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType(), False),
    T.StructField("model_type", T.StringType(), False),
    T.StructField("version", T.StringType(), False),
    T.StructField("metrics", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("trained_at", T.TimestampType()),
])

