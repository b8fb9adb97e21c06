"""Driver tables and the ``weblogs`` view derived from ``events``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import WEBLOG_COLUMNS

# Method by user_id % 5, status by event_id % 7 (error events)
# or event_id % 5 (other events). They define the weblogs view over events.
METHOD_BY_USER = ["GET", "POST", "PUT", "DELETE", "PATCH"]
ERROR_STATUS = [400, 401, 403, 404, 500, 502, 503]
OK_STATUS = [200, 201, 204, 301, 302]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def weblogs_from_events(events: DataFrame) -> DataFrame:
    """Project ``events`` onto the canonical web-log schema (narrow, no shuffle)."""
    e = events
    status = F.when(F.col("event_type") == "error", _pick(ERROR_STATUS, F.col("event_id") % 7)) \
        .otherwise(_pick(OK_STATUS, F.col("event_id") % 5))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        _pick(METHOD_BY_USER, F.col("user_id") % 5).alias("method"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("path"),
        status.cast("int").alias("status_code"),
        (F.col("value") * F.lit(10.0)).alias("response_time_ms"),
        F.lit(None).cast("string").alias("user_agent"),
        F.lit(None).cast("string").alias("ip_address"),
        (F.expr("try_cast(regexp_extract(props, '[0-9]+', 0) AS INT)") * F.lit(100))
        .cast("int").alias("bytes_sent"),
    )


def weblogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weblogs_from_events(table(spark, sf_dir, "events")).select(*WEBLOG_COLUMNS)


def read_logs(spark: SparkSession, source: str) -> DataFrame:
    """A stored web-log table (parquet folder or catalog table name) in the
    canonical schema: columns cast to their types, missing optional
    columns as NULL, and NULL ``bytes_sent`` read as 0."""
    from ..schema import WEBLOG_SCHEMA
    df = spark.read.parquet(source) if ("/" in source or source.startswith(".")) else spark.table(source)
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in WEBLOG_SCHEMA.fields:
        src = have.get(f.name)
        c = F.col(src).cast(f.dataType) if src else F.lit(None).cast(f.dataType)
        if f.name == "bytes_sent":
            c = F.coalesce(c, F.lit(0))
        cols.append(c.alias(f.name))
    return df.select(*cols)
