"""5-minute tumbling window statistics per key. The same function serves a
batch DataFrame (the oracle twin) and a streaming one (with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import exact_mean, round_half_up

WINDOW = "5 minutes"
GRACE = "0 seconds"


def windowed_stats(df: DataFrame, time_col: str = "timestamp", key_col: str = "method",
                   size: str = WINDOW, grace: str | None = None) -> DataFrame:
    """count, error_count and mean response time per (key, tumbling window).
    With ``grace`` set (streaming) a watermark bounds the state and late rows
    are dropped; use ``outputMode('append')`` to emit each window once,
    after it closes."""
    src = df.withWatermark(time_col, grace) if grace is not None else df
    g = src.groupBy(F.window(time_col, size).alias("w"), F.col(key_col).alias("method")).agg(
        F.count(F.lit(1)).alias("count"),
        exact_mean("response_time_ms").alias("mean_response_time"),
        F.sum((F.coalesce(F.col("status_code"), F.lit(200)) >= 400).cast("long")).alias("error_count"))
    return g.select(
        "method",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "count",
        round_half_up(F.col("mean_response_time"), 2).alias("avg_response_time_ms"),
        "error_count",
    )


def encode_windows(stats: DataFrame) -> DataFrame:
    """(key, value) rows for a message sink: key = method, value = JSON text
    {method, window_start, window_end, count, avg_response_time_ms (2dp), error_count}."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    value = F.concat(
        F.lit('{"method":"'), F.col("method"),
        F.lit('","window_start":"'), F.date_format("window_start", iso),
        F.lit('","window_end":"'), F.date_format("window_end", iso),
        F.lit('","count":'), F.col("count").cast("string"),
        F.lit(',"avg_response_time_ms":'), F.format_string("%.2f", F.col("avg_response_time_ms")),
        F.lit(',"error_count":'), F.col("error_count").cast("string"),
        F.lit("}"))
    return stats.select(F.col("method").alias("key"), value.alias("value"))
