"""Metric time-series queries over a sample table
``(metric, labels map<string,string>, ts, value)``: counter rates with
reset handling, ratio of rates, histogram quantiles and instant values.

Windows are partitioned by series. A series grows with elapsed time and
the scrape interval, not with request volume, so each window partition
stays small even when the traffic behind it is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import with_scalar

# Histogram bucket bounds (seconds) used for latency samples.
LATENCY_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, float("inf")]
RATE_RANGE_SECONDS = 300


def series_key(labels: str = "labels") -> Column:
    """Canonical text of a label set (sorted key=value pairs)."""
    pairs = F.transform(F.map_entries(F.col(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(",", F.array_sort(pairs))


def select_series(samples: DataFrame, metric: str | None = None, **labels: str) -> DataFrame:
    """Series selector: metric name and exact label matches, e.g.
    ``select_series(s, "jvm_memory_used_bytes", area="heap")``."""
    cond = F.lit(True) if metric is None else (F.col("metric") == metric)
    for k, v in labels.items():
        cond = cond & (F.col("labels")[k] == F.lit(v))
    return samples.where(cond)


def _epoch(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def counter_increases(samples: DataFrame) -> DataFrame:
    """Per sample: increase since the previous sample of the same series;
    a drop means the counter restarted, so the increase is the value itself.
    The first sample of a series has no increase (NULL)."""
    s = samples.withColumn("series", series_key()).withColumn("_t", _epoch("ts"))
    w = Window.partitionBy("metric", "series").orderBy("_t")
    prev = F.lag("value").over(w)
    return s.withColumn("increase", F.when(prev.isNull(), F.lit(None).cast("double"))
                        .when(F.col("value") >= prev, F.col("value") - prev)
                        .otherwise(F.col("value")))


def counter_rate(samples: DataFrame, range_seconds: int = RATE_RANGE_SECONDS) -> DataFrame:
    """rate(c[range]) at every sample time: increases of the samples in
    (t - range, t], divided by the range in seconds (no extrapolation to the
    range edges)."""
    inc = counter_increases(samples)
    w = Window.partitionBy("metric", "series").orderBy("_t") \
        .rangeBetween(-(range_seconds * 1_000_000 - 1), 0)
    return inc.select("metric", "series", "labels", "ts",
                      (F.coalesce(F.sum("increase").over(w), F.lit(0.0)) / F.lit(float(range_seconds)))
                      .alias("rate"))


def rate_ratio(samples: DataFrame, numerator: str, denominator: str, scale: float = 1.0,
               range_seconds: int = RATE_RANGE_SECONDS) -> DataFrame:
    """rate(numerator)/rate(denominator)*scale per series and time (e.g. mean
    latency in ms = rate(sum)/rate(count)*1000); NULL when the denominator
    rate is 0."""
    r = counter_rate(samples.where(F.col("metric").isin(numerator, denominator)), range_seconds)
    num = r.where(F.col("metric") == numerator).select("series", "ts", F.col("rate").alias("_n"))
    den = r.where(F.col("metric") == denominator).select("series", "ts", F.col("rate").alias("_d"))
    j = num.join(den, on=["series", "ts"], how="inner")
    return j.select("series", "ts", (F.col("_n") / F.when(F.col("_d") != 0, F.col("_d")) * F.lit(scale))
                    .alias("value"))


def histogram_quantile(q: float, bucket_rates: DataFrame, le_col: str = "le",
                       value_col: str = "rate", by: list[str] | None = None) -> DataFrame:
    """Quantile from cumulative bucket values per (by..., ts): the first
    bucket whose cumulative value reaches q * total, linear inside it; a
    rank falling in the +Inf bucket answers the largest finite bound. ``le``
    may be text ("0.5", "+Inf") or a number. Each group has one row per
    bucket (a small fixed set)."""
    keys = (by or []) + ["ts"]
    b = bucket_rates.withColumn("_le", F.when(F.col(le_col).cast("string").isin("+Inf", "Infinity", "inf"),
                                              F.lit(float("inf"))).otherwise(F.col(le_col).cast("double")))
    b = b.groupBy(*keys, "_le").agg(F.sum(value_col).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_le")
    b = b.withColumn("_prev_le", F.coalesce(F.lag("_le").over(w), F.lit(0.0))) \
        .withColumn("_prev_c", F.coalesce(F.lag("_c").over(w), F.lit(0.0))) \
        .withColumn("_total", F.max("_c").over(Window.partitionBy(*keys)))
    rank = F.lit(q) * F.col("_total")
    hit = b.where((F.col("_c") >= rank) & (F.col("_total") > 0))
    first = hit.groupBy(*keys).agg(F.min_by(F.struct("_le", "_prev_le", "_c", "_prev_c", "_total"), F.col("_le"))
                                   .alias("h"))
    h = F.col("h")
    inside = h["_prev_le"] + (h["_le"] - h["_prev_le"]) * \
        F.try_divide(F.lit(q) * h["_total"] - h["_prev_c"], h["_c"] - h["_prev_c"])
    val = F.when(h["_le"] == float("inf"), h["_prev_le"]).otherwise(F.coalesce(inside, h["_le"]))
    return first.select(*keys, val.alias("quantile"))


def instant_values(samples: DataFrame, at: Column | None = None, lookback_seconds: int = 300) -> DataFrame:
    """Latest sample per series within the look-back window before ``at``
    (default: the newest sample time). Series without a fresh sample are
    absent; ``up`` series also get a state."""
    s = samples.withColumn("series", series_key())
    s = with_scalar(s, "_now", samples.agg(F.max("ts").alias("ts"))) if at is None \
        else s.withColumn("_now", F.struct(at.alias("ts")))
    now = F.col("_now.ts")
    fresh = s.where((F.col("ts") <= now) & (F.col("ts") > now - F.make_dt_interval(secs=F.lit(lookback_seconds))))
    latest = fresh.groupBy("metric", "series").agg(F.max_by("value", "ts").alias("value"))
    state = F.when(F.col("metric") == "up", F.when(F.col("value") >= 1, "UP").otherwise("DOWN"))
    return latest.select("metric", "series", "value", state.alias("state"))


def scale(col: Column, factor: float) -> Column:
    """Unit conversion (bytes -> MiB is 1/1024/1024, s -> ms is 1000, per s -> per min is 60)."""
    return col * F.lit(float(factor))


# ------------------------------------------------ samples from the logs

def request_samples(logs: DataFrame, step: str = "1 minute") -> DataFrame:
    """Counter samples a scraper would record from the request log, one per
    series and step with traffic: request count and latency sum (seconds) per
    method, and cumulative latency buckets."""
    step_ts = F.window("timestamp", step)["end"]
    secs = F.col("response_time_ms") / F.lit(1000.0)
    per = logs.groupBy(step_ts.alias("ts"), "method").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(secs.cast("decimal(38,9)")).alias("s"))
    w = Window.partitionBy("method").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    cum = per.select("ts", "method", F.sum("n").over(w).alias("cn"),
                     F.sum("s").over(w).cast("double").alias("cs"))
    counts = cum.select(F.lit("http_server_requests_seconds_count").alias("metric"),
                        F.create_map(F.lit("method"), "method").alias("labels"), "ts", F.col("cn").alias("value"))
    sums = cum.select(F.lit("http_server_requests_seconds_sum").alias("metric"),
                      F.create_map(F.lit("method"), "method").alias("labels"), "ts", F.col("cs").alias("value"))
    return counts.unionByName(sums).unionByName(bucket_samples(logs, step))


def bucket_samples(logs: DataFrame, step: str = "1 minute", by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative latency bucket counters, labelled by bucket and ``by``."""
    secs = F.col("response_time_ms") / F.lit(1000.0)
    cells = F.array(*[F.struct(F.lit("+Inf" if b == float("inf") else repr(b)).alias("le"),
                               F.count(F.when(secs <= F.lit(b), 1)).cast("double").alias("n"))
                      for b in LATENCY_BUCKETS])
    per = logs.groupBy(F.window("timestamp", step)["end"].alias("ts"), *by).agg(cells.alias("cells")) \
        .select("ts", *by, F.inline("cells"))
    w = Window.partitionBy(*by, "le").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    labels = F.create_map(*[x for c in (*by, "le") for x in (F.lit(c), F.col(c))])
    return per.select(F.lit("http_server_requests_seconds_bucket").alias("metric"), labels.alias("labels"), "ts",
                      F.sum("n").over(w).alias("value"))
