"""Descriptive statistics of a web-log table (frequencies, moments, exact
order statistics, error rate, peak hour)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import exact_mean, hour_of_day, round_half_up
from .prefix import running_sums


def status_frequency(df: DataFrame) -> DataFrame:
    """(status_code, count, share) ordered by count desc; share rounded 4dp."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    g = df.groupBy("status_code").agg(F.count(F.lit(1)).alias("count"))
    return g.select("status_code", "count",
                    round_half_up(F.col("count") / total.scalar(), 4).alias("share")) \
        .orderBy(F.desc("count"), "status_code")


def method_frequency(df: DataFrame) -> DataFrame:
    return df.groupBy("method").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.desc("count"), "method")


def hour_frequency(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.groupBy(hour_of_day(ts).alias("hour")).agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.desc("count"), "hour")


def peak_hour(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Busiest hour of day and its count; ties go to the lowest hour; 0/0 when empty."""
    h = df.groupBy(hour_of_day(ts).alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    best = h.agg(F.max_by(F.struct("count", (-F.col("hour")).alias("neg")),
                          F.struct("count", (-F.col("hour")).alias("neg"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.neg"), F.lit(0)).cast("int").alias("peak_hour"),
                       F.coalesce(F.col("b.count"), F.lit(0)).cast("long").alias("peak_hour_count"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values with their multiplicity (partial agg map-side)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))


def order_statistics(df: DataFrame, col: str, ranks: dict[str, Column],
                     buckets: int | None = None) -> DataFrame:
    """One row: ``n`` (the number of non-null values) and, for each name, the
    value at a 0-based rank of the sorted values of ``col``. Ranks are
    Column expressions of ``n``. Exact, and no task ever holds more than one range of
    distinct values: values are counted, range-bucketed and prefix-summed."""
    vc = value_counts(df, col)
    ps = running_sums(vc, [col], {"_cum": F.col("_n")}, buckets=buckets, edge_source=df.select(col))
    n = vc.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).scalar()
    with_n = ps.withColumn("n", n)
    aggs = [F.max("n").alias("n")]
    for name, rank in ranks.items():
        hit = (F.col("_cum") - F.col("_n") <= rank) & (F.col("_cum") > rank)
        aggs.append(F.max(F.when(hit, F.col(col))).alias(name))
    return with_n.select("_cum", "_n", col, "n").agg(*aggs)


def median_rank_lo(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def median_rank_hi(n: Column) -> Column:
    return F.floor(n / 2)


def nearest_rank(q: float, n: Column) -> Column:
    """Index ceil(q*n)-1 clamped to [0, n-1] (nearest-rank percentile)."""
    return F.greatest(F.lit(0), F.least(F.ceil(F.lit(q) * n) - 1, n - 1))


def response_time_quantiles(df: DataFrame, col: str = "response_time_ms",
                            buckets: int | None = None) -> DataFrame:
    n = F.col("n")
    os_ = order_statistics(df, col, {
        "_lo": median_rank_lo(n), "_hi": median_rank_hi(n), "_p95": nearest_rank(95 / 100.0, n),
    }, buckets=buckets)
    return os_.select(((F.col("_lo") + F.col("_hi")) / F.lit(2.0)).alias("median"),
                      F.col("_p95").alias("p95"))


def stats_summary(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """One-row summary; an empty table gives zeros."""
    base = df.agg(
        F.count(F.lit(1)).alias("n"),
        exact_mean("response_time_ms").alias("mean"),
        F.stddev_samp("response_time_ms").alias("std"),
        F.sum((F.col("status_code") >= 400).cast("long")).alias("errors"),
    )
    # Each side table enters once, as one struct-valued scalar subquery in
    # an inner projection; the outer projection only reads its fields.
    q = response_time_quantiles(df, buckets=buckets).select(F.struct("median", "p95")).scalar()
    pk = peak_hour(df).select(F.struct("peak_hour", "peak_hour_count")).scalar()
    return base.select("*", q.alias("_q"), pk.alias("_pk")).select(
        F.col("n").alias("total_records"),
        round_half_up(F.coalesce(F.col("mean"), F.lit(0.0)), 2).alias("mean_response_time"),
        round_half_up(F.coalesce(F.col("_q.median"), F.lit(0.0)), 2).alias("median_response_time"),
        round_half_up(F.coalesce(F.col("std"), F.lit(0.0)), 2).alias("std_dev_response_time"),
        round_half_up(F.coalesce(F.col("_q.p95"), F.lit(0.0)), 2).alias("percentile95_response_time"),
        round_half_up(F.coalesce(F.try_divide(F.col("errors"), F.col("n")), F.lit(0.0)), 4)
        .alias("error_rate"),
        F.col("_pk.peak_hour").alias("peak_hour"),
        F.col("_pk.peak_hour_count").alias("peak_hour_count"),
    )


def feature_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: mean and population std (one aggregate pass), long form."""
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for i, f in enumerate(features):
        aggs += [F.avg(F.col(f).cast("double")).alias(f"m{i}"),
                 F.stddev_pop(F.col(f).cast("double")).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"),
                              F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
                     for i, f in enumerate(features)])
    return one.select("n_samples", F.inline(rows)).select(
        "position", "feature", "mean", "std", "n_samples",
        F.lit(len(features)).alias("n_features"))


def describe(df: DataFrame) -> DataFrame:
    """Record count, error rate and the moments of the response time."""
    return df.agg(
        F.count(F.lit(1)).alias("record_count"),
        round_half_up(F.coalesce(F.avg((F.col("status_code") >= 400).cast("double")),
                                 F.lit(0.0)), 4).alias("error_rate"),
        round_half_up(exact_mean("response_time_ms"), 4).alias("mean_response_time"),
        round_half_up(F.stddev_samp("response_time_ms"), 4).alias("std_response_time"),
        F.min("response_time_ms").alias("min_response_time"),
        F.max("response_time_ms").alias("max_response_time"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def stats_document(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """The summary as one document row: the scalars of ``stats_summary``
    plus status-code counts and shares and method counts as maps (built
    from the grouped tables, whose size is bounded by the code and method
    domains). An empty table gives zeros and empty maps."""
    def as_map(grouped: DataFrame, k: str, v: str):
        entries = grouped.agg(F.collect_list(F.struct(F.col(k), F.col(v))).alias("e"))
        return F.map_from_entries(F.coalesce(entries.scalar(), F.array()))
    status = status_frequency(df)
    base = stats_summary(df, buckets)
    return base.select(
        "*",
        as_map(status, "status_code", "count").alias("status_code_frequency_absolute"),
        as_map(status, "status_code", "share").alias("status_code_frequency_relative"),
        as_map(method_frequency(df), "method", "count").alias("method_frequency"),
    )


def describe_columns(df: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Per numeric column: count, mean, sample std, min, 25 %, 50 %, 75 %,
    max, with quartiles linearly interpolated between order statistics at
    position q * (n - 1) (the usual table-describe convention). All columns
    are stacked into (column, value) and handled in one counted, bucketed
    prefix pass; no column is sorted on one task."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    long = df.select(F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    ps = running_sums(vc, ["value"], {"_cum": F.col("_n")}, by=["column"], buckets=buckets,
                      edge_source=long.select("value"), group_domains={"column": len(columns)})
    moments = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), exact_mean("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    j = ps.join(moments.select("column", F.col("count").alias("_cnt")), "column")
    picks = []
    for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
        pos = F.lit(q) * (F.col("_cnt") - 1)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_cum") - F.col("_n") <= rank) & (F.col("_cum") > rank)
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"_{name}_{side}"))
    qs = j.groupBy("column").agg(F.max("_cnt").alias("_cnt"), *picks)
    out = moments.join(qs, "column")

    def interp(q, name):
        pos = F.lit(q) * (F.col("count") - 1)
        frac = pos - F.floor(pos)
        return (F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * frac).alias(name)

    return out.select("column", "count", "mean", "std", "min", interp(0.25, "p25"), interp(0.5, "p50"),
                      interp(0.75, "p75"), "max")
