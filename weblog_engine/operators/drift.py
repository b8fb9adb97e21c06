"""Data drift between a reference and a current table, column by column.

Both tables are tagged and stacked to long form ``(column, value, source)``
in one pass, counted per distinct value, and prefix-summed per column in
value order (bucketed, see ``prefix``). From the prefix table:

* KS statistic  D = max |F_ref - F_cur|, p-value from the Kolmogorov
  distribution (asymptotic; exact small-sample p-values are not reproduced);
* normed Wasserstein distance W1 / std_ref = sum |F_ref - F_cur| * gap / std.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import BUCKET, running_sums

# Decision thresholds.
KS_ALPHA = 0.05
WASSERSTEIN_THRESHOLD = 0.1
DATASET_DRIFT_SHARE = 0.5
KOLMOGOROV_TERMS = 100


def numeric_columns(ref: DataFrame, cur: DataFrame, exclude=("id",),
                    exclude_prefixes=("method_",)) -> list[str]:
    """Numeric (non-boolean) columns present in both tables, in ``ref`` order."""
    cur_num = {f.name for f in cur.schema.fields if isinstance(f.dataType, T.NumericType)}
    return [f.name for f in ref.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name in cur_num
            and f.name not in exclude and not f.name.startswith(tuple(exclude_prefixes))]


def stacked(ref: DataFrame, cur: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, src) with src 0 = reference, 1 = current; NULL and NaN
    values dropped per column."""
    def tag(df, src):
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                          for c in columns])
        return df.select(F.lit(src).alias("src"), F.inline(cells))
    long = tag(ref, 0).unionByName(tag(cur, 1))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _prefix(ref: DataFrame, cur: DataFrame, columns: list[str], buckets=None) -> tuple[DataFrame, DataFrame]:
    long = stacked(ref, cur, columns)
    counts = long.groupBy("column", "value").agg(
        F.sum((F.col("src") == 0).cast("long")).alias("n_ref"),
        F.sum((F.col("src") == 1).cast("long")).alias("n_cur"))
    ps = running_sums(counts, ["value"], {"c_ref": F.col("n_ref"), "c_cur": F.col("n_cur"),
                                          }, by=["column"],
                      buckets=buckets, edge_source=long.select("value"),
                      group_domains={"column": len(columns)})
    # Column-level sizes and moments: one row per column (bounded by schema).
    sizes = long.groupBy("column").agg(
        F.sum((F.col("src") == 0).cast("long")).alias("tot_ref"),
        F.sum((F.col("src") == 1).cast("long")).alias("tot_cur"),
        F.stddev_pop(F.when(F.col("src") == 0, F.col("value"))).alias("std_ref"))
    return ps, sizes


def kolmogorov_sf(lam: Column) -> Column:
    """P(K > lam) for the Kolmogorov distribution, clipped to [0, 1].
    Alternating series for lam >= 1.18, theta-function form below."""
    terms = F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS))
    big = F.aggregate(terms, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) *
                      F.exp(F.lit(-2.0) * k * k * lam * lam)) * 2
    small_cdf = F.aggregate(terms, F.lit(0.0), lambda acc, k: acc + F.exp(
        -((2 * k - 1) * (2 * k - 1)) * F.lit(3.141592653589793 ** 2) / (F.lit(8.0) * lam * lam))) \
        * F.lit(2.5066282746310002) / lam
    p = F.when(lam <= 0, F.lit(1.0)).when(lam < 1.18, F.lit(1.0) - small_cdf).otherwise(big)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


# Up to this sample size the exact two-sample p-value is computed.
KS_EXACT_MAX_N = 10_000


def ks_exact_sf(d: float, m: int, n: int) -> float:
    """P(D >= d) for the two-sided two-sample KS statistic of samples of
    sizes m and n (no ties), by counting monotone lattice paths from (0, 0)
    to (m, n) that stay strictly inside |i/m - j/n| < d. The walk goes
    anti-diagonal by anti-diagonal keeping count(i, j) / C(i + j, i), so the
    values stay in [0, 1]; each diagonal only visits the band where paths
    can be inside (width ~ d * (m + n)), vectorised."""
    import math

    import numpy as np
    if m <= 0 or n <= 0:
        return 1.0
    g = math.gcd(m, n)
    lcm = m // g * n
    h = int(round(d * lcm))          # d is a multiple of 1/lcm
    if h <= 0:
        return 1.0
    bound = h * g                    # outside when |i*n - j*m| >= h*g
    total = m + n
    prev, plo = np.ones(1), 0        # diagonal s = 0: the origin
    for s_ in range(1, total + 1):
        # Only the band |i*(m+n) - s*m| < bound can hold inside paths.
        lo = max(0, s_ - n, (s_ * m - bound) // total)
        hi = min(m, s_, (s_ * m + bound) // total + 1)
        if lo > hi:
            return 1.0
        i = np.arange(lo, hi + 1)
        j = s_ - i
        cur = np.zeros(len(i))
        a = i - 1 - plo              # (i - 1, j) on the previous diagonal
        ok = (i >= 1) & (a >= 0) & (a < len(prev))
        cur[ok] += prev[a[ok]] * (i[ok] / s_)
        b = i - plo                  # (i, j - 1) on the previous diagonal
        ok = (j >= 1) & (b >= 0) & (b < len(prev))
        cur[ok] += prev[b[ok]] * (j[ok] / s_)
        cur[np.abs(i * n - j * m) >= bound] = 0.0
        prev, plo = cur, lo
    inside = prev[m - plo] if 0 <= m - plo < len(prev) else 0.0
    return float(min(1.0, max(0.0, 1.0 - inside)))


def _exact_p_column(use: Column, d: Column, m: Column, n: Column) -> Column:
    """Exact p-value where ``use`` holds, NULL elsewhere. The flag goes into
    the function: Spark evaluates a Python function on every row of its
    input, even under a CASE branch that is not taken."""
    from pyspark.sql import SparkSession
    from pyspark.sql.functions import pandas_udf

    from ..session import ship_package
    ship_package(SparkSession.getActiveSession())

    @pandas_udf("double")
    def exact(flag, dd, mm, nn):
        import pandas as pd
        return pd.Series([ks_exact_sf(float(a), int(b), int(c)) if f else None
                          for f, a, b, c in zip(flag, dd, mm, nn)], dtype="float64")
    return exact(use, d, m, n)


def ks_columns(ref: DataFrame, cur: DataFrame, columns: list[str] | None = None,
               alpha: float = KS_ALPHA, buckets: int | None = None,
               p_method: str = "asymptotic") -> DataFrame:
    """Per column: ks_statistic, p_value, drift_detected (p < alpha), sizes.

    ``p_method``: 'asymptotic' (Kolmogorov distribution with the finite-size
    correction; plain SQL), 'exact' (lattice-path count, see
    ``ks_exact_sf``), or 'auto' (exact while both samples have at most
    10,000 values, asymptotic above, as common statistics libraries do).
    The exact form runs on the per-column result rows only."""
    cols = columns or numeric_columns(ref, cur)
    ps, sizes = _prefix(ref, cur, cols, buckets)
    return _ks_from(ps, sizes, alpha, p_method)


def _ks_from(ps: DataFrame, sizes: DataFrame, alpha: float = KS_ALPHA,
             p_method: str = "asymptotic") -> DataFrame:
    j = ps.join(F.broadcast(sizes), on="column")
    d = j.groupBy("column").agg(F.max(F.abs(F.col("c_ref") / F.col("tot_ref") -
                                            F.col("c_cur") / F.col("tot_cur"))).alias("ks_statistic"))
    d = d.join(F.broadcast(sizes), on="column")
    en = F.sqrt(F.col("tot_ref") * F.col("tot_cur") / (F.col("tot_ref") + F.col("tot_cur")))
    lam = (en + F.lit(0.12) + F.lit(0.11) / en) * F.col("ks_statistic")
    p = kolmogorov_sf(lam)
    if p_method in ("exact", "auto"):
        use = F.lit(True) if p_method == "exact" else \
            (F.greatest(F.col("tot_ref"), F.col("tot_cur")) <= KS_EXACT_MAX_N)
        exact = _exact_p_column(use, F.col("ks_statistic"), F.col("tot_ref"), F.col("tot_cur"))
        p = F.when(use, exact).otherwise(p)
    elif p_method != "asymptotic":
        raise ValueError("p_method must be 'asymptotic', 'exact' or 'auto'")
    out = d.withColumn("p_value", p)
    return out.select("column", "ks_statistic", "p_value",
                      (F.col("p_value") < alpha).alias("drift_detected"),
                      F.col("tot_ref").alias("n_ref"), F.col("tot_cur").alias("n_cur"),
                      F.lit("ks_2samp").alias("stattest_name"), F.col("p_value").alias("drift_score"))


def wasserstein_columns(ref: DataFrame, cur: DataFrame, columns: list[str] | None = None,
                        threshold: float = WASSERSTEIN_THRESHOLD,
                        buckets: int | None = None) -> DataFrame:
    """Per column: W1 distance of the two empirical distributions divided by
    the reference population std; drift if above ``threshold``. The next
    distinct value comes from the bucket, for its last value from a table of
    the buckets' first values (no window over a whole column)."""
    cols = columns or numeric_columns(ref, cur)
    ps, sizes = _prefix(ref, cur, cols, buckets)
    return _wasserstein_from(ps, sizes, threshold)


def _wasserstein_from(ps: DataFrame, sizes: DataFrame,
                      threshold: float = WASSERSTEIN_THRESHOLD) -> DataFrame:
    inside = ps.withColumn("_next", F.lead("value").over(Window.partitionBy(BUCKET, "column").orderBy("value")))
    # a row for each bucket and column
    after = ps.groupBy(BUCKET, "column").agg(F.min("value").alias("_first")).select(
        BUCKET, "column", F.lead("_first").over(Window.partitionBy("column").orderBy(BUCKET)).alias("_after"))
    j = inside.join(after, on=[BUCKET, "column"], how="left").join(F.broadcast(sizes), on="column")
    gap = F.coalesce(F.coalesce("_next", "_after") - F.col("value"), F.lit(0.0))
    w = j.groupBy("column").agg(F.sum(F.abs(F.col("c_ref") / F.col("tot_ref") -
                                            F.col("c_cur") / F.col("tot_cur")) * gap).alias("wasserstein"))
    w = w.join(F.broadcast(sizes), on="column")
    normed = F.try_divide(F.col("wasserstein"), F.when(F.col("std_ref") != 0, F.col("std_ref")))
    return w.select("column", "wasserstein", normed.alias("drift_score"),
                    F.coalesce(normed > threshold, F.col("wasserstein") > 0).alias("drift_detected"),
                    F.lit("wasserstein_distance_norm").alias("stattest_name"),
                    F.col("tot_ref").alias("n_ref"), F.col("tot_cur").alias("n_cur"))


def dataset_drift(per_column: DataFrame, share: float = DATASET_DRIFT_SHARE) -> DataFrame:
    """One row: n_columns, n_drifted_columns, drift_share, dataset_drift
    (strictly more than ``share`` of the columns drifted)."""
    a = per_column.agg(F.count(F.lit(1)).alias("n_columns"),
                       F.coalesce(F.sum(F.col("drift_detected").cast("long")), F.lit(0))
                       .alias("n_drifted_columns"))
    return a.select("n_columns", "n_drifted_columns",
                    (F.col("n_drifted_columns") / F.greatest(F.col("n_columns"), F.lit(1)))
                    .cast("double").alias("drift_share"),
                    (F.col("n_drifted_columns") > F.lit(share) * F.col("n_columns")).alias("dataset_drift"))


# Fixed value: above this many reference rows the preset switches from the
# KS test to the normed Wasserstein distance.
AUTO_KS_MAX_ROWS = 1000
REPORT_COLUMNS = ["column", "stattest_name", "drift_score", "drift_detected", "n_ref", "n_cur"]


def drift_report(ref: DataFrame, cur: DataFrame, method: str = "ks", columns=None,
                 buckets: int | None = None, p_method: str = "asymptotic") -> DataFrame:
    """Per-column drift rows (column, stattest_name, drift_score,
    drift_detected, n_ref, n_cur). ``method``: 'ks', 'wasserstein', or
    'preset' (KS up to 1000 reference rows, normed Wasserstein above, the
    preset rule; decided per column from its non-null reference count)."""
    if method == "ks":
        return ks_columns(ref, cur, columns, buckets=buckets, p_method=p_method).select(*REPORT_COLUMNS)
    if method == "wasserstein":
        return wasserstein_columns(ref, cur, columns, buckets=buckets).select(*REPORT_COLUMNS)
    if method == "preset":
        # One prefix table serves both tests.
        cols = columns or numeric_columns(ref, cur)
        ps, sizes = _prefix(ref, cur, cols, buckets)
        k = _ks_from(ps, sizes, p_method=p_method).select(*REPORT_COLUMNS)
        w = _wasserstein_from(ps, sizes).select(*REPORT_COLUMNS)
        small = F.col("n_ref") <= AUTO_KS_MAX_ROWS
        return k.where(small).unionByName(w.where(~small))
    raise ValueError("method must be 'ks', 'wasserstein' or 'preset'")


def drift_gate(current: DataFrame, reference: DataFrame | None, trainer=None, method: str = "ks",
               columns=None, p_method: str = "asymptotic") -> DataFrame:
    """Retrain decision: compare ``current`` with the reference snapshot;
    on dataset drift call ``trainer()`` (if given). One-row result."""
    spark = current.sparkSession
    schema = "drift_detected boolean, action string, reason string, drift_share double, n_drifted_columns long"
    if reference is None:
        return spark.createDataFrame([(False, "skipped", "no reference snapshot", None, None)], schema)
    if current.isEmpty():
        return spark.createDataFrame([(False, "skipped", "no current data", None, None)], schema)
    summary = dataset_drift(drift_report(reference, current, method, columns, p_method=p_method)).first()
    drifted = bool(summary["dataset_drift"])
    if drifted and trainer is not None:
        trainer()
    action = "retrained" if drifted and trainer is not None else ("retrain" if drifted else "none")
    reason = "dataset drift detected" if drifted else "no significant drift"
    return spark.createDataFrame([(drifted, action, reason, float(summary["drift_share"]),
                                   int(summary["n_drifted_columns"]))], schema)


def current_window(logs: DataFrame, since=None, newest: int | None = None) -> DataFrame:
    """The rows the gate compares with the snapshot: those from ``since`` on
    (default all), or the ``newest`` so many."""
    if newest is not None:
        from ..sources.ingest import latest
        return latest(logs, newest)
    return logs if since is None else logs.where(F.col("timestamp") >= F.lit(since))


def save_snapshot(df: DataFrame, path: str) -> int:
    """Store the training features as the drift reference (parquet)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def load_snapshot(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # none saved yet
            return None
        raise
