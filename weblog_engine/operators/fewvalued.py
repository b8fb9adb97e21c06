"""Drift tests for columns of few values, from one contingency table.

Both tables are stacked and counted by (column, value) with partial aggregation;
all tests read these counts, a row for each value that occurs, and are column
expressions:

* chi-square of the current counts against the reference shares, its p-value the
  regularised upper incomplete gamma function of half the values less one;
* for two values, the two-proportion z test, p-value erfc(|z| / sqrt 2);
* the Jensen-Shannon distance of the two distributions (natural logarithm).

The incomplete gamma function of a whole or half number climbs from exp(-x) or
erfc(sqrt x) in steps of one; erfc is its power series below 2.5 and its
continued fraction above, each a fold over a constant number of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .drift import KS_ALPHA, stacked

TERMS = 60
TURN = 2.5
ROOT_PI = 1.7724538509055159
JS_THRESHOLD = 0.1
MOST_VALUES = 5  # of a column the preset takes for one of few values


def erfc(z: Column) -> Column:
    """The complementary error function of a value that is not negative."""
    down = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    series = F.aggregate(down, F.lit(1.0), lambda acc, n: F.lit(1.0) + F.lit(2.0) * z * z / (F.lit(2.0) * n + 1.0) * acc)
    below = F.lit(1.0) - F.lit(2.0) * z / F.lit(ROOT_PI) * F.exp(-z * z) * series
    fraction = F.aggregate(down, z, lambda acc, n: z + n / F.lit(2.0) / acc)
    return F.when(z < TURN, below).otherwise(F.exp(-z * z) / F.lit(ROOT_PI) / fraction)


def chi_square_sf(x: Column, df: Column) -> Column:
    """P(X >= x) of the chi-square distribution with a whole number of degrees."""
    h = x / F.lit(2.0)
    half = F.floor(df / 2).cast("int")  # steps of one from the start
    down = F.when(half > 1, F.sequence(half - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    even = F.exp(-h) * F.aggregate(down, F.lit(1.0), lambda acc, i: F.lit(1.0) + h / i * acc)
    more = F.exp(-h) * F.sqrt(h) / F.lit(ROOT_PI / 2) * F.aggregate(
        down, F.lit(1.0), lambda acc, i: F.lit(1.0) + h / (i + F.lit(0.5)) * acc)
    odd = erfc(F.sqrt(h)) + F.when(half > 0, more).otherwise(F.lit(0.0))
    return F.when(x.isNull(), F.lit(None)).when(df < 1, F.lit(1.0)).when(h <= 0, F.lit(1.0)).when(df % 2 == 0, even).otherwise(odd)


def contingency(ref: DataFrame, cur: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n_ref, n_cur); nulls and NaN are left out."""
    return stacked(ref, cur, columns).groupBy("column", "value").agg(
        F.count_if(F.col("src") == 0).alias("n_ref"), F.count_if(F.col("src") == 1).alias("n_cur"))


def few_valued_tests(ref: DataFrame, cur: DataFrame, columns: list[str], alpha: float = KS_ALPHA) -> DataFrame:
    """One row a column: n_values, n_ref, n_cur, chi_square, chi_square_p, z and
    z_p (two values only), js_distance, and the preset's choice among them
    (stattest_name, drift_score, drift_detected): z or chi-square up to 1,000
    reference rows, Jensen-Shannon above. A value the reference lacks makes
    chi_square infinite; a side without rows leaves all scores null."""
    counts = contingency(ref, cur, columns)
    totals = counts.groupBy("column").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    c = counts.join(F.broadcast(totals), "column")  # a row a column
    p = F.try_divide(F.col("n_ref"), F.col("t_ref"))
    q = F.try_divide(F.col("n_cur"), F.col("t_cur"))
    expected = p * F.col("t_cur")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))
    pooled = (F.col("n_ref") + F.col("n_cur")) / (F.col("t_ref") + F.col("t_cur"))
    z = F.try_divide(p - q, F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / F.col("t_ref") + F.lit(1.0) / F.col("t_cur"))))
    sides = (F.col("t_ref") > 0) & (F.col("t_cur") > 0)
    cells = c.select("column", "value", "t_ref", "t_cur", F.when(sides, F.when(
        expected > 0, (F.col("n_cur") - expected) * (F.col("n_cur") - expected) / expected).otherwise(float("inf"))).alias("x"),
        F.when(sides, part(p) + part(q)).alias("js"), F.when(sides, z).alias("z"))
    g = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.max("t_ref").alias("n_ref"), F.max("t_cur").alias("n_cur"),
        F.sum("x").alias("chi_square"), F.sqrt(F.when(F.sum("js") < 0, 0.0).otherwise(F.sum("js") / 2)).alias("js_distance"),
        F.max_by("z", "value").alias("z"))
    g = g.withColumn("z", F.when(F.col("n_values") == 2, F.col("z"))) \
        .withColumn("chi_square_p", chi_square_sf(F.col("chi_square"), F.col("n_values") - 1)) \
        .withColumn("z_p", erfc(F.abs("z") / F.sqrt(F.lit(2.0))))
    name = F.when(F.col("n_ref") > 1000, "jensenshannon").when(F.col("n_values") == 2, "z").otherwise("chisquare")
    value = F.when(name == "jensenshannon", F.col("js_distance")).when(name == "z", F.col("z_p")).otherwise(F.col("chi_square_p"))
    return g.select("column", "n_values", "n_ref", "n_cur", "chi_square", "chi_square_p", "z", "z_p", "js_distance",
                    name.alias("stattest_name"), value.alias("drift_score"),
                    F.when(name == "jensenshannon", value > JS_THRESHOLD).otherwise(value < alpha).alias("drift_detected"))
