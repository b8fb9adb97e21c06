"""Least squares equals numpy; dependent columns, nulls, tiny tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblog_engine.operators import ols


def frame(spark, rows):
    return spark.createDataFrame(rows, "a double, b int, c double, d double, y double").repartition(3)


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = round(rng.gauss(1000, 3), 3), rng.randrange(4)
        out.append((a, b, a - 2.0 * b + 5.0, round(rng.gauss(0, 1), 3), round(3 * a - b + rng.gauss(0, 1), 3)))
    return out


def test_equals_least_squares(spark):
    data = rows(300)
    odd = [(None, 1, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0, 1.0), (float("nan"), 1, 1.0, 1.0, 1.0), (1.0, 1, 1.0, float("inf"), 1.0),
           (1.0, 1, 1.0, 1.0, None)]
    m = ols.fit(frame(spark, data + odd), ["a", "b", "c", "d"], "y")
    assert m.n == 300 and m.aliased == [False, False, True, False]
    x = np.array([[1, r[0], r[1], r[3]] for r in data])
    want, *_ = np.linalg.lstsq(x, np.array([r[4] for r in data]), rcond=None)
    assert np.allclose([m.intercept, *(m.coefficients[i] for i in (0, 1, 3))], want, rtol=1e-6)
    full = np.array([[1, *r[:4]] for r in data])
    fitted = full @ np.linalg.lstsq(full, np.array([r[4] for r in data]), rcond=None)[0]  # the least-norm solution
    got = [r.s for r in spark.createDataFrame(data, "a double, b int, c double, d double, y double").coalesce(1)
           .select(ols.Linear.from_json(m.to_json()).score().alias("s")).collect()]
    assert np.allclose(got, fitted, atol=1e-5)
    terms = ols.coefficients(m, frame(spark, data)).orderBy("position").collect()
    assert [t.term for t in terms] == ["intercept", "a", "b", "c", "d"] and terms[3].coefficient is None and terms[3].aliased


@pytest.mark.parametrize("n,value", [(0, 0.0), (1, None)])
def test_tiny_tables(spark, n, value):
    data = rows(1)[:n]
    m = ols.fit(frame(spark, data), ["a", "b"], "y")
    assert all(m.aliased) and m.intercept == (value if value is not None else data[0][4])


def test_sums_are_those_of_decimals(spark):
    """Values on ties, whole numbers, products with long texts and large ones: the
    sums that casts to DECIMAL give."""
    rng = random.Random(5)
    data = [(rng.randrange(300_000) * 1.0, rng.random() * 500, rng.randrange(-10**7, 10**7) / 10**7 + 5e-7, rng.choice([0.0, 1.0, 1e12, -2.5e13]))
            for _ in range(3000)] + [(0.0000005, -0.0000005, 1.0000015, 2.0000025)] * 3
    names = ["a", "b", "c", "y"]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names)).repartition(3)
    got = ols.product_sums(df, names[:3], "y").first().asDict()
    total = lambda e: F.sum(e.cast("decimal(38,6)"))
    want = df.agg(F.count(F.lit(1)).alias("n"), *[total(F.col(c)).alias(f"s{i}") for i, c in enumerate(names)],
                  *[total(F.col(c) * F.col(e)).alias(f"p{i}_{j}") for i, c in enumerate(names) for j, e in enumerate(names) if i <= j])
    assert got == want.first().asDict()


def test_no_row_is_cast_to_decimal(spark):
    """Casts of every product to DECIMAL took most of a fit's time."""
    plan = ols.product_sums(frame(spark, rows(40)), ["a", "b"], "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "as decimal" not in plan.split("MapInArrow")[1]
