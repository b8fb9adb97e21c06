"""Least squares from sufficient statistics, over all rows.

One pass gives the number of rows, every column's sum and every product sum (of
decimals, so exactly the same in any order; added up as whole numbers by Arrow
batch); (features + 2)^2 / 2 numbers reach the driver, whatever the table's size. Centred products are taken from them
as fractions, without cancellation, and the normal equations are solved by
elimination in the order of the features. A feature that is a combination of
earlier ones (its remaining product is at most ``DEPENDENT`` of its own) is
aliased: it gets no coefficient. Predictions are those of any least-squares
solution.

Rows with a null, NaN or infinite feature or label take no part; a table without
rows, or with one, gives the mean alone."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from decimal import ROUND_HALF_UP, Decimal, localcontext
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

DEPENDENT = 1e-9
SCALE = 6  # decimals of the sums
BATCH = 8192  # values added up at once,
MOST = 2.0**49  # each less than this as a float


@dataclass
class Linear:
    features: list[str]
    coefficients: list[float]  # 0 for aliased features
    aliased: list[bool]
    intercept: float
    n: int

    def score(self) -> Column:
        out = F.lit(self.intercept)
        for f, b, skip in zip(self.features, self.coefficients, self.aliased):
            if not skip:
                out = out + F.lit(b) * F.col(f).cast("double")
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Linear":
        return Linear(**json.loads(text))


def _whole(df: DataFrame, columns: list[str]) -> DataFrame:
    x = [F.col(c).cast("double") for c in columns]
    fine = F.lit(True)
    for c in x:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(fine).select(*[c.alias(f"x{i}") for i, c in enumerate(x)])


def exact_units(p: np.ndarray, scale: int) -> int:
    """The sum of the values, each rounded half up to ``scale`` decimals of its
    shortest text, in units of the last one. Whole numbers and values that are not
    near a tie are rounded as floats, others as decimals. At most ``BATCH`` values."""
    whole = (p == np.rint(p)) & (np.abs(p) < MOST)
    total = int(p[whole].astype(np.int64).sum()) * 10**scale
    p = p[~whole]
    units = p * 10.0**scale
    near = np.rint(units)
    # a product by 10**scale is off by 2^-53 of it, the shortest text by as much
    sure = (np.abs(units) < MOST) & (0.5 - np.abs(units - near) > np.abs(units) * 2.0**-51)
    total += int(near[sure].astype(np.int64).sum())
    last = Decimal(1).scaleb(-scale)
    return total + sum(int(Decimal(repr(v)).quantize(last, ROUND_HALF_UP).scaleb(scale)) for v in p[~sure].tolist())


def product_sums(df: DataFrame, features: list[str], label: str, scale: int = SCALE) -> DataFrame:
    """One row: n, the sums s<i> and the product sums p<i>_<j> (i <= j) of the
    features and, last, the label, as decimals."""
    k = len(features) + 1
    ship_package(df.sparkSession)
    names = [*[f"s{i}" for i in range(k)], *[f"p{i}_{j}" for i in range(k) for j in range(i, k)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * len(names)
        with localcontext(prec=400):
            for b in batches:
                n += b.num_rows
                for at in range(0, b.num_rows, BATCH):
                    x = [c.to_numpy(zero_copy_only=False) for c in b.slice(at, BATCH).columns]
                    values = chain(x, (x[i] * x[j] for i in range(k) for j in range(i, k)))
                    totals = [t + exact_units(v, scale) for t, v in zip(totals, values)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), *[pa.array([Decimal(t).scaleb(-scale)], pa.decimal128(38, scale)) for t in totals]],
                ["n", *names])

    kind = f"decimal(38,{scale})"
    parts = _whole(df, [*features, label]).mapInArrow(run, ", ".join(["n long", *[f"{c} {kind}" for c in names]]))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0).cast(kind)).alias(c) for c in names])


def solve(n: int, sums: list[Fraction], products: list[list[Fraction]], dependent: float = DEPENDENT):
    """(coefficients or None where aliased, intercept); the label comes last."""
    k = len(sums) - 1
    if not n:
        return [None] * k, 0.0
    c = [[products[i][j] - sums[i] * sums[j] / n for j in range(k + 1)] for i in range(k)]
    own = [c[i][i] for i in range(k)]
    kept = []
    for i in range(k):
        if c[i][i] <= Fraction(dependent) * own[i]:
            continue
        kept.append(i)
        pivot = c[i]
        c = [[v / pivot[i] for v in pivot] if r == i else [v - row[i] / pivot[i] * p for v, p in zip(row, pivot)]
             for r, row in enumerate(c)]
    b = [c[i][k] if i in kept else None for i in range(k)]
    return [None if v is None else float(v) for v in b], \
        float(sums[k] / n - sum((v * sums[i] / n for i, v in enumerate(b) if v is not None), Fraction(0)))


def fit(df: DataFrame, features: list[str], label: str, scale: int = SCALE) -> Linear:
    row = product_sums(df, features, label, scale).first().asDict()
    k = len(features) + 1
    sums = [Fraction(row[f"s{i}"]) for i in range(k)]
    products = [[Fraction(row[f"p{min(i, j)}_{max(i, j)}"]) for j in range(k)] for i in range(k)]
    b, intercept = solve(row["n"], sums, products)
    return Linear(list(features), [v or 0.0 for v in b], [v is None for v in b], intercept, row["n"])


def coefficients(model: Linear, df: DataFrame) -> DataFrame:
    """(position, term, coefficient, aliased): the intercept, then the features."""
    rows = [(0, "intercept", model.intercept, False)]
    rows += [(i + 1, f, None if a else b, a) for i, (f, b, a) in enumerate(zip(model.features, model.coefficients, model.aliased))]
    return df.sparkSession.createDataFrame(rows, "position int, term string, coefficient double, aliased boolean")
