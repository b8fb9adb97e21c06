"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Rows are integer vectors x = floor(scale * c). The fit list holds each distinct
x once; A is its rows less their mean. The bidiagonalisation alternates products
A v and A' u. A left vector is never stored: u = A y for a vector y of one entry
per dimension, so a step is one pass over the fit list. Each row block is centred,
gives its part of w = A z, of A'w, of w'w and of its overlaps with all earlier
left vectors, and Spark adds the parts up; what reaches the driver is a few
numbers per dimension. Both sides are reorthogonalised against all earlier
vectors at each step. The singular values of the small bidiagonal matrix are the
deviations, its right vectors turn the basis into the components.

A run ends when the wanted components have settled, or when the basis fills the
row space. One that ends early is followed by a run orthogonal to what has been
found, which shows whether a repeated value was missed.

Cases: rows whose vector is null, empty, or holds null or non-finite entries are
left out; null and repeated ids stay, each row gives its own result. Vectors of
each length are fitted on their own. Components whose deviation is below 1e-10
of the largest one are not returned, so a table of equal vectors gives no rows.
``deviation`` is null where the exact sum leaves 64 bits, and entries beyond
64 bits after scaling stand at the end of that range. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved

COMPONENTS = 4
SETTLED = 1e-14  # of the largest deviation: a component's residual
NOTHING = 1e-11  # of the norm: a new direction that is only rounding
LEAST_DEVIATION = 1e-10  # of the largest


def integer_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, x): the rows that take part, as integer vectors."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))) \
        .select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) for each vector length in a batch."""
    if not len(column):
        return
    dims = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)] if len(rows) < len(dims) else flat.reshape(-1, d)


def blocks_of(vectors: DataFrame) -> DataFrame:
    """(dim, rows, kind, data): a batch of vectors of one length as the bytes of
    a matrix of the narrowest integers that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in matrices(b.column(0)):
                kind = next(k for k in ("<i2", "<i4", "<i8")
                            if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.shape[1]], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([kind]),
                     pa.array([x.astype(kind).tobytes()], pa.binary())], ["dim", "rows", "kind", "data"])

    return vectors.mapInArrow(run, "dim int, rows int, kind string, data binary")


def _each(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for rows, kind, data in zip(*(b.column(c).to_pylist() for c in ("rows", "kind", "data"))):
        yield np.frombuffer(data, kind).reshape(rows, -1)


def exact_sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dim + 1)
        for b in batches:
            for x in _each(b):
                # 32-bit halves, so that the sum of a block stays in 64 bits
                high, low = (x.astype(np.int64) >> 32).sum(axis=0), (x.astype(np.int64) & 0xFFFFFFFF).sum(axis=0)
                total[0] += len(x)
                for j, (h, lo) in enumerate(zip(high.tolist(), low.tolist())):
                    total[j + 1] += (h << 32) + lo
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim + 1), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["pos", "s"])

    got = {r.pos: int(r.s) for r in blocks.mapInArrow(run, "pos int, s decimal(38,0)").groupBy("pos")
           .agg(F.sum("s").alias("s")).collect()}
    return got.get(0, 0), [got.get(j + 1, 0) for j in range(dim)]


class Rows:
    """The centred rows, seen only through sums over all of them."""

    def __init__(self, blocks: DataFrame, dim: int, n: int, sums: list[int]):
        self.blocks, self.dim, self.n = blocks, dim, n
        self.mean = np.array([float(Fraction(s, n)) for s in sums])

    def sum(self, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``part`` (``width`` numbers of a centred block)."""
        mean = self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                for x in _each(b):
                    total += part(x.astype(np.float64) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["pos", "s"])

        out = np.zeros(width)
        for r in self.blocks.mapInArrow(run, "pos int, s double").groupBy("pos").agg(F.sum("s").alias("s")).collect():
            out[r.pos] = r.s
        return out

    def gram(self, r: np.ndarray) -> np.ndarray:
        """A'A r."""
        return self.sum(self.dim, lambda a: a.T @ (a @ r))

    def energy(self) -> float:
        return float(self.sum(1, lambda a: np.array([(a * a).sum()]))[0])

    def product(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """For w = A z: A'w, w'w and (A y)'w."""
        d = self.dim

        def part(a: np.ndarray) -> np.ndarray:
            w = a @ z
            return np.concatenate([a.T @ w, [w @ w], (a @ y).T @ w])

        s = self.sum(d + 1 + y.shape[1], part)
        return s[:d], float(s[d]), s[d + 1:]


def _apart(x: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """x less its shares in orthonormal columns, taken off twice."""
    for _ in (0, 1):
        for q in bases:
            x = x - q @ (q.T @ x)
    return x


def bidiagonalise(a: Rows, norm: float, locked: np.ndarray, bar: float, want: int,
                  rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, bool]:
    """Deviations times sqrt(n) in falling order, their right vectors, and
    whether the row space is used up. Works orthogonally to ``locked``. With a
    ``bar`` it also ends once the largest value is seen to stay below it."""
    d = a.dim
    v, y, back = (np.zeros((d, 0)) for _ in range(3))  # right vectors; u = A y; A'u
    diagonal, above = [], []

    def fresh() -> np.ndarray | None:
        """A direction of the row space outside of the basis."""
        x = _apart(a.gram(_apart(rng.standard_normal(d), locked, v)), locked, v)
        size = np.linalg.norm(x)
        return x / size if size > NOTHING * norm ** 2 else None

    def done(exhausted: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        _, s, qt = np.linalg.svd(np.diag(diagonal) + np.diag(above[:len(diagonal) - 1], 1)) \
            if diagonal else (None, np.zeros(0), np.zeros((0, 0)))
        return s, v @ qt.T, exhausted

    full = d - locked.shape[1]
    now, beta = fresh() if full else None, 0.0
    while now is not None:
        # w = A v - beta u, as A z
        z = now - beta * y[:, -1] if diagonal and beta else now
        aw, ww, overlap = a.product(z, y)
        z, aw = z - y @ overlap, aw - back @ overlap
        alpha = float(np.sqrt(max(ww - overlap @ overlap, 0.0)))
        if alpha <= NOTHING * norm:
            return done(True)
        v = np.column_stack([v, now])
        y, back = np.column_stack([y, z / alpha]), np.column_stack([back, aw / alpha])
        diagonal.append(alpha)
        if len(diagonal) == full:
            return done(True)
        now = _apart(aw / alpha - alpha * now, locked, v)
        beta = float(np.linalg.norm(now))
        if beta <= NOTHING * norm:
            now, beta = fresh(), 0.0
        else:
            now = now / beta
        above.append(beta)
        p, s, _ = np.linalg.svd(np.diag(diagonal) + np.diag(above[:-1], 1))
        residual = beta * np.abs(p[-1])
        if beta and len(s) >= want and (residual[:want] <= SETTLED * s[0]).all():
            return done(False)
        if beta and residual[0] <= 1e-3 * s[0] and s[0] + residual[0] < bar:
            return done(False)
    return done(True)


def principal(a: Rows, norm: float, want: int = COMPONENTS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest singular values of A, and their right vectors."""
    rng = np.random.default_rng(seed)
    values, vectors, used_up = np.zeros(0), np.zeros((a.dim, 0)), norm == 0
    while not used_up:
        bar = values[want - 1] if len(values) >= want else 0.0
        s, q, used_up = bidiagonalise(a, norm, vectors, bar, want, rng)
        if bar and not (len(s) and s[0] >= bar):
            break
        s, q = s[:want], q[:, :want]
        order = np.argsort(-np.concatenate([values, s]), kind="stable")
        values, vectors = np.concatenate([values, s])[order], np.column_stack([vectors, q])[:, order]
    values, vectors = values[:want], vectors[:, :want]
    kept = values > LEAST_DEVIATION * (values[0] if len(values) else 0)
    return values[kept], vectors[:, kept]


@dataclass
class Fit:
    n: int
    sums: list[int]
    mean: np.ndarray
    scaled: np.ndarray  # components over their deviations, one a column
    explained: np.ndarray
    identity_error: float

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n * x - sum)^2."""
        most = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums))
        kind = np.int64 if most ** 2 * x.shape[1] < 2 ** 63 else object
        off = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [s if s < 2 ** 63 else None for s in (off * off).sum(axis=1).tolist()]


def fit(blocks: DataFrame, dim: int, components: int = COMPONENTS) -> Fit:
    """The fit over all vectors of length ``dim``."""
    blocks = blocks.where(F.col("dim") == dim)
    n, sums = exact_sums(blocks, dim)
    a = Rows(blocks, dim, n, sums)
    energy = a.energy()
    values, vectors = principal(a, float(np.sqrt(energy)), components)
    k = len(values)
    scaled = vectors / values * np.sqrt(n) if k else vectors
    moments = a.sum(k + k * k, lambda x: np.concatenate([(w := x @ scaled).sum(axis=0), (w.T @ w).ravel()])) / n \
        if k else np.zeros(0)
    off = np.abs(moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k]) - np.eye(k))
    return Fit(n, sums, a.mean, scaled, values ** 2 / energy if k else values, float(off.max()) if k else 0.0)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = 256) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each
    row that takes part and each component."""
    spark = df.sparkSession
    prepare(spark)
    rows = integer_rows(df, id_col, vector_col, scale)
    blocks = saved(blocks_of(rows.select("x").distinct()), "vector_blocks")
    dims = [r.dim for r in blocks.select("dim").distinct().collect()]
    fits = {d: fit(blocks, d, components) for d in dims}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in matrices(b.column(1)):
                f = fits[x.shape[1]]
                w = (x.astype(np.float64) - f.mean) @ f.scaled
                k = w.shape[1]
                if not k:
                    continue
                every = np.repeat(at, k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(every), f.n, np.int64)), pa.array(f.deviations(x), pa.int64()).take(
                         pa.array(np.repeat(np.arange(len(at)), k))), pa.array(w.ravel()),
                     pa.array(np.tile(f.explained, len(at))), pa.array(np.full(len(every), f.identity_error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("id").alias(id_col), "x").mapInArrow(
        run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, "
             "whitened double, explained double, identity_error double")
