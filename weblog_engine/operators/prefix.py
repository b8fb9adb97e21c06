"""Ordered prefix sums and dense positions without a single-partition window.

Spark runs ``Window.orderBy(...)`` with no ``partitionBy`` on one task. Here
the global order is cut into ranges ("buckets") whose edges come from Spark's
range partitioning of the first two order columns, so each bucket holds about
``rows / buckets`` rows no matter how the values are spread or repeated.
Inside a bucket an ordinary partitioned window does the running sum; the sum
of all earlier buckets is added from a per-bucket totals table. That table
has one row per (bucket, group) and is the only thing that reaches the
driver, so its size is bounded by the bucket count, never by the data.

The results are exact: the sampled ranges only choose bucket edges, and
any monotone choice of edges gives the same prefix sums.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import exact
from ..session import shuffle_partitions

BUCKET = "_bucket"
_KEY = "_bucket_key"
_KEY2 = "_bucket_key2"


def _numeric_key(c: Column, dtype: T.DataType) -> Column:
    """Monotone (non-strict) map of an order column onto doubles."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    raise TypeError(f"cannot range-bucket a column of type {dtype.simpleString()}")


def _col_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def default_buckets(df: DataFrame) -> int:
    return max(1, shuffle_partitions(df.sparkSession))


def _order_key(df: DataFrame, name: str) -> Column:
    """The order column as a double, NULL before every number."""
    return F.coalesce(_numeric_key(F.col(name), _col_type(df, name)), F.lit(float("-inf")))


def _range_edges(src: DataFrame, keys: list[str], buckets: int) -> list[tuple]:
    """Largest key of each of ``buckets`` ranges but the last. Spark's range
    partitioner deals out the keys alone by a bounded sample; each range then
    reports its largest key, so no task merges what all others have seen. A
    single key is aggregated as a plain number: the maximum of a struct would
    sort the whole range first."""
    dealt = src.where(~F.isnan(keys[0])).repartitionByRange(buckets, *keys).groupBy(F.spark_partition_id())
    if len(keys) == 1:
        tops = {(r.top,) for r in dealt.agg(F.max(keys[0]).alias("top")).collect()}
    else:
        tops = {tuple(r.top) for r in dealt.agg(F.max(F.struct(*keys)).alias("top")).collect()}
    return sorted(t for t in tops if math.isfinite(t[0]))[:-1]


def add_range_bucket(df: DataFrame, order_cols: str | list[str], buckets: int | None = None,
                     edge_source: DataFrame | None = None) -> DataFrame:
    """Add ``_bucket`` (int), non-decreasing in the order of ``order_cols``.

    NULL sorts first and NaN last, as in Spark's ascending order. Where many
    rows share a value of the first column, a numeric second column divides
    them too. Edges come from ``edge_source`` (default ``df``): when ``df`` is
    an aggregate (e.g. counts per distinct value), pass the raw rows it came
    from. Their distinct keys are dealt out, as ``df`` has a row (a few, with
    groups) for each: a value that most rows share is one key and takes no
    range of its own away from the others. Any edges give exact results."""
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    b = buckets or default_buckets(df)
    if b <= 1:
        return df.withColumn(BUCKET, F.lit(0))
    second = cols[1] if len(cols) > 1 and edge_source is None and \
        isinstance(_col_type(df, cols[1]), T.NumericType) else None
    keyed = df.withColumn(_KEY, _order_key(df, cols[0]))
    keys = [_KEY]
    if second:
        keyed = keyed.withColumn(_KEY2, _order_key(df, second))
        keys.append(_KEY2)
    src = keyed.select(*keys) if edge_source is None else edge_source.select(_order_key(edge_source, cols[0]).alias(_KEY)).distinct()
    edges = _range_edges(src, keys, b)
    firsts = sorted({e[0] for e in edges})
    if not firsts:
        return keyed.withColumn(BUCKET, F.lit(0)).drop(*keys)
    bz = Bucketizer(splits=[float("-inf"), *firsts, float("inf")], inputCol=_KEY, outputCol=BUCKET, handleInvalid="keep")
    # Bucketizer counts the distinct first values up to the key; a value with
    # several edges takes more numbers, one for each of its second values.
    ties = {f: sorted(e[1] for e in edges if e[0] == f) for f in firsts} if second else {}
    ties = {f: x for f, x in ties.items() if len(x) > 1}
    out = bz.transform(keyed).withColumn(BUCKET, F.col(BUCKET).cast("int"))
    if ties:
        before, n = [0], 0  # edges of values so far beyond one each
        for f in firsts:
            n += len(ties.get(f, [0])) - 1
            before.append(n)
        more = F.element_at(F.array(*[F.lit(x) for x in [*before, n]]), F.least(F.col(BUCKET), F.lit(len(firsts))) + 1)
        tied = F.coalesce(*[F.when(F.col(_KEY) == f, F.size(F.filter(
            F.array(*[F.lit(x) for x in seconds]), lambda e: e <= F.col(_KEY2))) - len(seconds))
            for f, seconds in ties.items()], F.lit(0))
        out = out.withColumn(BUCKET, (F.col(BUCKET) + more + tied).cast("int"))
    return out.drop(*keys)


def running_sums(df: DataFrame, order_cols: list[str], weights: dict[str, Column],
                 by: list[str] | None = None, buckets: int | None = None,
                 inclusive: bool = True, bucketed: DataFrame | None = None,
                 edge_source: DataFrame | None = None,
                 group_domains: dict[str, int] | None = None) -> DataFrame:
    """Add one running-sum column per entry of ``weights``.

    ``out[name]`` = sum of the weight over rows that come before (and, if
    ``inclusive``, at) this row in the global order ``order_cols`` within the
    same ``by`` group. ``order_cols`` must be a total order for the result to
    be deterministic. Integral weights give exact sums.
    """
    specs = [(n, w, list(by or []), inclusive) for n, w in weights.items()]
    if bucketed is None:
        bucketed = add_range_bucket(df, order_cols, buckets, edge_source=edge_source)
    return running_sums_multi(df, order_cols, specs, buckets=buckets, bucketed=bucketed,
                              group_domains=group_domains)


# Offsets tables up to this many rows (buckets x group domain, a bound
# known before running) are broadcast by hint; larger or unknown ones are
# left to adaptive execution.
MAX_OFFSET_BROADCAST_ROWS = 1_000_000


def running_sums_multi(df: DataFrame, order_cols: list[str],
                       specs: list[tuple[str, Column, list[str], bool]],
                       buckets: int | None = None,
                       bucketed: DataFrame | None = None,
                       group_domains: dict[str, int] | None = None) -> DataFrame:
    """Several running sums, each ``(name, weight, by, inclusive)``, over one
    bucketed pass. Windows with the same grouping share one Window operator
    and all of them share the ``_bucket`` exchange.

    The sum of earlier buckets comes from a totals table with one row per
    (bucket, group): a running sum over it (partitioned by group, at most
    ``buckets`` rows per partition) gives each bucket's offset, joined back
    on (bucket, group). The offsets table has at most buckets x (product
    of the group domains) rows; with no groups, or with every ``by`` column's
    number of values given in ``group_domains``, that bound is known before
    running and the table is broadcast by hint when it is small, so the join
    never reshuffles the full table. Otherwise the join carries no hint and
    adaptive execution decides from the measured size."""
    b = bucketed if bucketed is not None else add_range_bucket(df, order_cols, buckets)
    n_buckets = buckets or default_buckets(df)
    domains = group_domains or {}
    finest: list[str] = []
    for _, _, by, _ in specs:
        finest += [c for c in by if c not in finest]
    out = b
    windows = {}
    for name, weight, by, inclusive in specs:
        key = (tuple(by), inclusive)
        if key not in windows:
            frame_end = Window.currentRow if inclusive else -1
            windows[key] = Window.partitionBy(BUCKET, *by).orderBy(*order_cols) \
                .rowsBetween(Window.unboundedPreceding, frame_end)
        out = out.withColumn(f"_loc_{name}", F.coalesce(F.sum(weight).over(windows[key]), F.lit(0)))
    totals = b.groupBy(BUCKET, *finest).agg(*[F.coalesce(F.sum(w), F.lit(0)).alias(n)
                                              for n, w, _, _ in specs])
    by_sets: dict[tuple, list[str]] = {}
    for name, _, by, _ in specs:
        by_sets.setdefault(tuple(by), []).append(name)
    for by, names in by_sets.items():
        t = totals if list(by) == finest else \
            totals.groupBy(BUCKET, *by).agg(*[F.sum(n).alias(n) for n in names])
        # Per group at most `buckets` rows (one per bucket); with no group
        # this is a single small partition of bucket totals, never data rows.
        earlier = Window.partitionBy(*by).orderBy(BUCKET) \
            .rowsBetween(Window.unboundedPreceding, -1)
        offs = t.select(F.col(BUCKET).alias("_ob"), *[F.col(c).alias(f"_o_{c}") for c in by],
                        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}")
                          for n in names])
        cond = F.col(BUCKET) == F.col("_ob")
        for c in by:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        bound = n_buckets
        for c in by:
            bound = bound * domains[c] if domains.get(c) else None
            if bound is None:
                break
        if bound is not None and bound <= MAX_OFFSET_BROADCAST_ROWS:
            offs = F.broadcast(offs)
        out = out.join(offs, on=cond, how="left")
        for n in names:
            out = out.withColumn(n, F.col(f"_loc_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0)))
        out = out.drop("_ob", *[f"_o_{c}" for c in by], *[f"_loc_{n}" for n in names],
                       *[f"_off_{n}" for n in names])
    return out


def dense_index(df: DataFrame, order_cols: list[str], name: str = "_idx",
                buckets: int | None = None) -> DataFrame:
    """0-based position in the global order ``order_cols`` (a total order)."""
    out = running_sums(df, order_cols, {name: F.lit(1).cast("long")},
                       buckets=buckets, inclusive=False)
    return out.drop(BUCKET)


def rolling_mean(df: DataFrame, order_cols: list[str], value: str, rows: int,
                 out: str, chunk_rows: int = 1_000_000, exclude_current: bool = False,
                 buckets: int | None = None, indexed: DataFrame | None = None,
                 exact_scale: int | None = 6) -> DataFrame:
    """Mean of ``value`` over the last ``rows`` rows (incl. the current one,
    min 1 row) in the global order, computed in fixed-size chunks of the
    dense index. Each chunk also receives the ``rows`` rows before it (halo),
    so no task ever sees more than ``chunk_rows + rows`` rows. With
    ``exact_scale`` the frame sum is taken exactly in DECIMAL(38, scale), so
    the mean does not depend on summation order."""
    idx = indexed if indexed is not None else dense_index(df, order_cols, buckets=buckets)
    c = max(int(chunk_rows), rows + 1)
    chunk = F.floor(F.col("_idx") / F.lit(c)).cast("long")
    in_halo = (F.col("_idx") % F.lit(c)) >= F.lit(c - rows)
    x = idx.withColumn("_chunk", chunk) \
        .withColumn("_copy", F.explode(F.when(in_halo, F.array(F.lit(0), F.lit(1)))
                                       .otherwise(F.array(F.lit(0)))))
    x = x.withColumn("_chunk", F.col("_chunk") + F.col("_copy"))
    lo, hi = (-rows, -1) if exclude_current else (-(rows - 1), 0)
    w = Window.partitionBy("_chunk").orderBy("_idx").rowsBetween(lo, hi)
    if exact_scale is None:
        mean = F.avg(value).over(w)
    else:
        dec = exact(value, exact_scale)
        mean = F.try_divide(F.try_sum(dec).over(w).cast("double"), F.count(dec).over(w))
    res = x.withColumn(out, mean).where(F.col("_copy") == 0)
    return res.drop("_chunk", "_copy")


# Largest side table (bytes, by its parameter bound) the bucket-local
# rolling mean may broadcast; beyond it the chunked form is used.
MAX_EDGE_BROADCAST_BYTES = 64 * 1024 * 1024


def edge_fix_fits(buckets: int, rows: int) -> bool:
    return (rows - 1) * buckets * 24 <= MAX_EDGE_BROADCAST_BYTES


def bucket_window_columns(rows: int, value: str, order_cols: list[str], exact_scale: int = 6,
                          exclude_current: bool = False) -> dict[str, Column]:
    """Window columns for ``rolling_mean_from_buckets``, all partitioned by
    ``_bucket`` so they share the bucket exchange of ``running_sums_multi``."""
    lo, hi = (-rows, -1) if exclude_current else (-(rows - 1), 0)
    w = Window.partitionBy(BUCKET).orderBy(*order_cols)
    dec = exact(value, exact_scale)
    return {
        "_rs_in": F.try_sum(dec).over(w.rowsBetween(lo, hi)),
        "_rc_in": F.count(dec).over(w.rowsBetween(lo, hi)),
        "_bpos": F.row_number().over(w) - 1,
        "_bsize": F.count(F.lit(1)).over(Window.partitionBy(BUCKET)),
    }


def rolling_mean_from_buckets(x: DataFrame, value: str, rows: int, out: str, exact_scale: int = 6,
                              exclude_current: bool = False, chunk_rows: int = 1_000_000) -> DataFrame:
    """Rolling mean of the last ``rows`` rows using the bucket pass only.

    ``x`` carries ``_idx`` and the ``bucket_window_columns``. A row whose
    frame lies inside its bucket is done. The first ``rows`` rows of a
    bucket also need rows of earlier buckets: they are recomputed from a
    side set holding the first and last ``rows`` rows of every bucket, which
    contains every row such a frame reaches (a range frame on ``_idx`` skips
    the gaps). The side set is bounded by 2 * rows * buckets rows, so its
    result is broadcast back. The full-width rows are shuffled once; the
    side set comes from a replay of the bucket pass that column pruning
    narrows to (id, order key, value)."""
    k = rows if exclude_current else rows - 1
    edge = (F.col("_bpos") < k) & (F.col("_idx") > F.col("_bpos"))
    tail = (F.col("_bsize") - F.col("_bpos")) <= k
    dec = exact(value, exact_scale)
    side = x.where((F.col("_bpos") < k) | tail) \
        .select("_idx", dec.alias("_v"), edge.alias("_edge"))
    c = max(int(chunk_rows), rows + 1)
    side = side.withColumn("_chunk", F.floor(F.col("_idx") / F.lit(c)).cast("long")) \
        .withColumn("_copy", F.explode(F.when((F.col("_idx") % F.lit(c)) >= F.lit(c - rows),
                                              F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))) \
        .withColumn("_chunk", F.col("_chunk") + F.col("_copy"))
    lo, hi = (-rows, -1) if exclude_current else (-(rows - 1), 0)
    w = Window.partitionBy("_chunk").orderBy("_idx").rangeBetween(lo, hi)
    fixed = side.select("_idx", "_edge", "_copy", F.try_sum("_v").over(w).alias("_fs"),
                        F.count("_v").over(w).alias("_fc")) \
        .where(F.col("_edge") & (F.col("_copy") == 0)).select("_idx", "_fs", "_fc")
    j = x.join(F.broadcast(fixed), on="_idx", how="left")
    s = F.coalesce(F.col("_fs"), F.col("_rs_in")).cast("double")
    n = F.coalesce(F.col("_fc"), F.col("_rc_in"))
    return j.withColumn(out, F.try_divide(s, F.when(n > 0, n))) \
        .drop("_fs", "_fc", "_rs_in", "_rc_in", "_bpos", "_bsize")
