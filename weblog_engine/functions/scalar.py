"""Column-level helpers. Every function returns a built-in Spark Column
expression, so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int) -> Column:
    """Half-up rounding written as floor(x*10^n + 0.5)/10^n.

    The same text runs in DuckDB, so results agree bit for bit."""
    k = float(10 ** digits)
    return (F.floor(_c(c) * F.lit(k) + F.lit(0.5)) / F.lit(k)).cast("double")


def is_error(status="status_code") -> Column:
    return (_c(status) >= 400).cast("int")


def is_server_error(status="status_code") -> Column:
    return (_c(status) >= 500).cast("int")


def hour_of_day(ts="timestamp") -> Column:
    return F.hour(_c(ts))


def day_of_week(ts="timestamp") -> Column:
    """Monday=0 ... Sunday=6."""
    return F.weekday(_c(ts))


def is_business_hours(hour: Column, dow: Column) -> Column:
    """8 <= hour <= 18 on Monday..Friday (hour 18 inclusive)."""
    return ((hour >= 8) & (hour <= 18) & (dow <= 4)).cast("int")


# Timestamp text formats an upload may use, tried in order. The
# fraction of the first has one to nine digits; digits past the sixth are cut.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
]
_FRACTION = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)\.(\d{1,9})$"


def parse_timestamp(c) -> Column:
    """First matching format wins; no match gives NULL (the row fails)."""
    s = F.trim(_c(c))
    micros = F.concat(F.regexp_extract(s, _FRACTION, 1), F.lit("."),
                      F.rpad(F.substring(F.regexp_extract(s, _FRACTION, 2), 1, 6), 6, "0"))
    s = F.when(s.rlike(_FRACTION), micros).otherwise(s)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in TIMESTAMP_FORMATS]) \
        .cast("timestamp_ntz")


# Risk band upper edges of the error probability.
RISK_BANDS = [(0.15, "LOW"), (0.40, "MEDIUM"), (0.70, "HIGH")]
RISK_TOP = "CRITICAL"


def risk_band(p) -> Column:
    p = _c(p)
    expr = F.when(p < RISK_BANDS[0][0], RISK_BANDS[0][1])
    for edge, name in RISK_BANDS[1:]:
        expr = expr.when(p < edge, name)
    return expr.otherwise(RISK_TOP)


def method_one_hot(method="method", methods=None) -> list[Column]:
    from ..schema import KNOWN_METHODS
    m = _c(method)
    return [(m == x).cast("int").alias(f"method_{x}") for x in (methods or KNOWN_METHODS)]


def exact(c, scale: int = 6) -> Column:
    """The value as DECIMAL(38, scale); NULL where it is not finite or too
    large for it, so that sums and counts over the result agree on which
    values they cover and no sum fails on one cell."""
    return _c(c).try_cast(f"decimal(38,{scale})")


def exact_sum(c, scale: int = 6) -> Column:
    """Sum through DECIMAL(38, scale): exact, so the result does not depend
    on the order rows are added in (partitions, windows, engines)."""
    return F.try_sum(exact(c, scale)).cast("double")


def exact_mean(c, scale: int = 6) -> Column:
    """Mean of the values that ``exact`` can hold, as a double."""
    return exact_sum(c, scale) / F.count(exact(c, scale))


def truncated_int(c) -> Column:
    """A number or numeric text cut to a 32-bit integer; NULL otherwise."""
    d = _c(c).try_cast("double")
    return F.when((d > -2147483649.0) & (d < 2147483648.0), d.try_cast("int"))


def with_scalar(df, name: str, one_row) -> "object":
    """Attach the single row of ``one_row`` (a one-row DataFrame) as a struct
    column ``name``, via one scalar subquery. Reading fields of the column
    (``F.col(name + '.x')``) keeps the subquery from being planned once per
    use."""
    return df.select("*", one_row.select(F.struct(*one_row.columns)).scalar().alias(name))
