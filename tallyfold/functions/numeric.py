"""Null- and NaN-safe numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x, default: float | None = 0.0) -> Column:
    """The value as double, or the default where it is null, NaN or infinite."""
    v = c(x).cast("double")
    # NaN sorts above infinity, so one comparison covers null, NaN and both infinities.
    return F.when(F.abs(v) < F.lit(float("inf")), v).otherwise(F.lit(default).cast("double"))


def safe_div(num, den, default: float | None = 0.0) -> Column:
    d = finite(den)
    return F.when(d == 0, F.lit(default).cast("double")).otherwise(finite(num) / d)


def clamp(x, lo: float, hi: float) -> Column:
    """Clamp with a missing value taken as the lower bound."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), finite(x, lo)))


def to_number(x, default: float | None = None) -> Column:
    """Parse text to double; anything unreadable becomes the default."""
    v = c(x).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(default).cast("double"))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num/den for whole-number columns, default where den is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(float(default)))


def rate(cond: Column) -> Column:
    """Share of rows meeting a condition; null conditions count as not met."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def count_where(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def fixed(x, digits: int) -> Column:
    """Fixed-point text with banker's rounding, as the report formats use."""
    return F.format_string(f"%.{digits}f", F.bround(c(x).cast("double"), digits))


def signed(x, digits: int) -> Column:
    return F.format_string(f"%+.{digits}f", F.bround(c(x).cast("double"), digits))


def percent(x, digits: int = 1) -> Column:
    return F.concat(fixed(c(x).cast("double") * 100, digits), F.lit("%"))


def money(x, digits: int = 2) -> Column:
    return F.concat(F.lit("R$ "), F.format_number(F.bround(c(x).cast("double"), digits), digits))
