"""Null-safe column arithmetic and the windows used on a (code, date) panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero (ANSI mode would raise)."""
    return F.try_divide(col(a), col(b))


def finite(x: Column | str) -> Column:
    """NaN and infinities become NULL; NaN is above infinity in Spark's order."""
    c = col(x)
    return F.when(F.abs(c) < float("inf"), c)


def two_decimals(x: Column) -> Column:
    """Text of 0 <= x < 1e15 with two decimals, rounded from the exact binary value, ties to even,
    as C's ``printf`` does; ``format_string`` rounds the shortest decimal text, ties upward."""
    # The fraction in units of 2^-55 is a whole number from 1/8 on, and only eighths can be ties.
    unit = 1 << 55
    whole = F.floor(x)
    scaled = ((x - whole) * float(unit)).cast("bigint") * 100
    cents, rest = F.shiftright(scaled, 55), scaled.bitwiseAND(F.lit(unit - 1))
    up = (rest > unit // 2) | ((rest == unit // 2) & (cents % 2 == 1))
    total = whole * 100 + cents + up.cast("bigint")
    return F.format_string("%d.%02d", F.floor(total / 100), total % 100)


def clamp(x: Column, lo, hi) -> Column:
    """Clip that keeps NULL as NULL (greatest/least skip NULL operands)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def by_code() -> WindowSpec:
    """History of one instrument. A code holds at most one row per session, so the
    partition is bounded by the length of the calendar."""
    return Window.partitionBy("code").orderBy("date")


def trailing(n: int) -> WindowSpec:
    return by_code().rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """Rolling aggregate of n rows, NULL until n non-null inputs are present."""
    c, w = col(x), trailing(n)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def lagged(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_code())


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over pairs, NULL when either side is constant."""
    cx, cy = col(x), col(y)
    both = cx.isNotNull() & cy.isNotNull()
    a, b = F.when(both, cx), F.when(both, cy)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.covar_pop(a, b) / F.sqrt(F.var_pop(a) * F.var_pop(b)))


def require_columns(df, *names: str) -> None:
    """Raise when an input lacks a column that an operator reads (D3); looks at the schema only."""
    lacking = sorted(set(names) - set(df.columns))
    if lacking:
        raise ValueError(f"the input has no column {', '.join(lacking)}")
