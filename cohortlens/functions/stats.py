"""Statistic builders shared by the operators.

Rounding is exact: averages and shares of integer data are rounded HALF_UP
(away from zero) from the exact ratio ``num / den`` with integer arithmetic
on the *aggregated* values, so the result never depends on float summation
order and equals what a decimal calculator gives.  The arithmetic runs once
per output group, not per row, so ``decimal(38,0)`` costs nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The quartile points the study reports.
QUANTILE_PROBS = {"p25": 0.25, "median": 0.5, "p75": 0.75}

_BIG = "decimal(38,0)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded_ratio(num: str | Column, den: str | Column, digits: int, factor: int = 1,
                  rounding: str = "half_up") -> Column:
    """``round(factor * num / den, digits)``, exact for integral inputs.

    ``half_up`` (away from zero, the SQL flavour):
    q = (2*m*|num| + |den|) div (2*|den|) with m = factor * 10^digits.
    ``half_even`` (the pandas flavour): q = m*|num| div |den|, plus one when
    the remainder is more than half of |den|, or exactly half and q is odd.
    The sign is re-applied and q scaled back.  NULL when ``den`` is 0 or
    NULL (the ``try_divide`` contract, so ANSI mode never raises here).
    """
    num, den = _col(num), _col(den)
    m = factor * 10 ** digits
    a = F.abs(num).cast(_BIG)
    b = F.abs(den).cast(_BIG)
    if rounding == "half_up":
        q = F.call_function("div", a * F.lit(2 * m).cast(_BIG) + b, b * F.lit(2).cast(_BIG))
    elif rounding == "half_even":
        scaled = a * F.lit(m).cast(_BIG)
        f = F.call_function("div", scaled, b)
        twice_rem = (scaled - f * b) * F.lit(2).cast(_BIG)
        up = (twice_rem > b) | ((twice_rem == b) & (f % 2 == 1))
        q = f + F.when(up, F.lit(1)).otherwise(F.lit(0)).cast(_BIG)
    else:
        raise ValueError(f"unknown rounding {rounding!r}")
    signed = F.when((num < 0) != (den < 0), -q).otherwise(q)
    return F.when(den != 0, signed.cast("double") / F.lit(float(10 ** digits))).cast("double")


def round_value(c: Column, digits: int, rounding: str = "half_up") -> Column:
    """Round a floating value: ``round`` (HALF_UP) or ``bround`` (HALF_EVEN)."""
    if rounding == "half_up":
        return F.round(c, digits)
    if rounding == "half_even":
        return F.bround(c, digits)
    raise ValueError(f"unknown rounding {rounding!r}")


def mean_from(total: Column, count: Column, dtype: T.DataType, digits: int = 1,
              rounding: str = "half_up") -> Column:
    """Rounded ``total / count`` for a measure of type ``dtype``: exact for
    integral and decimal measures (integer arithmetic on the aggregated
    values), ``round(total / count)`` for floating ones."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return rounded_ratio(total, count, digits, rounding=rounding)
    if isinstance(dtype, T.DecimalType):
        unit = 10 ** dtype.scale
        return rounded_ratio((total * F.lit(unit)).cast(_BIG), count * F.lit(unit), digits, rounding=rounding)
    return round_value(total.cast("double") / count, digits, rounding).cast("double")


def mean_expr(c: str | Column, dtype: T.DataType, digits: int = 1, rounding: str = "half_up") -> Column:
    """Aggregate: the rounded mean of ``c`` (NULLs ignored, like AVG)."""
    c = _col(c)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return mean_from(F.sum(c), F.count(c), dtype, digits, rounding)
    return round_value(F.avg(c), digits, rounding).cast("double")


def quantile_exprs(c: str | Column, names: Sequence[str], method: str = "exact",
                   digits: int = 1, accuracy: int = 10000, rounding: str = "half_up") -> dict[str, Column]:
    """Aggregates for the requested quartile names (``p25``/``median``/``p75``).

    ``percentile`` -- Spark's ``percentile`` (linear interpolation between
                  order statistics).  Its per-group state is a value->count
                  map: memory grows with the *distinct* values of a group,
                  but the reducer of a group merges one map per map task.
                  (``contrast`` computes ``exact`` from a histogram instead,
                  see ``operators.quantiles.histogram_summary``.)
    ``approx`` -- ``percentile_approx`` (returns an observed value, like the
                  SQL flavour of the study); bounded sketch per group,
                  relative rank error 1/accuracy.
    One array-valued aggregate is built, so each group keeps one state.
    """
    c = _col(c)
    probs = [QUANTILE_PROBS[n] for n in names]
    if method in ("exact", "percentile"):
        arr = F.percentile(c, probs)
        return {n: round_value(arr[i], digits, rounding).cast("double") for i, n in enumerate(names)}
    if method == "approx":
        arr = F.percentile_approx(c, probs, accuracy)
        return {n: arr[i].cast("double") for i, n in enumerate(names)}
    raise ValueError(f"unknown quantile method {method!r}")


def weekday_of(ts: str | Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(_col(ts))
