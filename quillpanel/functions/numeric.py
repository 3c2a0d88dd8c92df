"""Column guards.  Undefined values are NULL everywhere, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < INF), c)


def is_finite(c: Column) -> Column:
    """True only for a present, finite number."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """Division whose zero or missing divisor gives NULL."""
    return F.try_divide(a, b)


def correlation(a: Column, b: Column) -> Column:
    """Correlation aggregate over complete pairs; NULL where one side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ln(c: Column) -> Column:
    """Natural log, NULL for values that are not positive."""
    return F.when(c > 0, F.log(c))


def number(c: Column) -> Column:
    """Numeric coercion: text that is not a finite number becomes NULL."""
    return finite(c.try_cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    """Bounded value; NULL stays NULL (greatest/least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for reporting, with negative zero folded into zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded_price(c: Column) -> Column:
    """Four digits for price-scale values.

    Quotients of cents often end exactly on a rounding tie; the small shift
    moves those off the tie so that every engine rounds them alike.
    """
    return F.round(c.cast("double") + F.lit(3.7e-7), 4) + F.lit(0.0)


def flag(c: Column) -> Column:
    """1 where the condition holds, else 0 (NULL counts as false)."""
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def count_where(c: Column) -> Column:
    """Number of rows on which the condition holds."""
    return F.count_if(F.coalesce(c, F.lit(False)))
