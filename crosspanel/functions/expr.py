"""Column helpers that keep one rule: a missing value is NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b) -> Column:
    """a / b, NULL when b is zero (a plain ``/`` raises under ANSI mode)."""
    return F.try_divide(col(a), col(b) if isinstance(b, (str, Column)) else F.lit(b))


def null_if_zero(x) -> Column:
    return F.nullif(col(x), F.lit(0.0))


def finite(x) -> Column:
    """NaN and both infinities become NULL."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (greatest/least alone would skip it)."""
    c = col(x)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def flag(cond: Column) -> Column:
    """Condition as 1.0 / 0.0 where an unknown condition counts as 0.0."""
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def null_flag(cond: Column) -> Column:
    """Condition as 1.0 / 0.0 that stays NULL when unknown."""
    return cond.cast("double")


def greatest_strict(*xs) -> Column:
    """Row maximum that is NULL as soon as one input is."""
    cols = [col(x) for x in xs]
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*cols))


def bankers_round(x) -> Column:
    """Round half to even, as Python's ``round`` does."""
    return F.bround(col(x), 0).cast("long")


def log_return(x) -> Column:
    """ln(x) with non-positive input mapped to NULL."""
    c = col(x)
    return F.when(c > 0, F.ln(c))


FLAT = 1e-12


def pearson(a, b, over=None) -> Column:
    """Correlation over the rows where both are present; NULL when a side is flat.

    Built from covariance and deviations because the built-in raises on a flat
    side under ANSI mode. A side is flat if its deviation is within rounding of
    its largest value. ``over`` makes it a window expression.
    """
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    cov, sx, sy = parts
    size = [F.max(F.abs(v)) if over is None else F.max(F.abs(v)).over(over) for v in (x, y)]
    return F.when((sx > FLAT * size[0]) & (sy > FLAT * size[1]), F.try_divide(cov, sx * sy))
