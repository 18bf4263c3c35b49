"""Trailing functions along one ticker's calendar rows.

All of them run over ``Window.partitionBy(ticker).orderBy(t)`` on the dense
grid, so one exchange by ticker serves any number of them, and a partition is
never longer than the calendar. A rolling value is NULL until ``min_periods``
non-missing inputs are in the frame (default: the whole window).
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from crosspanel.functions.expr import col, safe_div

ENTITY = "ticker"
ORDER = "t"


def axis():
    return Window.partitionBy(ENTITY).orderBy(ORDER)


def frame(k: int, skip: int = 0):
    """The last k rows, ending ``skip`` rows before the current one."""
    return axis().rowsBetween(-(k - 1) - skip, -skip)


def lag(x, n: int = 1) -> Column:
    return F.lag(col(x), n).over(axis())


def lead(x, n: int = 1) -> Column:
    return F.lead(col(x), n).over(axis())


def pct_change(x, n: int = 1) -> Column:
    return safe_div(col(x), lag(x, n)) - 1


def diff(x, n: int = 1) -> Column:
    return col(x) - lag(x, n)


def _count(c: Column, k: int, skip: int = 0) -> Column:
    """Non-missing values in ``frame(k, skip)`` as the difference of two running counts, whose cost does not grow with k."""
    up_to = lambda end: F.count(c).over(axis().rowsBetween(Window.unboundedPreceding, end))
    return up_to(-skip) - up_to(-skip - k)


def _apply(fn, x, k, min_periods, skip):
    c = col(x)
    return F.when(_count(c, k, skip) >= (k if min_periods is None else min_periods), fn(c).over(frame(k, skip)))


def mean(x, k, min_periods=None, skip=0) -> Column:
    return _apply(F.avg, x, k, min_periods, skip)


def total(x, k, min_periods=None, skip=0) -> Column:
    return _apply(F.sum, x, k, min_periods, skip)


def lowest(x, k, min_periods=None, skip=0) -> Column:
    return _apply(F.min, x, k, min_periods, skip)


def highest(x, k, min_periods=None, skip=0) -> Column:
    return _apply(F.max, x, k, min_periods, skip)


def std(x, k, min_periods=None, skip=0) -> Column:
    return _apply(F.stddev_samp, x, k, min_periods, skip)


def var(x, k, min_periods=None, skip=0) -> Column:
    return _apply(F.var_samp, x, k, min_periods, skip)


def observed(x, k, skip=0) -> Column:
    return _count(col(x), k, skip)


# Statistics that use a window sum more than once come in two steps: a stage of
# sums, then formulas over the named sums. (Spark evaluates a window expression as
# often as it is written.) Plain sums also cost about a tenth of the built-in higher
# moments, because a sliding frame is evaluated anew for every row. A spread below
# ROUNDING of the mean square is rounding noise and counts as flat.

ROUNDING = 1e-13


def pair_sums(tag: str, x, y, k: int) -> dict[str, Column]:
    """Window sums of two series over the rows where both are present."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    w = frame(k)
    return {
        f"{tag}_n": _count(a, k).cast("double"),
        f"{tag}_a": F.sum(a).over(w), f"{tag}_b": F.sum(b).over(w),
        f"{tag}_aa": F.sum(a * a).over(w), f"{tag}_bb": F.sum(b * b).over(w), f"{tag}_ab": F.sum(a * b).over(w),
    }


def _enough(tag: str, need: int) -> Column:
    n = F.col(f"{tag}_n")
    return F.when(n >= need, n)


def _spread(tag: str, side: str, n: Column) -> Column:
    """Population variance from sums, NULL when it is only rounding noise."""
    mean, square = F.col(f"{tag}_{side}") / n, F.col(f"{tag}_{side}{side}") / n
    return F.when(square - mean * mean > ROUNDING * square, square - mean * mean)


def _product(tag: str, n: Column) -> Column:
    return F.col(f"{tag}_ab") / n - (F.col(f"{tag}_a") / n) * (F.col(f"{tag}_b") / n)


def pair_cov(tag: str, need: int) -> Column:
    """Sample covariance from :func:`pair_sums`."""
    n = _enough(tag, need)
    return _product(tag, n) * n / (n - 1)


def pair_var(tag: str, need: int) -> Column:
    """Sample variance of the second series."""
    n = _enough(tag, need)
    return _spread(tag, "b", n) * n / (n - 1)


def pair_corr(tag: str, need: int) -> Column:
    """Pearson correlation; NULL when either side is flat in the window."""
    n = _enough(tag, need)
    raw = _product(tag, n) / F.sqrt(_spread(tag, "a", n) * _spread(tag, "b", n))
    return F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def pair_beta(tag: str, need: int) -> Column:
    """Covariance over the variance of the second series."""
    n = _enough(tag, need)
    return _product(tag, n) / _spread(tag, "b", n)


def power_sums(tag: str, x, k: int) -> dict[str, Column]:
    """Window sums of the first four powers."""
    c, w = col(x), frame(k)
    return {
        f"{tag}_n": _count(c, k).cast("double"),
        f"{tag}_a": F.sum(c).over(w), f"{tag}_aa": F.sum(c * c).over(w),
        f"{tag}_3": F.sum(c * c * c).over(w), f"{tag}_4": F.sum(c * c * c * c).over(w),
    }


def skew_of(tag: str, need: int) -> Column:
    """Bias-corrected sample skewness from :func:`power_sums`."""
    n = _enough(tag, max(need, 3))
    mu, m2 = F.col(f"{tag}_a") / n, _spread(tag, "a", n)
    m3 = F.col(f"{tag}_3") / n - 3 * mu * F.col(f"{tag}_aa") / n + 2 * mu * mu * mu
    return m3 / (m2 * F.sqrt(m2)) * F.sqrt(n * (n - 1)) / (n - 2)


def kurt_of(tag: str, need: int) -> Column:
    """Bias-corrected sample excess kurtosis from :func:`power_sums`."""
    n = _enough(tag, max(need, 4))
    mu, m2 = F.col(f"{tag}_a") / n, _spread(tag, "a", n)
    m4 = (
        F.col(f"{tag}_4") / n - 4 * mu * F.col(f"{tag}_3") / n
        + 6 * mu * mu * F.col(f"{tag}_aa") / n - 3 * mu * mu * mu * mu
    )
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)


def rows_since_high(filled, x, k) -> Column:
    """Calendar rows since the highest of the last k forward-filled values.

    The oldest of equal highs wins. ``filled`` is the ``ffill`` of ``x`` from
    an earlier stage; the result is NULL where ``x`` itself is missing.
    """
    w = frame(k)
    peak = F.max(F.struct(col(filled).alias("v"), (-F.col(ORDER)).alias("back"))).over(w)
    since = F.col(ORDER) + peak["back"]
    return F.when(col(x).isNotNull() & (_count(F.lit(1), k) >= k), since.cast("double"))


def ffill(x) -> Column:
    return F.last(col(x), ignorenulls=True).over(axis().rowsBetween(Window.unboundedPreceding, 0))


def bfill(x) -> Column:
    return F.first(col(x), ignorenulls=True).over(axis().rowsBetween(0, Window.unboundedFollowing))


def cumsum(x) -> Column:
    return F.sum(col(x)).over(axis().rowsBetween(Window.unboundedPreceding, 0))


def cummax(x) -> Column:
    return F.max(col(x)).over(axis().rowsBetween(Window.unboundedPreceding, 0))


def growth(r) -> Column:
    """Running product of (1 + r); missing returns leave the level unchanged."""
    return F.exp(cumsum(F.log1p(col(r))))


def latest(df, n: int = 1, order: str = "date"):
    """The last n rows of every ticker."""
    w = Window.partitionBy(ENTITY).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sequences(df, features, k: int = 20, out: str = "window"):
    """Rows whose last k calendar rows are complete, with those rows as one array.

    The array holds k structs of the features, oldest first.
    """
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    w = frame(k)
    item = F.struct(*[F.col(f).alias(f) for f in features])
    return (
        df.withColumns({out: F.collect_list(F.when(whole, item)).over(w)})
        .filter(F.size(out) == k)
    )
