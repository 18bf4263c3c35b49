"""Time-ordered splits, embargoes, weights and deterministic sampling.

Splits are decided on the calendar (one row per date) and reach the rows by an
equi-join on date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.expr import safe_div
from crosspanel.operators import cross as X
from crosspanel.operators.quality import business_days_before


class OverlapError(AssertionError):
    """A training label window reaches into the test period."""


def position(cal: DataFrame, day) -> Column:
    """Calendar position of the first date on or after ``day`` (past the end: the length)."""
    d = F.lit(day).cast("date") if isinstance(day, str) else day
    return cal.agg(F.count(F.when(F.col("date") < d, 1))).scalar()


def purge_cutoff(cal: DataFrame, test_start: str, horizon: int) -> DataFrame:
    """Last training date whose label window ends on or before ``test_start``."""
    cut = F.greatest(position(cal, test_start) - horizon, F.lit(0))
    return cal.filter(F.col("t") == cut).select(F.col("date").alias("cut"))


def folds(cal: DataFrame, years: Sequence[int], horizon: int) -> DataFrame:
    """Expanding walk-forward folds by year: (fold, cut, test_start, test_end).

    One row per test year that has dates; everything here is calendar-sized.
    """
    tests = (
        cal.filter(F.year("date").isin(list(years)))
        .groupBy(F.year("date").alias("fold"))
        .agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.min("t").alias("_t"))
        .withColumn("t", F.greatest(F.col("_t") - horizon, F.lit(0)))
    )
    return tests.join(cal.select("t", F.col("date").alias("cut")), "t").select("fold", "cut", "test_start", "test_end")


def assert_no_overlap(cal: DataFrame, fold_table: DataFrame, horizon: int) -> None:
    """Raise when a label that starts at a fold's cut ends after its first test date."""
    last = cal.agg(F.max("t")).scalar()
    ends = fold_table.join(cal.select(F.col("date").alias("cut"), "t"), "cut").withColumn(
        "_end", F.least(F.col("t") + horizon, last)
    )
    ends = ends.join(cal.select(F.col("t").alias("_end"), F.col("date").alias("label_end")), "_end")
    bad = ends.filter(F.col("label_end") > F.col("test_start")).select("fold", "label_end", "test_start").take(1)
    if bad:
        raise OverlapError(f"labels of fold {bad[0]['fold']} end {bad[0]['label_end']}, after {bad[0]['test_start']}")


def date_roles(cal: DataFrame, fold_table: DataFrame) -> DataFrame:
    """(date, fold, role) for every date that trains or tests in a fold.

    A range join between the calendar and the fold list, both tiny.
    """
    f = fold_table.hint("broadcast")  # at most one row per test year
    inside = (F.col("date") <= F.col("cut")) | F.col("date").between(F.col("test_start"), F.col("test_end"))
    role = F.when(F.col("date") <= F.col("cut"), "train").otherwise("test")
    return cal.join(f, inside).select("date", "fold", role.alias("role"))


def holdout(
    cal: DataFrame, test_year: int, embargo: int, years: int | None = None, months: int | None = None
) -> DataFrame:
    """(date, role) with role fit / val / test for one test year.

    Training ends ``embargo`` rows before the test year; its last tenth of dates
    validates, again after an embargo. ``years`` or ``months`` make the training
    window rolling instead of expanding.
    """
    start = F.lit(f"{test_year}-01-01").cast("date")
    end = F.lit(f"{test_year}-12-31").cast("date")
    cut_t = F.greatest(position(cal, start) - embargo, F.lit(0))
    train = cal.filter(F.col("t") <= cut_t)
    back = 12 * years if years else months
    if back:
        train = train.filter(F.col("date") >= F.add_months(start, -back))
    train = train.withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)
    size = train.count()
    val_i = int(size * 0.90)
    val_t = train.filter(F.col("_i") == val_i).select("t").scalar()
    fit_last = F.greatest(val_t - embargo, F.lit(0))
    role = F.when(F.col("_i") >= val_i, "val").when(F.col("t") <= fit_last, "fit")
    tests = cal.filter(F.col("date").between(start, end)).select("date", F.lit("test").alias("role"))
    return train.select("date", role.alias("role")).filter(F.col("role").isNotNull()).unionByName(tests)


def fraction_split(cal: DataFrame, train: float, val: float, embargo: int) -> DataFrame:
    """(date, role) by share of dates, with an embargo after each boundary."""
    n = cal.count()
    a, b = int(n * train), int(n * (train + val))
    i = F.row_number().over(Window.orderBy("date")) - 1
    role = F.when(F.col("_i") < a, "train").when((F.col("_i") >= a + embargo) & (F.col("_i") < b), "val").when(
        F.col("_i") >= b + embargo, "test")
    return cal.withColumn("_i", i).select("date", role.alias("role")).filter(F.col("role").isNotNull())


def contiguous_folds(cal: DataFrame, n: int, embargo: int) -> DataFrame:
    """(date, fold, role): n test blocks after a first block that only trains."""
    blocks = cal.withColumn("_b", F.ntile(n + 1).over(Window.orderBy("date")) - 1).withColumn(
        "_i", F.row_number().over(Window.orderBy("date")) - 1
    )
    starts = blocks.groupBy("_b").agg(F.min("_i").alias("_start")).filter(F.col("_b") >= 1)
    f = starts.select((F.col("_b") - 1).alias("fold"), "_start").hint("broadcast")  # n rows
    is_test = F.col("_b") - 1 == F.col("fold")
    train = F.col("_i") < F.greatest(F.col("_start") - embargo, F.lit(0))
    return blocks.join(f, is_test | train).select("date", "fold", F.when(is_test, "test").otherwise("train").alias("role"))


def business_day_split(cal: DataFrame, test_year: int, embargo: int) -> DataFrame:
    """(date, role) with the training end counted back in weekdays from the test year."""
    start = F.lit(f"{test_year}-01-01").cast("date")
    role = F.when(F.col("date") >= start, "test").when(F.col("date") <= business_days_before(start, embargo), "train")
    return cal.select("date", role.alias("role")).filter(F.col("role").isNotNull())


def non_overlapping(df: DataFrame, horizon: int) -> DataFrame:
    """Rows on every horizon-th calendar date, so that labels do not overlap."""
    return df.filter(F.col("t") % horizon == 0)


def recency_weight(df: DataFrame, decay: float = 0.5) -> DataFrame:
    """Weights that halve-life by age in years, scaled to mean one."""
    newest = df.agg(F.max("date")).scalar()
    raw = F.exp(-decay * F.datediff(newest, F.col("date")) / 365.25)
    aged = df.withColumn("_raw", raw)
    return aged.withColumn("weight", F.col("_raw") / aged.agg(F.avg("_raw")).scalar()).drop("_raw")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight per class: rows / (classes x rows of the class)."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total, k = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("n")).scalar()
    return counts.withColumn("weight", total / (k * F.col("n")))


def positive_weight(df: DataFrame, y: str) -> DataFrame:
    """Negatives per positive."""
    neg, pos = F.count(F.when(F.col(y) == 0, 1)), F.count(F.when(F.col(y) == 1, 1))
    return df.agg(safe_div(neg, pos).alias("weight"))


def hash_key(*keys: str, seed: str = "") -> Column:
    """A 48-bit number that depends only on the key text (same in every run)."""
    text = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def capped_sample(
    df: DataFrame, n: int, keys: Sequence[str] = ("date", "ticker"), seed: str = "", rows: int | None = None
) -> DataFrame:
    """Exactly n rows (or all, if fewer), chosen by key hash; the same rows in every run."""
    marked = df.withColumn("_h", hash_key(*keys, seed=seed)).withColumn("_k", F.concat_ws("|", *keys))
    return X.top_n(marked, [], "_h", n, descending=False, tie="_k", group_rows=rows).drop("_h", "_k")


def permute_within_date(df: DataFrame, x: str, seed: str, group_rows: int | None = None) -> DataFrame:
    """Shuffle x among the rows of each date by two hash orders."""
    a = X.ordinal(df.withColumn("_h", hash_key("ticker", "date")), X.DATE, "_h", "_i", group_rows=group_rows)
    b = X.ordinal(
        df.select("date", "ticker", F.col(x).alias("_x")).withColumn("_h", hash_key("ticker", "date", seed=seed)),
        X.DATE, "_h", "_i", group_rows=group_rows,
    ).select("date", "_i", "_x")
    return a.join(b, ["date", "_i"]).withColumn(x, F.col("_x")).drop("_h", "_i", "_x")
