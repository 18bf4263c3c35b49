"""Peer-group and market operators built on the cross-sectional primitives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.expr import safe_div
from crosspanel.operators import cross as X


def date_series(df: DataFrame, **stats) -> DataFrame:
    """One row per date (calendar-sized) with t and the given aggregates."""
    return df.groupBy("date", "t").agg(*[agg.alias(name) for name, agg in stats.items()])


def over_dates(k: int):
    """The last k dates of a one-row-per-date series."""
    return Window.orderBy("t").rowsBetween(-(k - 1), 0)


def series_stat(fn, x: str, k: int, min_periods: int | None = None):
    w = over_dates(k)
    return F.when(F.count(x).over(w) >= (min_periods or k), fn(x).over(w))


def market_regime(grid: DataFrame, ema: str = "ema_50") -> DataFrame:
    """Market return, its volatility and volatility z-score, and breadth, per date.

    ``grid`` carries ret_1d, close and the moving average named by ``ema``.
    """
    day = date_series(
        grid,
        mkt_ret_1d=F.avg("ret_1d"),
        breadth_50d=safe_div(
            F.sum(F.coalesce((F.col("close") > F.col(ema)).cast("double"), F.lit(0.0))), F.count("close")
        ),
    )
    day = day.withColumn("mkt_vol_20d", series_stat(F.stddev_samp, "mkt_ret_1d", 20))
    z = safe_div(
        F.col("mkt_vol_20d") - series_stat(F.avg, "mkt_vol_20d", 252, 60),
        series_stat(F.stddev_samp, "mkt_vol_20d", 252, 60),
    )
    return day.select("date", "mkt_ret_1d", "mkt_vol_20d", z.alias("mkt_vol_zscore"), "breadth_50d")


def category_rank(df: DataFrame, x: str, out: str) -> DataFrame:
    """Rank every date's categories by their mean x and hand the rank to live members."""
    by_cat = df.groupBy("date", "category").agg(F.avg(x).alias("_mean"))
    # a date holds one row per category here, far fewer than its tickers
    ranked = X.pct_rank(by_cat, X.DATE, {"_rank": "_mean"}, group_rows=0).drop("_mean")
    joined = df.join(ranked, X.PEERS, "left")
    return joined.withColumn(out, F.when(F.col("close").isNotNull(), F.col("_rank"))).drop("_rank")


def breadth(df: DataFrame, x: str, out: str, group_rows: int | None = None) -> DataFrame:
    """Share of a category's known values that are positive."""
    up = F.when(F.col(x).isNotNull(), (F.col(x) > 0).cast("double"))
    return X.group_stats(df, X.PEERS, {out: F.avg(up)}, group_rows)


def share_above_mean(df: DataFrame, x: str, out: str, group_rows: int | None = None) -> DataFrame:
    """Share of a category's grid rows above the category mean; missing values count as not above."""
    df = X.group_stats(df, X.PEERS, {"_mean": F.avg(x)}, group_rows)
    above = F.coalesce((F.col(x) > F.col("_mean")).cast("double"), F.lit(0.0))
    return X.group_stats(df.withColumn("_above", above), X.PEERS, {out: F.avg("_above")}, group_rows).drop(
        "_mean", "_above"
    )


def dispersion(grid: DataFrame, r1: str = "r1", k: int = 5) -> DataFrame:
    """Cross-sectional deviation of returns per date, averaged over k dates."""
    day = date_series(grid, _sd=F.stddev_samp(r1))
    return day.select("date", "t", series_stat(F.avg, "_sd", k).alias("dispersion"))


def mix_distance(df: DataFrame, weights: Sequence[str], keys: Sequence[str], out: str, group_rows=None) -> DataFrame:
    """Half the L1 distance of a member's weights to its group's mean weights.

    Missing weights are left out; NULL when all are missing.
    """
    stats = {f"_m_{c}": F.avg(c) for c in weights}
    df = X.group_stats(df, keys, stats, group_rows)
    known = F.lit(False)
    total = F.lit(0.0)
    for c in weights:
        known = known | F.col(c).isNotNull()
        total = total + F.coalesce(F.abs(F.col(c) - F.col(f"_m_{c}")), F.lit(0.0))
    return df.withColumn(out, F.when(known, total / 2)).drop(*stats)


def softmax_pool(df: DataFrame, score: str, values: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Softmax-weighted mean of each value within (date, category), given to every member."""
    df = X.group_stats(df, X.PEERS, {"_top": F.max(score)}, group_rows)
    df = df.withColumn("_w", F.exp(F.col(score) - F.col("_top")))
    stats = {"_den": F.sum("_w"), **{f"pool_{v}": F.sum(F.col(v) * F.col("_w")) for v in values}}
    df = X.group_stats(df, X.PEERS, stats, group_rows)
    return df.withColumns({f"pool_{v}": safe_div(f"pool_{v}", "_den") for v in values}).drop("_top", "_w", "_den")


def sample_pairs(df: DataFrame, rel: str, draws: int, group_rows: int | None = None) -> DataFrame:
    """Pairs of same-category members of a date with different outcomes.

    Members are put in an order that depends on date, category and ticker alone, and each is paired with the next ``draws`` of its category,
    around the end: partners are distinct, none is drawn in vain, and every member of a category of two or more has some. Pairs of
    equal outcomes are left out. At most draws x members rows, through an equi-join.
    """
    named = F.concat_ws("|", F.col("date").cast("string"), "category", "ticker")
    known = df.filter(F.col(rel).isNotNull()).select("date", "ticker", "category", rel, F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long").alias("_key"))
    placed = X.ordinal(known, X.PEERS, "_key", "_pos", size="_n", group_rows=group_rows).drop("_key")
    steps = F.filter(F.sequence(F.lit(1), F.lit(draws)), lambda d: d < F.col("_n"))
    drawn = placed.withColumn("draw", F.explode(steps)).withColumn("_partner", (F.col("_pos") - 1 + F.col("draw")) % F.col("_n") + 1)
    other = placed.select("date", "category", F.col("_pos").alias("_partner"), F.col("ticker").alias("other"), F.col(rel).alias("other_rel"))
    pairs = drawn.join(other, ["date", "category", "_partner"]).filter(F.col(rel) != F.col("other_rel"))
    return pairs.select("date", "category", "draw", "ticker", "other", rel, "other_rel")
