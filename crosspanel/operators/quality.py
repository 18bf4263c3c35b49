"""Universe rules, screens and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.expr import clip, col, finite, safe_div
from crosspanel.operators import cross as X
from crosspanel.operators import rolling as R

# fixed values: name fragments that mark leveraged or inverse funds
LEVERAGED_WORDS = [
    "ultrapro", "ultrashort", "inverse", "leveraged", "proshares ultra", "direxion daily",
    " 2x", " 3x", "-2x", "-3x", "-1x", " 1.5x", " 2.5x",
]
# fixed values: ultra-short bond spellings, and fragments that overrule them
SHORT_BOND_WORDS = ["ultra-short", "ultra short"]
OVERRULING_WORDS = ["proshares", "direxion", " 2x", " 3x", "-3x", "inverse"]


def _mentions(name: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | name.contains(word)
    return hit


def is_leveraged(name="name", category="category") -> Column:
    """Leveraged or inverse by name, except plain ultra-short bond funds."""
    low = F.lower(F.coalesce(col(name), F.lit("")))
    hit = _mentions(low, LEVERAGED_WORDS) | F.coalesce(col(category) == "Trading", F.lit(False))
    bond = _mentions(low, SHORT_BOND_WORDS) & ~_mentions(low, OVERRULING_WORDS)
    return hit & ~bond


def enough_history(prices: DataFrame, min_days: int) -> DataFrame:
    """Rows of tickers with at least ``min_days`` priced days."""
    counted = prices.groupBy("ticker").agg(F.count("close").alias("days"))
    return prices.join(counted.filter(F.col("days") >= min_days).select("ticker"), "ticker", "left_semi")


def bad_ticks(grid: DataFrame, limit: float = 0.5) -> DataFrame:
    """Largest one-step move per ticker and whether it is beyond ``limit``."""
    moves = grid.select("ticker", F.abs(R.pct_change("close")).alias("move"))
    out = moves.groupBy("ticker").agg(F.max("move").alias("max_move"))
    return out.withColumn("bad_ticks", F.coalesce(F.col("max_move") > limit, F.lit(False)))


def delisted(prices: DataFrame, meta: DataFrame, days: int = 30) -> DataFrame:
    """Whether a ticker's last price is over ``days`` days before the panel end (none: true)."""
    live = prices.filter(F.col("close").isNotNull())
    last = live.groupBy("ticker").agg(F.max("date").alias("last_date"))
    end = prices.agg(F.max("date")).scalar()
    return (
        meta.select("ticker")
        .join(last, "ticker", "left")
        .withColumn("gap_days", F.datediff(end, F.col("last_date")))
        .withColumn("is_delisted", F.coalesce(F.col("gap_days") > days, F.lit(True)))
    )


def business_days_before(date, n: int) -> Column:
    """The n-th weekday before a date."""
    d = col(date)
    weekday = F.weekday(d)
    anchor = F.when(weekday >= 5, F.date_add(d, 7 - weekday)).otherwise(d)
    at = F.weekday(anchor)
    weeks, rest = divmod(n, 5)
    return F.date_sub(anchor, F.lit(7 * weeks + rest) + F.when(at < rest, 2).otherwise(0))


def survivors(prices: DataFrame, business_days: int = 10) -> DataFrame:
    """Tickers still priced within ``business_days`` of the panel end."""
    last = prices.filter(F.col("close").isNotNull()).groupBy("ticker").agg(F.max("date").alias("last_date"))
    end = prices.agg(F.max("date")).scalar()
    return last.filter(F.col("last_date") >= business_days_before(end, business_days))


def coverage(grid: DataFrame) -> DataFrame:
    """First and last priced date, priced days, calendar days between, and their ratio."""
    live = F.col("close").isNotNull()
    facts = grid.groupBy("ticker").agg(
        F.min(F.when(live, F.col("date"))).alias("start"),
        F.max(F.when(live, F.col("date"))).alias("end"),
        F.count("close").alias("n_obs"),
        (F.max(F.when(live, F.col("t"))) - F.min(F.when(live, F.col("t"))) + 1).alias("_span"),
    )
    return facts.select(
        "ticker", "start", "end", "n_obs",
        F.coalesce("_span", F.lit(0)).alias("span_days"),
        safe_div(F.col("n_obs"), F.col("_span")).alias("coverage"),
        (F.col("n_obs") == 0).alias("is_empty"),
    )


def with_adv(grid: DataFrame, k: int = 20) -> DataFrame:
    """Add the trailing mean of close x volume."""
    return grid.withColumn("adv", R.mean(F.col("close") * F.col("volume"), k))


def tradable(df: DataFrame, min_adv: float = 0.0, drop_flat: bool = True, ret: str = "fwd_ret") -> DataFrame:
    """Rows with a known return and liquidity, above the screen, without flat prints."""
    out = df.dropna(subset=[ret, "adv"])
    if drop_flat:
        out = out.filter(F.col(ret) != 0)
    return out.filter(F.col("adv") >= min_adv) if min_adv else out


def investable(df: DataFrame, min_price: float = 5.0, cap: float = 0.5, ret: str = "fwd_ret") -> DataFrame:
    return df.filter((F.col("close") >= min_price) & (F.abs(ret) <= cap))


def profile(
    df: DataFrame, features: Sequence[str], bins: int = 20, lower: float = 0.01, upper: float = 0.99
) -> tuple[DataFrame, DataFrame]:
    """(summary, histogram) of the features.

    The histogram counts values clipped to the lower and upper quantile in
    equal-width bins.
    """
    long = df.unpivot([], list(features), "feature", "x")
    rows = df.count()
    stats = long.groupBy("feature").agg(
        F.count("x").alias("n"),
        (1 - F.count("x") / F.count(F.lit(1))).alias("missing"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
        F.skewness("x").alias("_g1"),
    )
    n = F.col("n").cast("double")
    stats = stats.withColumn("skew", F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).drop("_g1")
    probs = {"p_lo": lower, "q25": 0.25, "median": 0.5, "q75": 0.75, "p_hi": upper}
    cuts = X.quantiles(long, ["feature"], "x", probs, group_rows=rows)
    summary = stats.join(F.broadcast(cuts), "feature")  # one row per feature name
    held = long.join(F.broadcast(cuts.select("feature", "p_lo", "p_hi")), "feature").filter(F.col("x").isNotNull())
    x = F.greatest(F.col("p_lo"), F.least(F.col("p_hi"), F.col("x")))
    place = F.floor(safe_div((x - F.col("p_lo")) * bins, F.col("p_hi") - F.col("p_lo")))
    histogram = (
        held.withColumn("bin", F.least(F.lit(bins - 1), F.coalesce(place, F.lit(0))))
        .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    return summary, histogram


def missing_share(grid: DataFrame, x: str = "close") -> DataFrame:
    return grid.agg((1 - F.count(x) / F.count(F.lit(1))).alias("missing"))


def winsor(df: DataFrame, columns: Sequence[str], bound: float) -> DataFrame:
    return df.withColumns({c: clip(finite(c), -bound, bound) for c in columns})


def fill_absent(df: DataFrame, extra: DataFrame, keys: Sequence[str], columns: Mapping[str, float]) -> DataFrame:
    """Left join optional columns and fill what is absent."""
    return df.join(extra.select(*keys, *columns), list(keys), "left").fillna(dict(columns))


def drop_missing(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how, subset=list(subset) if subset else None)


def active_per_date(grid: DataFrame) -> DataFrame:
    return grid.groupBy("date").agg(F.count("close").alias("active"))


def launches_per_year(prices: DataFrame) -> DataFrame:
    first = prices.filter(F.col("close").isNotNull()).groupBy("ticker").agg(F.min("date").alias("first"))
    return first.groupBy(F.year("first").alias("year")).agg(F.count(F.lit(1)).alias("launches"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("-")).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("facet", F.lit(column))

