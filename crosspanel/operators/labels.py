"""Forward-looking labels. Feature code never imports this module.

Label tables carry their horizon and skip as columns, so splits derive their
purge from the label itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.expr import null_if_zero, pearson, safe_div
from crosspanel.operators import cross as X
from crosspanel.operators import rolling as R

GRID = ["date", "t", "ticker", "category", "close"]


def forward_return(horizon: int, skip: int = 0, x: str = "close") -> Column:
    """Return from row t+skip to row t+horizon (horizon is the end offset)."""
    start = R.lead(x, skip) if skip else F.col(x)
    return safe_div(R.lead(x, horizon), start) - 1


def _tagged(df: DataFrame, horizon: int, skip: int = 0) -> DataFrame:
    return df.withColumns({"horizon": F.lit(horizon), "skip": F.lit(skip)})


def relative_return(
    grid: DataFrame, horizon: int, skip: int = 0, null_self: bool = False, group_rows: int | None = None
) -> DataFrame:
    """Forward return and its excess over the leave-one-out category mean."""
    df = grid.withColumn("fwd_ret", forward_return(horizon, skip))
    df = X.add_loo(df, X.PEERS, {"_peer": "fwd_ret"}, null_self, group_rows)
    return _tagged(df.withColumn("rel", F.col("fwd_ret") - F.col("_peer")).drop("_peer"), horizon, skip)


def tercile_in_category(df: DataFrame, x: str, min_group: int, group_rows: int | None = None) -> DataFrame:
    """target 0 / 1 / 2 from the percentile rank of x in (date, category); NULL in thin groups."""
    df = X.pct_rank(df, X.PEERS, {"_pct": x}, group_rows)
    df = X.group_stats(df, X.PEERS, {"_size": F.count(x)}, group_rows)
    return df.withColumn("target", F.when(F.col("_size") >= min_group, X.tercile_of("_pct"))).drop("_pct", "_size")


def peer_tercile(grid: DataFrame, horizon: int, min_group: int, group_rows: int | None = None) -> DataFrame:
    """Tercile of the excess over the other members, within (date, category)."""
    df = relative_return(grid, horizon, 0, True, group_rows)
    return tercile_in_category(df, "rel", min_group, group_rows)


def benchmark_tercile(
    grid: DataFrame, horizon: int, min_group: int, benchmark: str = "median", group_rows: int | None = None
) -> DataFrame:
    """Tercile of the excess over the category median or mean."""
    df = grid.withColumn("fwd_ret", forward_return(horizon))
    if benchmark == "median":
        df = X.group_median(df, X.PEERS, {"bench": "fwd_ret"}, group_rows)
    else:
        df = X.group_stats(df, X.PEERS, {"bench": F.avg("fwd_ret")}, group_rows)
    df = df.withColumn("rel", F.col("fwd_ret") - F.col("bench"))
    return _tagged(tercile_in_category(df, "rel", min_group, group_rows), horizon)


def first_rank_tercile(grid: DataFrame, horizon: int, skip: int = 0, group_rows: int | None = None) -> DataFrame:
    """Universe-wide equal-count tercile of the peer-relative return per date."""
    df = relative_return(grid, horizon, skip, False, group_rows).filter(F.col("rel").isNotNull())
    return X.quantile_tile(df, X.DATE, "rel", "target", 3, group_rows=group_rows)


def universe_tercile(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """rel = fwd_ret minus the day's mean, and its universe tercile.

    ``df`` holds the tradable rows (known return and liquidity, no flat print).
    """
    df = X.group_stats(df, X.DATE, {"_mean": F.avg("fwd_ret")}, group_rows)
    df = df.withColumn("rel", F.col("fwd_ret") - F.col("_mean")).drop("_mean")
    df = X.pct_rank(df, X.DATE, {"_pct": "rel"}, group_rows)
    return df.withColumn("target", X.tercile_of("_pct")).drop("_pct")


def threshold_class(rel, threshold: float) -> Column:
    c = F.col(rel) if isinstance(rel, str) else rel
    return F.when(
        c.isNotNull(),
        F.when(c > threshold, "Outperform").when(c < -threshold, "Underperform").otherwise("Neutral"),
    )


def threshold_sweep(df: DataFrame, rel: str, thresholds: Sequence[float]) -> DataFrame:
    """Class shares in percent for each dead band, in one pass over the rows."""
    known = df.filter(F.col(rel).isNotNull())
    share = lambda cond: F.avg(cond.cast("double")) * 100
    items = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            share(F.col(rel) < -t).alias("under"),
            share(F.col(rel) > t).alias("over"),
        )
        for t in thresholds
    ]
    out = known.agg(F.array(*items).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return out.select("threshold", "under", (100 - F.col("under") - F.col("over")).alias("neutral"), "over")


def extremes(pct, lo: float, hi: float, above_only: bool = False) -> Column:
    """0 at or under lo, 2 at or over hi (over only with ``above_only``), else 1."""
    p = F.col(pct) if isinstance(pct, str) else pct
    top = p > hi if above_only else p >= hi
    return F.when(p.isNotNull(), F.when(top, 2).when(p <= lo, 0).otherwise(1))


def global_extremes(
    df: DataFrame, rel: str, lo: float = 0.15, hi: float = 0.85, rows: int | None = None
) -> DataFrame:
    """Three-class label cut at quantiles of the whole table, and its Extreme / Neutral collapse."""
    cuts = X.quantiles(df.filter(F.col(rel).isNotNull()), [], rel, {"lo": lo, "hi": hi}, rows)
    low, high = cuts.select("lo").scalar(), cuts.select("hi").scalar()
    c = F.col(rel)
    df = df.withColumn("target", F.when(c.isNotNull(), F.when(c <= low, 0).when(c >= high, 2).otherwise(1)))
    return df.withColumn(
        "binary", F.when(F.col("target") == 1, "Neutral").when(F.col("target").isNotNull(), "Extreme")
    )


def tail_flags(pct: str, threshold: float) -> dict[str, Column]:
    """y_top and y_ext: in the top tail, in either tail."""
    p = F.col(pct)
    top = p >= 1 - threshold
    return {"y_top": top.cast("int"), "y_ext": (top | (p <= threshold)).cast("int")}


def scaled_excess(df: DataFrame, horizon: int, group_rows: int | None = None) -> DataFrame:
    """rel in units of horizon-scaled volatility, and the excess over the market mean.

    ``df`` carries fwd_ret, rel and vol_20d.
    """
    df = X.group_stats(df, X.DATE, {"_mkt": F.avg("fwd_ret")}, group_rows)
    return df.withColumns({
        "rel_ir": safe_div("rel", null_if_zero(F.col("vol_20d") * float(horizon) ** 0.5)),
        "rel_mkt": F.col("fwd_ret") - F.col("_mkt"),
    }).drop("_mkt")


def dispersion_normalised(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """rel over its (date, category) deviation, ranked again per date."""
    df = X.group_stats(df, X.PEERS, {"_sd": F.stddev_samp("rel")}, group_rows)
    df = df.withColumn("rel_norm", safe_div("rel", null_if_zero("_sd"))).drop("_sd")
    return X.pct_rank(df, X.DATE, {"pct_norm": "rel_norm"}, group_rows)


# category-size bins (upper edges) and their names
SIZE_BINS = [(5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50")]


def size_bin(n) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    out = F.when(c <= SIZE_BINS[0][0], SIZE_BINS[0][1])
    for edge, name in SIZE_BINS[1:]:
        out = out.when(c <= edge, name)
    return out.otherwise("50+")


def boundary_distance(df: DataFrame, min_group: int, group_rows: int | None = None) -> DataFrame:
    """Distance of a row's in-category percentile to the nearer tercile cut, by category size."""
    df = X.pct_rank(df, X.PEERS, {"_pct": "rel"}, group_rows)
    df = X.group_stats(df, X.PEERS, {"_n": F.count("rel")}, group_rows)
    df = df.filter(F.col("_pct").isNotNull() & (F.col("_n") >= min_group))
    dist = F.least(F.abs(F.col("_pct") - 1 / 3), F.abs(F.col("_pct") - 2 / 3))
    df = df.select(size_bin("_n").alias("size_bin"), dist.alias("_d"))
    return df.groupBy("size_bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_distance"),
        F.avg((F.col("_d") < 0.05).cast("double")).alias("share_close"),
    )


def class_balance(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class (and group), with the share inside the group."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(*by, target).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
        return counts.join(totals, list(by)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def class_mix(df: DataFrame, row: Column, target: str, classes: Sequence) -> DataFrame:
    """Class shares in percent per row key, one column per class."""
    known = df.filter(F.col(target).isNotNull())
    shares = [(F.avg((F.col(target) == c).cast("double")) * 100).alias(f"class_{c}") for c in classes]
    return known.groupBy(row.alias("key")).agg(*shares)


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """How often two labelings agree: one row per pair of classes with its share of all rows."""
    both = a.select(*keys, F.col("target").alias("left")).join(b.select(*keys, F.col("target").alias("right")), list(keys))
    both = both.filter(F.col("left").isNotNull() & F.col("right").isNotNull())
    pairs = both.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.col("n") / pairs.agg(F.sum("n")).scalar())


def measure_horizon(
    stored: DataFrame, horizons: Sequence[int], skips: Sequence[int] = (0, 1, 5, 10), min_overlap: int = 1000
) -> DataFrame:
    """Which (horizon, skip) a stored fwd_ret column was built with.

    ``stored`` is the dense grid with close and fwd_ret. Every candidate is
    rebuilt from leads in one pass and correlated; the best is the answer.
    """
    pairs = [(h, s) for s in skips for h in horizons if h > s]
    offsets = sorted({o for p in pairs for o in p if o})
    df = stored.withColumns({f"_l{o}": R.lead("close", o) for o in offsets})
    ahead = lambda o: F.col(f"_l{o}") if o else F.col("close")
    items = []
    for h, s in pairs:
        made = safe_div(ahead(h), ahead(s)) - 1
        items.append(F.struct(
            pearson("fwd_ret", made).alias("corr"),
            F.count(F.when(F.col("fwd_ret").isNotNull() & made.isNotNull(), 1)).alias("overlap"),
            F.lit(h).alias("horizon"), F.lit(s).alias("skip")))
    out = df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    out = out.filter(F.col("overlap") >= min_overlap)
    best = out.agg(F.max_by(F.struct("horizon", "skip", "corr"), F.struct("corr", -F.col("skip"), -F.col("horizon"))).alias("b"))
    return best.select("b.*")


def benchmark_gap(grid: DataFrame, horizon: int, group_rows: int | None = None) -> DataFrame:
    """Median absolute difference of category mean and median forward return, by category size."""
    sizes = grid.groupBy("category").agg(F.countDistinct("ticker").alias("_members"))
    df = grid.withColumn("fwd_ret", forward_return(horizon))
    per = df.groupBy("date", "category").agg(
        F.avg("fwd_ret").alias("_mean"), F.count(F.lit(1)).alias("members"))
    med = X.quantiles(df, X.PEERS, "fwd_ret", {"_median": 0.5}, group_rows)
    per = per.join(med, X.PEERS).join(sizes, "category")
    per = per.select(size_bin("_members").alias("size_bin"), F.abs(F.col("_mean") - F.col("_median")).alias("gap"), "members")
    # every member row carries its group's gap: weight the groups by their rows
    rows = per.filter(F.col("gap").isNotNull())
    return weighted_median(rows, ["size_bin"], "gap", "members")


def weighted_median(df: DataFrame, keys: Sequence[str], x: str, weight: str) -> DataFrame:
    """Median of x when every row stands for ``weight`` equal rows."""
    steps = X.ladder(df, keys, x, {"w": F.col(weight)})
    pos = 0.5 * (F.col("w_all") - 1)
    lo = F.min(F.when(F.col("w_le") > F.floor(pos), F.col(x)))
    hi = F.min(F.when(F.col("w_le") > F.ceil(pos), F.col(x)))
    return steps.groupBy(*keys).agg(((lo + hi) / 2).alias("median"), F.max("w_all").alias("rows"))
