"""Overfitting and significance statistics over a long (config, date, ret) table.

Such a table has one row per configuration and rebalance date: a few dozen
configurations by at most a calendar of dates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.expr import pearson, safe_div
from crosspanel.functions.stats import normal_cdf, normal_ppf, t_cdf
from crosspanel.operators import cross as X
from crosspanel.operators import evaluate as V
from crosspanel.operators import portfolio as PF
from crosspanel.session import materialise

GAMMA = 0.5772156649015329
#: Squarings of a correlation matrix after which only its first component is left: powers up to 2^14.
SQUARINGS = 14
DIMS = ["screen", "top", "buffer"]


def label_config() -> Column:
    """A readable name from the three grid settings."""
    return F.concat_ws("_", *[F.concat(F.lit(d), F.col(d).cast("string")) for d in DIMS])


def config_returns(
    scores: DataFrame, configs: Sequence[dict], horizon: int, cost_bps: float = 5.0, min_periods: int = 40,
    group_rows: int | None = None,
) -> DataFrame:
    """Net excess return of every configuration on the dates all of them have.

    All configurations run in one pass: rows of the rebalance dates of a screen
    are tagged with every configuration that has it.
    """
    # the screen alone decides which rows and dates a configuration sees; the other settings wait until the dates are thinned out
    screens = F.array(*[F.lit(x) for x in sorted({float(c["screen"]) for c in configs})])
    screened = scores.withColumn("screen", F.explode(screens)).filter(F.col("adv") >= F.col("screen"))
    due = materialise(PF.rebalance_rows(screened, horizon, ["screen"], min_rows=6), "due")
    tags = F.array(*[F.struct(*[F.lit(float(c[d])).alias(d) for d in DIMS]) for c in configs])
    tagged = due.withColumn("_c", F.explode(F.filter(tags, lambda c: c["screen"] == F.col("screen"))))
    rows = materialise(tagged.withColumns({d: F.col("_c")[d] for d in DIMS[1:]}).drop("_c"), "rebalance")
    if any(c["buffer"] for c in configs):
        basket = PF.buffered_baskets(rows, "top", "buffer", DIMS, group_rows=group_rows)
    else:
        basket = PF.top_basket(rows, F.col("top"), DIMS, group_rows=group_rows)
    held = PF.weigh(basket, "equal", DIMS, group_rows=group_rows)
    frame = PF.period_frame(rows, held, cost_bps, DIMS)
    frame = materialise(frame.select(*DIMS, "date", F.col("excess_net").alias("ret")), "periods")
    long_enough = frame.groupBy(*DIMS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_periods)
    frame = frame.join(long_enough.drop("_n"), DIMS, "left_semi")
    kept = long_enough.agg(F.count(F.lit(1))).scalar()
    common = frame.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == kept)
    return frame.join(common.select("date"), "date", "left_semi")


def config_ratio(returns: DataFrame, per_year: float, by: Sequence[str] = DIMS) -> DataFrame:
    sd = F.stddev_samp("ret")
    return returns.groupBy(*by).agg(
        F.count("ret").alias("periods"), F.avg("ret").alias("mean"), sd.alias("sd"),
        (safe_div(F.avg("ret"), sd) * math.sqrt(per_year)).alias("ir"))


def variance_shares(ratios: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Share of the ratio's variance between the levels of each grid dimension."""
    grand = ratios.agg(F.avg("ir")).scalar()
    parts = []
    for d in dims:
        level = F.avg("ir").over(Window.partitionBy(d))  # a few dozen rows
        part = ratios.select(level.alias("_m"), "ir").withColumn("_g", grand)
        parts.append(part.agg(
            F.lit(d).alias("dimension"),
            safe_div(F.sum((F.col("_m") - F.col("_g")) ** 2), F.sum((F.col("ir") - F.col("_g")) ** 2)).alias("share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlations(returns: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairwise correlation (a, b, corr) of the named configurations' returns, a <= b, over the dates both have."""
    kept = materialise(returns.filter(F.col("config").isin(list(names))).select("date", "config", "ret"), "returns")
    other = kept.select("date", F.col("config").alias("b"), F.col("ret").alias("y"))
    pairs = kept.select("date", F.col("config").alias("a"), F.col("ret").alias("x")).join(other, "date").filter("a <= b")
    return pairs.groupBy("a", "b").agg(pearson("x", "y").alias("corr"))


def effective_trials(returns: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean pairwise correlation and the participation ratio of the correlation matrix."""
    c = correlations(returns, names)
    off = F.col("a") != F.col("b")
    square = F.sum(F.when(off, 2.0).otherwise(1.0) * F.col("corr") ** 2)
    n = len(names)
    return c.agg(
        F.avg(F.when(off, F.col("corr"))).alias("mean_corr"), (F.lit(float(n * n)) / square).alias("n_effective"),
        F.lit(n).alias("n_nominal"))


def first_component_share(returns: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of the largest eigenvalue of the configurations' correlation matrix."""
    held = F.array(*[F.lit(n) for n in names])
    known = F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b").alias("pair"), "corr")))
    one = correlations(returns, names).filter("corr IS NOT NULL").agg(known.alias("known"))  # as large as the list of names, squared
    of = lambda a, b: F.try_element_at("known", F.struct(a.alias("a"), b.alias("b")))
    value = lambda a, b: F.when(a == b, 1.0).otherwise(F.coalesce(of(a, b), of(b, a), F.lit(0.0)))
    one = one.select(F.transform(held, lambda a: F.transform(held, lambda b: value(a, b))).alias("m"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def squared(b, _):
        """b * b over its trace, for a symmetric b; repeated, it turns to the projection on the first component."""
        trace = F.aggregate(b, F.lit(0.0), lambda s, r: s + dot(r, r))
        return F.element_at(F.transform(F.array(trace), lambda t: F.transform(b, lambda x: F.transform(b, lambda y: dot(x, y) / t))), 1)

    one = one.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), F.col("m"), squared))
    first = F.aggregate(F.zip_with("m", "p", dot), F.lit(0.0), lambda s, v: s + v)
    return one.select((first / F.size("m")).alias("pc1_share"))


def moments(returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-period ratio with the population skewness and (plain) kurtosis."""
    return returns.groupBy(*by).agg(
        F.count("ret").alias("periods"), safe_div(F.avg("ret"), F.stddev_samp("ret")).alias("sr"),
        F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))


def deflated_sharpe(returns: DataFrame, per_year: float, by: Sequence[str] = DIMS) -> DataFrame:
    """Probability that a configuration's ratio beats the best of as many zero-skill trials."""
    m = moments(returns, by)
    trials = m.agg(F.count("sr").cast("double").alias("n"), F.var_samp("sr").alias("v"))
    n, v = trials.select("n").scalar(), trials.select("v").scalar()
    m = m.withColumns({"n_trials": n, "_v": v})
    z1 = normal_ppf(1 - 1 / F.col("n_trials"))
    z2 = normal_ppf(1 - 1 / (F.col("n_trials") * math.e))
    m = m.withColumns({"_z1": z1, "_z2": z2})
    some = (F.col("n_trials") >= 2) & (F.col("_v") > 0)
    m = m.withColumn(
        "sr0", F.when(some, F.sqrt("_v") * ((1 - GAMMA) * F.col("_z1") + GAMMA * F.col("_z2"))).otherwise(0.0))
    sr = F.col("sr")
    inner = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    z = F.when(inner > 0, (sr - F.col("sr0")) * F.sqrt(F.col("periods") - 1.0) / F.sqrt(F.when(inner > 0, inner)))
    m = m.withColumn("_z", z).withColumn("dsr", normal_cdf(F.col("_z")))
    return m.select(*by, "periods", "sr", (sr * math.sqrt(per_year)).alias("sr_ann"), "sr0", "skew", "kurt", "dsr")


def split_blocks(returns: DataFrame, blocks: int) -> DataFrame:
    """Number the dates into consecutive, nearly equal blocks 0..blocks-1."""
    dates = returns.select("date").distinct()  # one row per rebalance date
    return returns.join(dates.withColumn("block", F.ntile(blocks).over(Window.orderBy("date")) - 1), "date")


def cscv_splits(returns: DataFrame, blocks: int = 10) -> DataFrame:
    """Winner of every in-sample half, its rank in and out of sample, and the logit.

    ``returns`` has (config, date, ret). Block sums are formed once; a split is a
    bit mask with half of the blocks set, and both halves follow from sums.
    """
    sums = split_blocks(returns, blocks).groupBy("config", "block").agg(
        F.count("ret").cast("double").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    masks = returns.sparkSession.range(1 << blocks).filter(F.bit_count("id") == blocks // 2)
    masks = masks.agg(F.sort_array(F.collect_list("id")).alias("m"))  # 252 masks for ten blocks
    sums = sums.withColumn("mask", F.explode(masks.scalar()))
    inside = F.getbit("mask", F.col("block").cast("long")) == 1

    def part(c, side):
        return F.sum(F.when(side, F.col(c)).otherwise(0.0))

    halves = sums.groupBy("mask", "config").agg(*[
        part(c, side).alias(f"{c}_{name}") for name, side in (("in", inside), ("out", ~inside)) for c in ("n", "s", "q")])

    def ratio(h):
        n, s, q = (F.col(f"{c}_{h}") for c in ("n", "s", "q"))
        var = (q - s * s / n) / (n - 1)
        # configurations with the same baskets differ only by rounding noise: make them ties
        return F.coalesce(F.round(safe_div(s / n, F.sqrt(F.when(var > 0, var))), 10), F.lit(float("-inf")))

    halves = halves.select("mask", "config", ratio("in").alias("sr_in"), ratio("out").alias("sr_out"))
    halves = X.pct_rank(halves, ["mask"], {"rank_in": "sr_in", "rank_out": "sr_out"}, group_rows=0)
    halves = halves.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("mask")))
    best = halves.groupBy("mask").agg(
        F.max("_c").alias("n_configs"),
        F.min_by(F.struct("config", "rank_in", "rank_out"), F.struct(-F.col("sr_in"), F.col("config"))).alias("b"))
    edge = 1.0 / (F.col("n_configs") + 1)
    rank = F.greatest(edge, F.least(1 - edge, F.col("b.rank_out")))
    best = best.select("mask", "n_configs", F.col("b.config").alias("winner"), F.col("b.rank_in").alias("rank_in"), rank.alias("rank_out"))
    return best.withColumn("logit", F.ln(F.col("rank_out") / (1 - F.col("rank_out"))))


def overfit_probability(splits: DataFrame) -> DataFrame:
    """Share of splits whose in-sample winner lands in the worse half out of sample."""
    return splits.agg(
        F.count(F.lit(1)).alias("n_combinations"), F.max("n_configs").alias("n_configs"),
        F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.percentile("logit", 0.5).alias("median_logit"),
        F.percentile("rank_out", 0.5).alias("median_oos_rank"))


def bootstrap_ratios(returns: DataFrame, per_year: float, draws: int, seed: str = "0") -> DataFrame:
    """Annualised ratio of ``draws`` resamples of one return series.

    Draw b takes position hash(b, j) for each j: an equi-join of draws and periods.
    """
    w = Window.orderBy("date")  # one row per period
    held = returns.select("ret", (F.row_number().over(w) - 1).cast("long").alias("pos"))
    n = held.count()
    picks = returns.sparkSession.range(draws).withColumnRenamed("id", "draw")
    picks = picks.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    text = F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("j").cast("string"))
    picks = picks.withColumn("pos", F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % n)
    joined = picks.join(held, "pos")
    return joined.groupBy("draw").agg(
        (safe_div(F.avg("ret"), F.stddev_samp("ret")) * math.sqrt(per_year)).alias("ir"))


def bootstrap_summary(returns: DataFrame, per_year: float, draws: int, seed: str = "0") -> DataFrame:
    """Point ratio, its t and plain standard error, bootstrap interval and share at or under zero."""
    boot = bootstrap_ratios(returns, per_year, draws, seed).agg(
        F.percentile("ir", 0.025).alias("low"), F.percentile("ir", 0.975).alias("high"),
        F.avg((F.col("ir") <= 0).cast("double")).alias("share_le_0"))
    sr = safe_div(F.avg("ret"), F.stddev_samp("ret"))
    n = F.count("ret")
    point = returns.agg(
        n.alias("periods"), (sr * math.sqrt(per_year)).alias("ir"), (sr * F.sqrt(n)).alias("t"),
        F.sqrt(F.lit(per_year) / n).alias("ir_se"))
    return point.withColumns({c: boot.select(c).scalar() for c in ("low", "high", "share_le_0")})


def with_p_values(df: DataFrame) -> DataFrame:
    """Add the one-sided Student and the two-sided normal p-value of ``t`` with ``periods`` observations."""
    df = df.withColumn("_df", F.col("periods").cast("double") - 1)
    return df.withColumns({
        "p_one_sided": 1 - t_cdf(F.col("t"), F.col("_df")),
        "p_two_sided": 2 * (1 - normal_cdf(F.abs("t"))),
    }).drop("_df")


def half_degradation(returns: DataFrame, per_year: float) -> DataFrame:
    """Do first-half ratios order second-half ratios? ``returns`` has (config, date, ret)."""
    dates = returns.select("date").distinct()
    place = F.row_number().over(Window.orderBy("date"))
    half = dates.withColumn("_i", place).withColumn("_first", F.col("_i") <= F.floor(F.lit(dates.count()) / 2))
    r = returns.join(half, "date")
    # configurations with the same baskets differ only by rounding noise: make them ties
    ratio = lambda cond: F.round(safe_div(
        F.avg(F.when(cond, F.col("ret"))), F.stddev_samp(F.when(cond, F.col("ret")))) * math.sqrt(per_year), 10)
    per = r.groupBy("config").agg(ratio(F.col("_first")).alias("a"), ratio(~F.col("_first")).alias("b"))
    per = X.average_rank(per, [], {"ra": "a", "rb": "b"}, group_rows=0)
    best = F.struct("a", F.col("config"))
    return per.agg(
        pearson("ra", "rb").alias("spearman"), safe_div(F.covar_pop("a", "b"), F.var_pop("a")).alias("slope"),
        (F.avg("b") - safe_div(F.covar_pop("a", "b"), F.var_pop("a")) * F.avg("a")).alias("intercept"),
        F.max_by("config", best).alias("best_config"), F.max("a").alias("best_first"),
        F.max_by("b", best).alias("its_second"), F.max("b").alias("best_second"))


def screened_ic(scores: DataFrame, screens: Sequence[float], lag: int, min_rows: int = 20, group_rows=None) -> DataFrame:
    """Significance of the daily rank IC under several liquidity screens at once."""
    tags = F.array(*[F.lit(float(s)) for s in screens])
    rows = scores.withColumn("screen", F.explode(tags)).filter(F.col("adv") >= F.col("screen"))
    ic = V.daily_rank_ic(rows, by=["screen"], min_rows=min_rows, group_rows=group_rows)
    return V.newey_west(ic, lag, by=["screen"])
