"""Portfolio return tables: set-based operators over a score table.

Every operator takes ``by``: key columns that tell portfolios apart (an arm, a
configuration), so many portfolios are computed in one pass. ``k`` numbers the
kept rebalance dates of a portfolio 0, 1, ...
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.functions.expr import bankers_round, pearson, safe_div
from crosspanel.operators import cross as X

# -- dates and configurations -----------------------------------------------------------


def number_dates(df: DataFrame, by: Sequence[str] = (), out: str = "k") -> DataFrame:
    """Number the distinct dates of each portfolio; the numbering itself is calendar-sized."""
    dates = df.select(*by, "date").distinct()
    w = Window.partitionBy(*by).orderBy("date")
    return df.join(dates.withColumn(out, F.row_number().over(w) - 1), [*by, "date"])


def rebalance_rows(df: DataFrame, horizon: int, by: Sequence[str] = (), min_rows: int = 1) -> DataFrame:
    """Rows on every horizon-th date of each portfolio.

    Dates are counted before the size filter, and dates with fewer than
    ``min_rows`` rows are then left out. Adds ``_size``.
    """
    sizes = df.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("_size"))
    i = F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1
    kept = sizes.withColumn("_i", i).filter((F.col("_i") % horizon == 0) & (F.col("_size") >= min_rows))
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1).drop("_i")
    return df.join(kept, [*by, "date"])


def config_grid(spark: SparkSession, **dims: Sequence) -> list[dict]:
    """All combinations of a few settings, as plain dictionaries."""
    return [dict(zip(dims, values)) for values in itertools.product(*dims.values())]


def spread_of(adv: str, tiers: Sequence[tuple[float, float]]) -> Column:
    """Spread of the first tier whose floor the liquidity reaches; tiers go from high to low."""
    out = F.when(F.col(adv) >= tiers[0][0], F.lit(float(tiers[0][1])))
    for floor, bps in tiers[1:]:
        out = out.when(F.col(adv) >= floor, F.lit(float(bps)))
    return out


# -- baskets ----------------------------------------------------------------------------


def basket_size(size: Column, top, least: int = 3) -> Column:
    """Top share of a day's rows, rounded half to even, but not fewer than ``least``."""
    share = F.lit(float(top)) if isinstance(top, (int, float)) else top
    return F.greatest(bankers_round(size * share), F.lit(least))


def top_basket(
    rows: DataFrame, top, by: Sequence[str] = (), score: str = "score", least: int = 3, group_rows: int | None = None
) -> DataFrame:
    """Best-scored rows of each rebalance date; ties go to the earlier ticker."""
    ranked = X.ordinal(rows, [*by, "date"], score, "_ord", True, group_rows=group_rows)
    return ranked.filter(F.col("_ord") <= basket_size(F.col("_size"), top, least)).drop("_ord")


def weigh(basket: DataFrame, kind: str, by: Sequence[str] = (), score: str = "score", group_rows=None) -> DataFrame:
    """Weights that add up to one per date: equal, by score above the lowest, or by inverse volatility."""
    keys = [*by, "date"]
    if kind == "score":
        basket = X.group_stats(basket, keys, {"_low": F.min(score)}, group_rows)
        raw = F.col(score) - F.col("_low") + 1e-9
    elif kind == "invvol":
        raw = safe_div(F.lit(1.0), F.greatest(F.col("vol_20d"), F.lit(1e-4)))
    else:
        raw = F.lit(1.0)
    basket = X.group_stats(basket.withColumn("_raw", raw), keys, {"_sum": F.sum("_raw")}, group_rows)
    return basket.withColumn("w", F.col("_raw") / F.col("_sum")).drop("_raw", "_sum", "_low")


def turnover(held: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of absolute weight changes from one kept date to the next, per (by, k).

    Every holding is emitted with its weight at k and minus its weight at k + 1,
    so one aggregate over (k, ticker) replaces a join of consecutive baskets.
    """
    marks = F.array(
        F.struct(F.col("k").alias("k"), F.col("w").alias("w"), F.lit(1).alias("now")),
        F.struct((F.col("k") + 1).alias("k"), (-F.col("w")).alias("w"), F.lit(0).alias("now")),
    )
    rows = held.select(*by, "ticker", F.explode(marks).alias("m")).select(*by, "ticker", "m.*")
    net = rows.groupBy(*by, "k", "ticker").agg(F.sum("w").alias("d"), F.max("now").alias("now"))
    out = net.groupBy(*by, "k").agg(F.sum(F.abs("d")).alias("turn"), F.max("now").alias("now"))
    return out.filter(F.col("now") == 1).drop("now")


def period_frame(
    rows: DataFrame, held: DataFrame, cost_bps: float | Column, by: Sequence[str] = (), ret: str = "fwd_ret"
) -> DataFrame:
    """One row per kept date: portfolio and universe return, turnover, cost, net excess, holdings.

    ``rows`` are the candidates of each rebalance date, ``held`` the weighted picks.
    """
    bench = rows.groupBy(*by, "date", "k").agg(F.avg(ret).alias("bench"))
    port = held.groupBy(*by, "k").agg(F.sum(F.col(ret) * F.col("w")).alias("port"), F.count(F.lit(1)).alias("n"))
    bps = F.lit(float(cost_bps)) if isinstance(cost_bps, (int, float)) else cost_bps
    out = bench.join(port, [*by, "k"]).join(turnover(held, by), [*by, "k"])
    out = out.withColumn("cost", F.col("turn") * bps / 1e4)
    return out.withColumn("excess_net", F.col("port") - F.col("bench") - F.col("cost"))


def backtest(
    scores: DataFrame, horizon: int, top: float, cost_bps=5.0, weight: str = "equal", by: Sequence[str] = (),
    group_rows: int | None = None,
) -> DataFrame:
    """Long-only top basket, rebalanced every ``horizon`` dates."""
    rows = rebalance_rows(scores, horizon, by, min_rows=6)
    held = weigh(top_basket(rows, top, by, group_rows=group_rows), weight, by, group_rows=group_rows)
    return period_frame(rows, held, cost_bps, by)


def buffered_baskets(
    rows: DataFrame, top: str, buffer: str, by: Sequence[str], score: str = "score", group_rows: int | None = None
) -> DataFrame:
    """Baskets in which incumbents inside a widened band stay.

    ``top`` and ``buffer`` are columns of ``by``. Each basket depends on the one before, so the dates of a portfolio are passed in order,
    and what is carried from date to date is the basket alone. Only a date's best ``band + n`` rows can matter: incumbents must
    be in the band, and of the rest at most n outsiders are needed, of which at most n are passed over as incumbents. These
    rows are streamed, sorted, through the tasks; a task never holds more than one date of them.
    """
    keys = list(by)
    ranked = X.ordinal(rows, [*keys, "date"], score, "_ord", True, group_rows=group_rows)
    ranked = ranked.withColumn("_n", basket_size(F.col("_size"), F.col(top)))
    ranked = ranked.withColumn("_band", F.least(F.floor(F.col("_n") * (1 + F.col(buffer))), F.col("_size")))
    cand = ranked.filter(F.col("_ord") <= F.col("_band") + F.col("_n")).select(
        *keys, "k", "ticker", "_ord", "_n", F.when(F.col(buffer) > 0, F.col("_band")).otherwise(0).alias("_band"))
    ordered = cand.repartition(*keys).sortWithinPartitions(*keys, "k", "_ord")
    schema = T.StructType([f for f in cand.schema.fields if f.name in (*keys, "k", "ticker")])
    picks = ordered.mapInPandas(lambda frames: _carried(frames, keys), schema)
    return rows.join(picks, [*keys, "k", "ticker"], "left_semi")


def _carried(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Pick the basket of each date from its candidates, sorted by portfolio, date and rank."""
    names = [*keys, "k", "ticker"]
    incumbents: dict[str, int] = {}
    portfolio, today, pending = None, None, []

    def settle():
        # incumbents keep their place while inside the band; outsiders fill up in the order of their ranks
        size = pending[0][2]
        stay = [t for t, rank, _, band in pending if t in incumbents and rank <= band][:size]
        eligible = (t for t, _, _, band in pending if not (band and t in incumbents))
        return stay + list(itertools.islice(eligible, size - len(stay)))

    out: list[tuple] = []
    for frame in frames:
        for *group, k, ticker, rank, size, band in frame[[*names, "_ord", "_n", "_band"]].itertuples(index=False, name=None):
            if (group, k) != (portfolio, today) and pending:
                basket = settle()
                out += [(*portfolio, today, t) for t in basket]
                incumbents, pending = dict.fromkeys(basket, 0), []
            if group != portfolio:
                incumbents = {}
            portfolio, today = group, k
            pending.append((ticker, rank, size, band))
        if out:
            yield pd.DataFrame(out, columns=names)
            out = []
    if pending:
        yield pd.DataFrame([(*portfolio, today, t) for t in settle()], columns=names)


# -- summaries --------------------------------------------------------------------------


def summary(periods: DataFrame, r: str, per_year: float, by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Annualised mean, volatility, ratio, t, hit rate of a return series."""
    sd = F.stddev_samp(r) if ddof == 1 else F.stddev_pop(r)
    mean = F.avg(r)
    aggs = [
        F.count(r).alias("n"), (mean * per_year).alias("ann"), (sd * per_year**0.5).alias("vol"),
        safe_div(mean * per_year, sd * per_year**0.5).alias("ir"), safe_div(mean, sd / F.sqrt(F.count(r))).alias("t"),
        F.avg((F.col(r) > 0).cast("double")).alias("hit"),
    ]
    if "turn" in periods.columns:
        aggs.append(F.avg("turn").alias("turn"))
    return periods.groupBy(*by).agg(*aggs) if by else periods.agg(*aggs)


def series_frame(by: Sequence[str] = (), order: str = "date"):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def equity(periods: DataFrame, r: str, by: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Running sum and compounded growth of a return series, with the drawdown of each."""
    w = series_frame(by, order)
    x = F.coalesce(F.col(r), F.lit(0.0))
    df = periods.withColumns({"cum": F.sum(x).over(w), "growth": F.exp(F.sum(F.log1p(x)).over(w))})
    return df.withColumns({
        "dd_add": F.col("cum") - F.max("cum").over(w),
        "dd_mult": F.col("growth") / F.max("growth").over(w) - 1,
    })


def against_benchmark(periods: DataFrame, r: str, bench: str, per_year: float, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and correlation to a benchmark, with excess ratio, t and hit rate."""
    known = periods.filter(F.col(r).isNotNull() & F.col(bench).isNotNull()).withColumn("_ex", F.col(r) - F.col(bench))
    beta = safe_div(F.covar_pop(r, bench), F.var_pop(bench))
    sd = F.stddev_samp("_ex")
    aggs = [
        F.count(F.lit(1)).alias("n"), beta.alias("beta"),
        ((F.avg(r) - beta * F.avg(bench)) * per_year).alias("alpha"), pearson(r, bench).alias("corr"),
        (F.avg("_ex") * per_year).alias("excess"), safe_div(F.avg("_ex") * per_year, sd * per_year**0.5).alias("ir"),
        safe_div(F.avg("_ex"), sd / F.sqrt(F.count(F.lit(1)))).alias("t"), F.avg((F.col("_ex") > 0).cast("double")).alias("hit"),
    ]
    return known.groupBy(*by).agg(*aggs) if by else known.agg(*aggs)


def by_year(periods: DataFrame, r: str, by: Sequence[str] = ()) -> DataFrame:
    return periods.groupBy(*by, F.year("date").alias("year")).agg(
        F.count(r).alias("n"), F.sum(r).alias("total"), F.avg(r).alias("mean"),
        F.avg((F.col(r) > 0).cast("double")).alias("hit"))


def breakeven(periods: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spread in basis points at which the gross excess is used up by turnover."""
    gross = F.avg(F.col("port") - F.col("bench"))
    return periods.groupBy(*by).agg(
        gross.alias("gross"), F.avg("turn").alias("turn"), (gross / F.greatest(F.avg("turn"), F.lit(1e-9)) * 1e4).alias("breakeven_bps"))


def category_tilt(picks: DataFrame, universe: DataFrame, top: int | None = None) -> DataFrame:
    """Category shares of the picks minus those of the universe's tickers, largest first."""
    def shares(df, name):
        counts = df.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
        return counts.select("category", (F.col("_n") / counts.agg(F.sum("_n")).scalar()).alias(name))

    members = universe.select("ticker", "category").distinct()
    out = shares(picks, "pick_share").join(shares(members, "universe_share"), "category", "left")
    out = out.withColumn("tilt", F.col("pick_share") - F.coalesce("universe_share", F.lit(0.0)))
    return out.orderBy(F.col("tilt").desc(), "category").limit(top) if top else out


# -- other portfolio shapes ---------------------------------------------------------------


def forward_series(series: DataFrame, horizon: int, out: str) -> DataFrame:
    """Forward return of one dated price series (one row per date)."""
    w = Window.orderBy("date")
    return series.select("date", (safe_div(F.lead("close", horizon).over(w), "close") - 1).alias(out))


def long_short(
    scores: DataFrame, horizon: int, n: int, cost_bps: float, by: Sequence[str] = (), group_rows: int | None = None
) -> DataFrame:
    """Long the n best, short the n worst; turnover counts names that changed on either side."""
    rows = rebalance_rows(scores, horizon, by, min_rows=2 * n)
    keys = [*by, "date"]
    best = X.ordinal(rows, keys, "score", "_hi", True, group_rows=group_rows)
    both = X.ordinal(best, keys, "score", "_lo", False, group_rows=group_rows)
    side = F.when(F.col("_hi") <= n, 1).when(F.col("_lo") <= n, -1)
    legs = both.withColumn("side", side)
    legs_frame = legs.groupBy(*by, "date", "k").agg(
        F.avg(F.when(F.col("side") == 1, F.col("fwd_ret"))).alias("long"),
        F.avg(F.when(F.col("side") == -1, F.col("fwd_ret"))).alias("short"), F.avg("fwd_ret").alias("bench"))
    held = legs.filter(F.col("side").isNotNull()).select(
        *by, "k", F.concat_ws(":", F.col("side").cast("string"), "ticker").alias("ticker"), F.lit(1.0 / (2 * n)).alias("w"))
    out = legs_frame.join(turnover(held, by), [*by, "k"]).withColumn("gross", F.col("long") - F.col("short"))
    return out.withColumn("cost", F.col("turn") * cost_bps / 1e4).withColumn("net", F.col("gross") - F.col("cost"))


def conviction_long_short(
    df: DataFrame, horizon: int, gate: str, momentum: str, q: float, cost_bps: float, group_rows: int | None = None
) -> DataFrame:
    """Among rows whose gate probability reaches the day's q quantile, long rising and short falling ones.

    Dates on which a leg is empty are left out, and turnover compares with the last kept date.
    """
    rows = rebalance_rows(df, horizon)
    cuts = X.quantiles(rows, X.DATE, gate, {"_cut": q}, group_rows)
    side = F.when(F.col(momentum) > 0, 1).when(F.col(momentum) < 0, -1)
    picks = rows.join(cuts, "date").filter(F.col(gate) >= F.col("_cut")).withColumn("side", side).filter(F.col("side").isNotNull())
    legs = picks.groupBy("date").agg(
        F.avg(F.when(F.col("side") == 1, F.col("fwd_ret"))).alias("long"),
        F.avg(F.when(F.col("side") == -1, F.col("fwd_ret"))).alias("short"),
        F.count(F.when(F.col("side") == 1, 1)).alias("n_long"), F.count(F.when(F.col("side") == -1, 1)).alias("n_short"))
    legs = legs.filter((F.col("n_long") > 0) & (F.col("n_short") > 0))
    legs = legs.withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)  # one row per date
    held = picks.join(legs.select("date", F.col("k").alias("_k"), "n_long", "n_short"), "date").select(
        F.col("_k").alias("k"), F.concat_ws(":", F.col("side").cast("string"), "ticker").alias("ticker"),
        (1.0 / (F.col("n_long") + F.col("n_short"))).alias("w"))
    # names that changed over names held now
    marks = held.select("ticker", F.explode(F.array(
        F.struct(F.col("k").alias("k"), F.lit(1).alias("m")), F.struct((F.col("k") + 1).alias("k"), F.lit(-1).alias("m")))).alias("x"))
    moved = marks.select("ticker", "x.k", "x.m").groupBy("k", "ticker").agg(F.sum("m").alias("m"))
    moved = moved.groupBy("k").agg(F.sum(F.abs("m")).alias("changed"))
    out = legs.join(moved, "k").withColumn("turn", F.col("changed") / (F.col("n_long") + F.col("n_short")))
    out = out.withColumn("gross", F.col("long") - F.col("short")).withColumn("cost", F.col("turn") * cost_bps / 1e4)
    return out.withColumn("net", F.col("gross") - F.col("cost")).drop("changed")


def core_satellite(
    df: DataFrame, horizon: int, risk: str, direction: str, cost_bps: float, core: tuple[float, float] = (0.40, 0.85),
    satellite: tuple[float, float] = (0.10, 0.15), group_rows: int | None = None,
) -> DataFrame:
    """A calm core and a bold satellite: (share of rows, weight) each; the satellite skips core names."""
    rows = rebalance_rows(df, horizon, min_rows=10)
    calm = X.ordinal(rows, X.DATE, risk, "_calm", False, group_rows=group_rows)
    n_core = F.greatest(bankers_round(F.col("_size") * core[0]), F.lit(5))
    n_sat = F.greatest(bankers_round(F.col("_size") * satellite[0]), F.lit(2))
    calm = calm.withColumns({"_in_core": F.col("_calm") <= n_core, "_bold": F.col(risk) * F.greatest(F.col(direction), F.lit(0.0))})
    pool = X.ordinal(calm.filter(~F.col("_in_core")), X.DATE, "_bold", "_sat", True, group_rows=group_rows)
    sat = pool.filter(F.col("_sat") <= n_sat).drop("_sat")
    picks = calm.filter("_in_core").withColumn("part", F.lit("core")).unionByName(sat.withColumn("part", F.lit("satellite")))
    picks = X.group_stats(picks, ["date", "part"], {"_m": F.count(F.lit(1))}, group_rows)
    share = F.when(F.col("part") == "core", core[1]).otherwise(satellite[1])
    held = picks.withColumn("w", share / F.col("_m"))
    out = period_frame(rows, held, cost_bps)
    sizes = held.groupBy("k").agg(F.count(F.when(F.col("part") == "core", 1)).alias("n_core"), F.count(F.when(F.col("part") == "satellite", 1)).alias("n_sat"))
    return out.join(sizes, "k")


def overlapping_cohorts(picks: DataFrame, returns: DataFrame, horizon: int, cost_bps: float) -> DataFrame:
    """Every date's basket held for ``horizon`` rows; the daily return averages the live cohorts.

    ``picks`` has (t, ticker), ``returns`` has (date, t, ticker, ret_1d). A round
    trip is charged on a cohort's first day, shared among the horizon's cohorts.
    """
    live = picks.select("ticker", F.col("t").alias("_from"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
    live = live.select("ticker", "_from", "_h", (F.col("_from") + F.col("_h")).alias("t"))
    cohort = live.join(returns, ["t", "ticker"]).groupBy("date", "t", "_from", "_h").agg(F.avg("ret_1d").alias("_r"))
    day = cohort.groupBy("date", "t").agg(
        (F.sum("_r") / horizon).alias("gross"), F.count(F.lit(1)).alias("cohorts"),
        (F.count(F.when(F.col("_h") == 1, 1)) / horizon * (2 * cost_bps / 1e4)).alias("cost"))
    return day.withColumn("net", F.col("gross") - F.col("cost")).drop("t")


def quantile_books(df: DataFrame, horizon: int, q: int, group_rows: int | None = None) -> DataFrame:
    """Mean forward return of each score quantile on every rebalance date."""
    rows = rebalance_rows(df, horizon, min_rows=q)
    tiled = X.quantile_tile(rows.drop("_size"), X.DATE, "score", "tile", q, group_rows=group_rows)
    return tiled.groupBy("date", "tile").agg(F.avg("fwd_ret").alias("ret"), F.count(F.lit(1)).alias("n"))
