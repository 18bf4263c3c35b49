"""Attribute, market-state and spillover feature sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.operators import cross as X
from crosspanel.operators import peers as G
from crosspanel.operators import rolling as R


def align_composition(comp: DataFrame, universe: DataFrame, sectors: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Composition rows for every ticker of the universe.

    Where any asset-class weight is known, an absent sector weight means zero;
    otherwise it stays missing.
    """
    known = F.lit(False)
    for c in classes:
        known = known | F.col(c).isNotNull()
    out = universe.join(comp, "ticker", "left")
    return out.withColumns({c: F.when(known, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)) for c in sectors})


def composition(
    grid: DataFrame, comp: DataFrame, sectors: Sequence[str], static: Sequence[str], ranked: Sequence[str],
    tilt: str = "pos_stock", group_rows: int | None = None,
) -> DataFrame:
    """Static attributes on live days plus four peer-relative columns."""
    comp = G.mix_distance(comp, sectors, ["category"], "sec_dist_cat", group_rows)
    comp = X.group_stats(comp, ["category"], {"_tilt": F.avg(tilt)}, group_rows)
    comp = comp.withColumn(f"{tilt}_catrel", F.col(tilt) - F.col("_tilt")).drop("_tilt", "category")
    names = [*sectors, *static, "sec_dist_cat", f"{tilt}_catrel"]
    out = grid.select("date", "t", "ticker", "category", "close").join(comp, "ticker", "left")
    out = out.withColumns({c: F.when(F.col("close").isNotNull(), F.col(c)) for c in names})
    out = X.pct_rank(out, X.PEERS, {f"{c}_catrank": c for c in ranked}, group_rows)
    return out.select("date", "ticker", *names, *[f"{c}_catrank" for c in ranked])


# market proxies a day-state can be built on, by role
ROLES = ["equity", "rates", "short_rates", "high_yield", "investment_grade", "gold", "dollar"]


def day_states(grid: DataFrame, proxies: Mapping[str, str]) -> DataFrame:
    """One row per date: market states from proxy tickers, breadth and dispersion.

    ``grid`` carries r1, close and sma_50. ``proxies`` maps a role to a ticker; a
    missing equity proxy falls back to the mean return, other missing roles
    leave their state out.
    """
    role_return = {
        role: F.max(F.when(F.col("ticker") == F.lit(t), F.col("r1"))) for role, t in proxies.items()
    }
    above = F.when(F.col("close").isNotNull(), F.coalesce((F.col("close") > F.col("sma_50")).cast("double"), F.lit(0.0)))
    day = G.date_series(grid, _mkt=F.avg("r1"), mkt_breadth_50=F.avg(above), _sd=F.stddev_samp("r1"), **role_return)
    if "equity" not in proxies:
        day = day.withColumn("equity", F.col("_mkt"))
    sum20 = lambda c: G.series_stat(F.sum, c, 20)
    states = {
        "mkt_eq_trend_20d": sum20("equity"),
        "mkt_eq_vol_20d": G.series_stat(F.stddev_samp, "equity", 20),
        "mkt_disp_5d": G.series_stat(F.avg, "_sd", 5),
    }
    if "rates" in proxies:
        states["mkt_rates_mom_20d"] = sum20("rates")
        if "short_rates" in proxies:
            states["mkt_curve_mom_20d"] = sum20("rates") - sum20("short_rates")
    if "high_yield" in proxies and "investment_grade" in proxies:
        states["mkt_credit_mom_20d"] = sum20("high_yield") - sum20("investment_grade")
    if "gold" in proxies:
        states["mkt_gold_mom_20d"] = sum20("gold")
    if "dollar" in proxies:
        states["mkt_dollar_mom_20d"] = sum20("dollar")
    extra = ["rates"] if "rates" in proxies else []
    return day.withColumns(states).select("date", "_mkt", *extra, *states, "mkt_breadth_50")


def market_state(grid: DataFrame, proxies: Mapping[str, str], group_rows: int | None = None) -> DataFrame:
    """Day states on live rows plus exposures times states (and exposure ranks)."""
    g = grid.select("date", "t", "ticker", "category", "close").withColumns(
        {"r1": R.pct_change("close"), "sma_50": R.mean("close", 50)}
    )
    days = day_states(g, proxies)
    states = [c for c in days.columns if c.startswith("mkt_")]
    # one row per calendar date; the planner broadcasts it only while it is small
    g = g.join(days, "date", "left")
    sums = R.pair_sums("m", "r1", "_mkt", 60)
    exposure = {"beta_60d": R.pair_beta("m", 60)}
    if "rates" in proxies:
        sums |= R.pair_sums("d", "r1", "rates", 60)
        exposure["dur_corr_60d"] = R.pair_corr("d", 60)
    g = g.withColumns(sums).withColumns(exposure)
    out = {
        **{s: F.when(F.col("close").isNotNull(), F.col(s)) for s in states},
        "beta_x_eqtrend": F.col("beta_60d") * F.col("mkt_eq_trend_20d"),
        "beta_x_eqvol": F.col("beta_60d") * F.col("mkt_eq_vol_20d"),
    }
    ranks = {"beta_x_eqvol_catrank": "beta_x_eqvol"}
    if "rates" in proxies:
        out["durcorr_x_ratesmom"] = F.col("dur_corr_60d") * F.col("mkt_rates_mom_20d")
        ranks["durcorr_catrank"] = "dur_corr_60d"
    # interactions first: they read the unmasked states
    g = g.withColumns({k: v for k, v in out.items() if k not in states})
    g = g.withColumns({s: out[s] for s in states})
    g = X.pct_rank(g, X.PEERS, ranks, group_rows)
    names = [*states, "beta_x_eqtrend", "beta_x_eqvol", *(["dur_corr_60d", "durcorr_x_ratesmom"] if "rates" in proxies else []), *ranks]
    return g.select("date", "ticker", *names)


INTERACTIONS = [
    "beta_x_eqvol", "beta_x_eqtrend", "beta_x_eqvol_catrank", "dur_corr_60d", "durcorr_x_ratesmom", "durcorr_catrank",
]


def spillover(grid: DataFrame, group_rows: int | None = None) -> DataFrame:
    """How far a ticker lags its peers, whether it follows them, and category rotation."""
    g = grid.select("date", "t", "ticker", "category", "close").withColumns(
        {"r1": R.pct_change("close"), "r5": R.pct_change("close", 5), "r20": R.pct_change("close", 20)}
    )
    g = X.add_loo(g, X.PEERS, {"peer1": "r1", "peer5": "r5", "peer20": "r20"}, False, group_rows)
    g = G.category_rank(g, "r20", "cat_mom_rank_20d")
    g = G.category_rank(g, "r5", "cat_mom_rank_5d")
    g = g.withColumns({
        "spill_gap_5d": R.lag(F.col("peer5") - F.col("r5")),
        "spill_gap_20d": R.lag(F.col("peer20") - F.col("r20")),
        "peer1_before": R.lag("peer1"),
    })
    g = g.withColumns({**R.pair_sums("own", "r1", "peer1_before", 60), **R.pair_sums("peer", "peer1", "peer1_before", 60)})
    g = g.withColumns({"follower_60d": R.pair_corr("own", 60), "cat_persist_60d": R.pair_corr("peer", 60)})
    return g.select(
        "date", "ticker", "spill_gap_5d", "spill_gap_20d", "follower_60d",
        (F.col("follower_60d") * F.col("spill_gap_5d")).alias("follow_x_spill"),
        "cat_mom_rank_20d", "cat_mom_rank_5d", "cat_persist_60d",
    )
