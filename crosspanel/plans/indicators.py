"""Feature sets with exponential smoothing, and the smaller named sets.

Layout of a build: ticker windows the smoothing needs -> one grouped pandas pass
on the same partitioning -> cross-sectional columns by date -> the remaining
ticker windows. Only base columns and smoothing results pass through Python.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.expr import clip, flag, greatest_strict, null_if_zero, safe_div
from crosspanel.operators import cross as X
from crosspanel.operators import recurrence as E
from crosspanel.operators import rolling as R

# fixed order: the 44 columns of the main feature set
V3_COLUMNS = [
    "ret_1d", "ret_5d", "ret_10d", "ret_20d", "ret_60d", "ema20_dist", "ema50_dist", "macd", "macd_signal",
    "macd_hist", "adx_14", "rsi_14", "willr_14", "bb_pctb", "stoch_k", "stoch_d", "vol_20d", "vol_zscore",
    "bb_bandwidth", "atr_14", "beta_60d", "obv", "mfi_14", "cmf_20", "dollar_vol_20d", "rel_volume_20d",
    "cs_rank_ret_5d", "cs_rank_ret_20d", "cs_rank_rsi", "cs_rank_volatility", "cs_rank_volume", "peer_rank_20d",
    "d_rsi_5d", "d_peer_rank_5d", "d_vol_5d", "d_macd_hist_5d", "d_volume_pct_5d", "cat_ret_5d", "cat_disp_5d",
    "beat_rate_20d", "mkt_ret_1d", "mkt_vol_20d", "mkt_vol_zscore", "breadth_50d",
]
REGIME_COLUMNS = ["mkt_ret_1d", "mkt_vol_20d", "mkt_vol_zscore", "breadth_50d"]
KEYS = ["date", "t", "ticker", "category"]
WILDER = 1 / 14


def steps() -> dict[str, Column]:
    """One-row lags and differences that several columns use; a stage of their own."""
    return {
        "close_before": R.lag("close"), "close_step": R.diff("close"),
        "high_step": R.diff("high"), "low_step": R.diff("low"),
    }


def true_range() -> Column:
    before = F.col("close_before")
    return greatest_strict(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )


def directional_moves() -> dict[str, Column]:
    up, down = F.col("high_step"), -F.col("low_step")
    zero = F.lit(0.0)
    return {
        "plus_dm": F.when((up > down) & (up > 0), up).otherwise(zero),
        "minus_dm": F.when((down > up) & (down > 0), down).otherwise(zero),
    }


def gains_and_losses() -> dict[str, Column]:
    step = F.col("close_step")
    return {"gain": clip(step, lo=0.0), "loss": -clip(step, hi=0.0)}


def _rsi(gain, loss):
    return 100 - 100 / (1 + gain / np.where(loss == 0, np.nan, loss))


def _v3_smoothing(m):
    e = E.span
    e20, e50, e12, e26, atr, plus, minus, gain, loss = E.smooth_many([
        (m["close"], e(20), 0), (m["close"], e(50), 0), (m["close"], e(12), 0), (m["close"], e(26), 0),
        (m["tr"], WILDER, 0), (m["plus_dm"], WILDER, 0), (m["minus_dm"], WILDER, 0),
        (m["gain"], WILDER, 0), (m["loss"], WILDER, 0)])
    plus, minus = 100 * plus / atr, 100 * minus / atr
    dx = 100 * np.abs(plus - minus) / (plus + minus)
    macd = e12 - e26
    signal, adx = E.smooth_many([(macd, e(9), 0), (np.where(np.isfinite(dx), dx, np.nan), WILDER, 0)])
    return {
        "ema_20": e20, "ema_50": e50, "macd": macd, "macd_signal": signal, "atr_14": atr, "adx_14": adx,
        "rsi_14": _rsi(gain, loss),
    }


def _own_z(x: str, k: int, need: int) -> Column:
    return safe_div(F.col(x) - R.mean(x, k, need), R.std(x, k, need))


def v3(grid: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The 44-column set: returns, trend, oscillators, volatility, volume, ranks, peers, market."""
    c, h, l, v = (F.col(n) for n in ("close", "high", "low", "volume"))
    df = grid.withColumns({**{f"ret_{n}d": R.pct_change("close", n) for n in (1, 5, 20)}, **steps()})
    df = df.withColumns({"vol_20d": R.std("ret_1d", 20), "tr": true_range(), **directional_moves(), **gains_and_losses()})
    df = E.per_ticker(
        df,
        [*KEYS, "close", "high", "low", "volume", "ret_1d", "ret_5d", "ret_20d", "vol_20d"],
        ["close", "tr", "plus_dm", "minus_dm", "gain", "loss"],
        ["ema_20", "ema_50", "macd", "macd_signal", "atr_14", "adx_14", "rsi_14"],
        _v3_smoothing,
    )

    # by date
    df = X.group_stats(df, X.DATE, {
        "mkt_ret_1d": F.avg("ret_1d"),
        "_above": F.sum(flag(c > F.col("ema_50"))),
        "_live": F.count("close"),
    }, group_rows)
    df = X.pct_rank(df, X.DATE, {
        "cs_rank_ret_5d": "ret_5d", "cs_rank_ret_20d": "ret_20d", "cs_rank_rsi": "rsi_14",
        "cs_rank_volatility": "vol_20d", "cs_rank_volume": "volume"}, group_rows)
    df = X.group_stats(df, X.PEERS, {
        "cat_ret_1d": F.avg("ret_1d"), "cat_ret_5d": F.avg("ret_5d"), "cat_ret_20d": F.avg("ret_20d"),
        "cat_disp_5d": F.stddev_samp("ret_5d")}, group_rows)
    df = X.pct_rank(df, X.PEERS, {"peer_rank_20d": "ret_20d"}, group_rows)
    df = df.withColumn("_beat", flag(F.col("ret_20d") > F.col("cat_ret_20d")))
    df = X.group_stats(df, X.PEERS, {"beat_rate_20d": F.avg("_beat")}, group_rows)

    # by ticker again; market columns are equal for all tickers, so their windows run here too
    df = df.withColumn("typical", (h + l + c) / 3)
    df = df.withColumn("flow_step", R.diff("typical"))
    typical, flow_step = F.col("typical"), F.col("flow_step")
    spread = h - l
    clv = clip(safe_div((c - l) - (h - c), F.when(spread > 0, spread)), -1.0, 1.0)
    df = df.withColumns({
        "ret_10d": R.pct_change("close", 10),
        "ret_60d": R.pct_change("close", 60),
        "hh": R.highest("high", 14),
        "ll": R.lowest("low", 14),
        "mid": R.mean("close", 20),
        "sd": R.std("close", 20),
        "pos_flow": F.when(flow_step > 0, typical * v).otherwise(0.0),
        "neg_flow": F.when(flow_step < 0, typical * v).otherwise(0.0),
        "flow": F.when((spread == 0) & c.isNotNull(), 0.0).otherwise(clv) * v,
        "macd_hist": F.col("macd") - F.col("macd_signal"),
        "mkt_vol_20d": R.std("mkt_ret_1d", 20),
        **R.pair_sums("peer", "ret_1d", "cat_ret_1d", 60),
    })
    reach = null_if_zero(F.col("hh") - F.col("ll"))
    df = df.withColumns({
        "ema20_dist": safe_div(c, "ema_20") - 1,
        "ema50_dist": safe_div(c, "ema_50") - 1,
        "willr_14": clip(safe_div(-100 * (F.col("hh") - c), reach), -100.0, 0.0),
        "stoch_k": clip(safe_div(100 * (c - F.col("ll")), reach), 0.0, 100.0),
        "bb_pctb": safe_div(c - (F.col("mid") - 2 * F.col("sd")), 4 * F.col("sd")),
        "bb_bandwidth": safe_div(4 * F.col("sd"), "mid"),
        "vol_zscore": _own_z("vol_20d", 252, 60),
        "beta_60d": R.pair_beta("peer", 60),
        "obv": R.cumsum(F.signum(F.coalesce("ret_1d", F.lit(0.0))) * F.coalesce(v, F.lit(0.0))),
        "dollar_vol_20d": R.mean(c * v, 20),
        "mfi_14": 100 - 100 / (1 + safe_div(R.total("pos_flow", 14), null_if_zero(R.total("neg_flow", 14)))),
        "cmf_20": safe_div(R.total("flow", 20), R.total("volume", 20)),
        "rel_volume_20d": safe_div(v, R.mean("volume", 20)) - 1,
        "d_rsi_5d": R.diff("rsi_14", 5),
        "d_peer_rank_5d": R.diff("peer_rank_20d", 5),
        "d_vol_5d": R.diff("vol_20d", 5),
        "d_macd_hist_5d": R.diff("macd_hist", 5),
        "d_volume_pct_5d": R.diff("cs_rank_volume", 5),
        "mkt_vol_zscore": _own_z("mkt_vol_20d", 252, 60),
        "breadth_50d": safe_div("_above", "_live"),
    })
    df = df.withColumn("stoch_d", R.mean("stoch_k", 3))
    return df.select("date", "ticker", "t", "close", *V3_COLUMNS)


ABSOLUTE_SCALE = ["obv", "dollar_vol_20d"]
PRICE_UNIT = ["macd", "macd_signal", "macd_hist", "atr_14"]


def scale_free(grid: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The main set comparable across markets: one peer group, no absolute scales."""
    df = v3(grid.withColumn("category", F.lit("all")), group_rows)
    df = df.withColumns({c: safe_div(c, "close") for c in PRICE_UNIT})
    return df.select("date", "ticker", *[c for c in V3_COLUMNS if c not in ABSOLUTE_SCALE])


# fixed names: columns of the second set that have a leave-one-out variant
OTHERS_ONLY = [
    "beta_60d", "resid_ret_5d", "resid_ret_20d", "corr_cat_60d", "idio_vol_20d", "tstat_rel_5d", "beat_rate_20d",
    "cat_ret_5d",
]
# fixed order: the 36 + 2 + 8 + 3 columns of the second set
V2_COLUMNS = [
    "ret_1d", "ret_5d", "ret_10d", "ret_20d", "vol_20d", "px_to_sma_10", "px_to_sma_20", "px_to_sma_50",
    "px_to_ema_10", "px_to_ema_20", "px_to_ema_50", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_pctb",
    "bb_bandwidth", "ret_20d_skip5", "beta_60d", "rel_str_5d", "cs_rank_ret_1d", "cs_rank_ret_5d",
    "cs_rank_skip_mom", "cs_rank_vol_20d", "resid_ret_5d", "resid_ret_20d", "corr_cat_60d", "idio_vol_20d",
    "rel_vol_20d", "tstat_rel_5d", "beat_rate_20d", "px_to_52w_high", "ret_60d_skip5", "cat_disp_5d",
    "cat_ret_5d", "cat_n", "peer_rank_20d", "vol_20d_raw",
    *[f"{n}_xself" for n in OTHERS_ONLY],
    "rel_volume_20d", "cs_rank_dollar_vol", "vol_zscore",
]


def _v2_smoothing(m):
    e = E.span
    e10, e20, e50, e12, e26, gain, loss = E.smooth_many([
        *[(m["close"], e(n), 0) for n in (10, 20, 50, 12, 26)], (m["gain"], WILDER, 14), (m["loss"], WILDER, 14)])
    line = e12 - e26
    return {
        "ema_10": e10, "ema_20": e20, "ema_50": e50, "macd_line": line, "macd_sig": E.smooth(line, e(9)),
        "rsi_14": 100 - 100 / (1 + gain / loss),
    }


def _against(bench: str, suffix: str) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Columns measured against a category benchmark held in ``{bench}_1/_5/_20``."""
    m, m5, m20 = f"{bench}_1", f"{bench}_5", f"{bench}_20"
    tag = f"{bench}_pair"
    win = (F.col("ret_1d") > F.col(m)).cast("double")
    floor = lambda x, lo: F.when(x.isNotNull(), F.greatest(x, F.lit(lo)))
    sums = {
        **R.pair_sums(tag, "ret_1d", m, 60),
        f"beat_rate_20d{suffix}": R.mean(win, 20),
        f"cat_ret_5d{suffix}": F.col(m5),
        f"rel_str_5d{suffix}": F.col("ret_5d") - F.col(m5),
    }
    n = F.col(f"{tag}_n")
    mean_a, mean_b = F.col(f"{tag}_a") / n, F.col(f"{tag}_b") / n
    variance = (F.col(f"{tag}_bb") / n - mean_b * mean_b) * n / (n - 1)
    product = F.col(f"{tag}_ab") / n - mean_a * mean_b
    first = {
        f"beta_60d{suffix}": F.when(n >= 60, product / F.greatest(variance, F.lit(1e-8))),
        f"corr_cat_60d{suffix}": R.pair_corr(tag, 60),
    }
    beta, corr = F.col(f"beta_60d{suffix}"), F.col(f"corr_cat_60d{suffix}")
    bounded = clip(corr, -1.0, 1.0)
    second = {
        f"resid_ret_5d{suffix}": F.col("ret_5d") - beta * F.col(m5),
        f"resid_ret_20d{suffix}": F.col("ret_20d") - beta * F.col(m20),
        f"idio_vol_20d{suffix}": F.col("vol_20d") * F.sqrt(1 - bounded * bounded),
        f"tstat_rel_5d{suffix}": safe_div(
            F.col(f"rel_str_5d{suffix}"), floor(F.col("vol_20d") / math.sqrt(252) * math.sqrt(5), 1e-6)),
    }
    return sums, first, second


def v2(grid: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The 49-column set, with peer benchmarks that include and exclude the ticker itself."""
    c = F.col("close")
    df = grid.withColumns({
        **{f"ret_{n}d": R.pct_change("close", n) for n in (1, 5, 10, 20)},
        "log_step": R.diff(F.ln("close")),
        "ret_20d_skip5": safe_div(R.lag("close", 5), R.lag("close", 25)) - 1,
        **steps(),
    })
    df = df.withColumns({**gains_and_losses(), "vol_20d": R.std("log_step", 20) * math.sqrt(252), "vol_20d_raw": R.std("ret_1d", 20),
                         "dollar_vol": c * F.col("volume")})
    df = E.per_ticker(
        df,
        [*KEYS, "close", "volume", "dollar_vol", "ret_1d", "ret_5d", "ret_10d", "ret_20d", "ret_20d_skip5",
         "vol_20d", "vol_20d_raw"],
        ["close", "gain", "loss"],
        ["ema_10", "ema_20", "ema_50", "macd_line", "macd_sig", "rsi_14"],
        _v2_smoothing,
    )
    df = X.group_stats(df, X.PEERS, {
        "all_1": F.avg("ret_1d"), "all_5": F.avg("ret_5d"), "all_20": F.avg("ret_20d"), "vol_mean": F.avg("vol_20d"),
        "cat_disp_5d": F.stddev_samp("ret_5d"), "cat_known": F.count("ret_5d"),
        "volume_mean": F.avg("volume"), "volume_sd": F.stddev_samp("volume")}, group_rows)
    df = X.add_loo(df, X.PEERS, {"oth_1": "ret_1d", "oth_5": "ret_5d", "oth_20": "ret_20d"}, True, group_rows)
    df = X.pct_rank(df, X.PEERS, {
        "cs_rank_ret_1d": "ret_1d", "cs_rank_ret_5d": "ret_5d", "cs_rank_skip_mom": "ret_20d_skip5",
        "cs_rank_vol_20d": "vol_20d", "peer_rank_20d": "ret_20d", "cs_rank_dollar_vol": "dollar_vol"}, group_rows)
    incl0, incl1, incl2 = _against("all", "")
    excl0, excl1, excl2 = _against("oth", "_xself")
    df = df.withColumns({
        **incl0, **excl0,
        "volume_5": R.mean("volume", 5), "volume_20": R.mean("volume", 20),
        **{f"px_to_sma_{n}": safe_div(c, R.mean("close", n)) - 1 for n in (10, 20, 50)},
        **{f"px_to_ema_{n}": safe_div(c, f"ema_{n}") - 1 for n in (10, 20, 50)},
        "macd": safe_div("macd_line", c),
        "macd_signal": safe_div("macd_sig", c),
        "macd_hist": safe_div(F.col("macd_line") - F.col("macd_sig"), c),
        "mid": R.mean("close", 20),
        "sd": R.std("close", 20),
        "rel_vol_20d": safe_div("vol_20d", "vol_mean"),
        "px_to_52w_high": safe_div(c, R.highest("close", 252, 60)) - 1,
        "ret_60d_skip5": safe_div(R.lag("close", 5), R.lag("close", 65)) - 1,
        "cat_n": F.when(c.isNotNull(), F.col("cat_known").cast("double")),
        "vol_zscore": clip((F.col("volume") - F.col("volume_mean")) / (F.col("volume_sd") + 1e-8), -5.0, 5.0),
    })
    df = df.withColumns({**incl1, **excl1})
    recent = safe_div("volume_5", F.greatest(F.col("volume_20"), F.lit(1e-6))) - 1
    df = df.withColumns({
        **incl2, **excl2,
        "rel_volume_20d": clip(F.when(F.col("volume_20").isNotNull(), recent), -5.0, 5.0),
        "bb_pctb": safe_div(c - (F.col("mid") - 2 * F.col("sd")), 4 * F.col("sd")),
        "bb_bandwidth": safe_div(4 * F.col("sd"), "mid"),
    })
    return df.select("date", "ticker", *V2_COLUMNS)


# fixed order: the 27 columns of the basic price / volume set
BASIC_COLUMNS = [
    "ret_1d", "ret_5d", "ret_10d", "ret_20d", "ret_60d", "ret_20d_skip5", "ret_60d_skip5", "vol_20d", "vol_60d",
    "hl_range_20d", "gap_20d", "px_to_sma_10", "px_to_sma_20", "px_to_sma_50", "px_to_sma_200", "px_to_ema_12",
    "px_to_ema_26", "rsi_14", "macd", "macd_hist", "bb_pctb", "bb_bandwidth", "px_to_52w_high", "px_to_52w_low",
    "rel_volume_20d", "dollar_vol_log", "vol_zscore_20d",
]


def _basic_smoothing(m):
    e12, e26, gain, loss = E.smooth_many([
        (m["close"], E.span(12), 0), (m["close"], E.span(26), 0), (m["gain"], WILDER, 0), (m["loss"], WILDER, 0)])
    return {"ema_12": e12, "ema_26": e26, "macd_sig": E.smooth(e12 - e26, E.span(9)), "rsi_14": _rsi(gain, loss)}


def basic(grid: DataFrame) -> DataFrame:
    """The 27-column price / volume set; needs no other ticker."""
    c = F.col("close")
    skip = lambda n: safe_div(R.lag("close", 5), R.lag("close", 5 + n)) - 1
    df = grid.withColumns({
        **{f"ret_{n}d": R.pct_change("close", n) for n in (1, 5, 10, 20, 60)},
        "ret_20d_skip5": skip(20), "ret_60d_skip5": skip(60),
        "hl": safe_div(F.col("high") - F.col("low"), c),
        "gap": safe_div("open", R.lag("close")) - 1,
        "dv": c * F.col("volume"),
        "sd": R.std("close", 20),
        **{f"sma_{n}": R.mean("close", n) for n in (10, 20, 50, 200)},
        "px_to_52w_high": safe_div(c, R.highest("close", 252)) - 1,
        "px_to_52w_low": safe_div(c, R.lowest("close", 252)) - 1,
        "rel_volume_20d": safe_div("volume", R.mean("volume", 20)) - 1,
        **steps(),
    })
    df = df.withColumns({
        **gains_and_losses(),
        "vol_20d": R.std("ret_1d", 20), "vol_60d": R.std("ret_1d", 60),
        "hl_range_20d": R.mean("hl", 20), "gap_20d": R.mean("gap", 20),
        **{f"px_to_sma_{n}": safe_div(c, f"sma_{n}") - 1 for n in (10, 20, 50, 200)},
        "bb_pctb": safe_div(c - (F.col("sma_20") - 2 * F.col("sd")), 4 * F.col("sd")),
        "bb_bandwidth": safe_div(4 * F.col("sd"), "sma_20"),
        "dollar_vol_log": F.log1p(R.mean("dv", 20)),
        "vol_zscore_20d": safe_div(F.col("dv") - R.mean("dv", 20), R.std("dv", 20)),
    })
    smoothed = ["ema_12", "ema_26", "macd_sig", "rsi_14"]
    made = {"px_to_ema_12", "px_to_ema_26", "rsi_14", "macd", "macd_hist"}
    carried = [n for n in BASIC_COLUMNS if n not in made]
    df = E.per_ticker(df, ["date", "t", "ticker", "close", *carried], ["close", "gain", "loss"], smoothed, _basic_smoothing)
    line = F.col("ema_12") - F.col("ema_26")
    df = df.withColumns({
        "px_to_ema_12": safe_div(c, "ema_12") - 1,
        "px_to_ema_26": safe_div(c, "ema_26") - 1,
        "macd": safe_div(line, c),
        "macd_hist": safe_div(line - F.col("macd_sig"), c),
    })
    return df.select("date", "ticker", *BASIC_COLUMNS)


VOLATILITY_COLUMNS = ["vol_20d", "vol_60d", "hl_range_20d", "vol_20d_rel", "vol_60d_rel", "vol_20d_catrank"]


def volatility_levels(grid: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Volatility as a level and against the peers."""
    df = grid.withColumns({"r1": R.pct_change("close"), "hl": safe_div(F.col("high") - F.col("low"), "close")})
    df = df.withColumns({"vol_20d": R.std("r1", 20), "vol_60d": R.std("r1", 60), "hl_range_20d": R.mean("hl", 20)})
    df = X.add_loo(df, X.PEERS, {"_p20": "vol_20d", "_p60": "vol_60d"}, False, group_rows)
    df = X.pct_rank(df, X.PEERS, {"vol_20d_catrank": "vol_20d"}, group_rows)
    df = df.withColumns({
        "vol_20d_rel": F.col("vol_20d") - F.col("_p20"), "vol_60d_rel": F.col("vol_60d") - F.col("_p60")})
    return df.select("date", "ticker", *VOLATILITY_COLUMNS)


def raw_floor(grid: DataFrame) -> DataFrame:
    """The five price / volume columns as they are."""
    return grid.select("date", "ticker", "open", "high", "low", "close", "volume")


def simple(grid: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Three columns: 5-row return, 21-row volatility, strength against the category."""
    df = grid.withColumns({"r1": R.pct_change("close"), "ret_5d": R.pct_change("close", 5)})
    df = df.withColumn("vol_21d", R.std("r1", 21))
    df = X.group_stats(df, X.PEERS, {"_m": F.avg("ret_5d")}, group_rows)
    return df.select("date", "ticker", "ret_5d", "vol_21d", (F.col("ret_5d") - F.col("_m")).alias("rel_str_5d"))


CHANNELS = ["r1", "r1_rel", "rank_r1", "hl", "clv", "gap", "volz", "dd60"]


def channels(grid: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Eight per-row channels from which sequences are cut."""
    c, h, l, v = (F.col(n) for n in ("close", "high", "low", "volume"))
    spread = h - l
    df = grid.withColumns({"r1": R.pct_change("close"), "logv": F.when(v > 0, F.log1p(v))})
    df = df.withColumns({
        "hl": safe_div(spread, c),
        "clv": safe_div((c - l) - (h - c), F.when(spread > 0, spread)),
        "gap": safe_div("open", R.lag("close")) - 1,
        "volz": _own_z("logv", 60, 60),
        "dd60": safe_div(c, R.highest("close", 60)) - 1,
    })
    df = X.add_loo(df, X.PEERS, {"_p": "r1"}, False, group_rows)
    df = X.pct_rank(df, X.PEERS, {"_rank": "r1"}, group_rows)
    return df.select("date", "t", "ticker", "r1", (F.col("r1") - F.col("_p")).alias("r1_rel"),
                     (F.col("_rank") - 0.5).alias("rank_r1"), "hl", "clv", "gap", "volz", "dd60")


# published defaults of the six oscillators
OSCILLATOR_DEFAULTS = {"rsi": 3, "stoch_rsi": 14, "bands": 20, "cci": 20, "pgo": 14, "fisher": 9}
OSCILLATORS = ["rsi", "stoch_rsi_k", "stoch_rsi_d", "band_position", "cci", "pgo", "fisher"]


def oscillators(grid: DataFrame, lengths: dict | None = None, group_rows: int | None = None) -> DataFrame:
    """Six oscillators, each z-scored within (date, category)."""
    n = {**OSCILLATOR_DEFAULTS, **(lengths or {})}
    c = F.col("close")
    df = grid.withColumns(steps()).withColumns({
        **gains_and_losses(), "tr": true_range(),
        "tp": (F.col("high") + F.col("low") + c) / 3,
        "mid_price": (F.col("high") + F.col("low")) / 2,
        "sma_bands": R.mean("close", n["bands"]), "sd_bands": R.std("close", n["bands"]),
        "sma_pgo": R.mean("close", n["pgo"]),
    })
    df = df.withColumns({"tp_mean": R.mean("tp", n["cci"]), "tp_list": F.collect_list("tp").over(R.frame(n["cci"]))})
    deviation = F.aggregate(
        F.transform("tp_list", lambda x: F.abs(x - F.col("tp_mean"))), F.lit(0.0), lambda a, x: a + x) / n["cci"]
    df = df.withColumns({
        "cci": safe_div(F.col("tp") - F.col("tp_mean"), 0.015 * deviation),
        "band_position": safe_div(c - (F.col("sma_bands") - 2 * F.col("sd_bands")), 4 * F.col("sd_bands")),
    })

    def smooth(m):
        k, p = n["stoch_rsi"], n["pgo"]
        fast_gain, fast_loss, gain, loss, atr = E.smooth_many([
            (m["gain"], 1 / n["rsi"], n["rsi"]), (m["loss"], 1 / n["rsi"], n["rsi"]),
            (m["gain"], 1 / k, k), (m["loss"], 1 / k, k), (m["tr"], 1 / p, p)])
        slow = 100 * gain / (gain + loss)
        low, high = E.rolled(slow, k, "min"), E.rolled(slow, k, "max")
        place = 100 * (slow - low) / (high - low)
        fast_k = E.rolled(np.where(np.isfinite(place), place, np.nan), 3, "mean")
        return {
            "rsi": 100 * fast_gain / (fast_gain + fast_loss),
            "stoch_rsi_k": fast_k,
            "stoch_rsi_d": E.rolled(fast_k, 3, "mean"),
            "pgo": (m["close"] - m["sma_pgo"]) / E.smooth(atr, E.span(p), p),
            "fisher": E.fisher(m["mid_price"], n["fisher"]),
        }

    df = E.per_ticker(df, ["date", "t", "ticker", "category", "band_position", "cci"],
                      ["close", "gain", "loss", "tr", "sma_pgo", "mid_price"],
                      ["rsi", "stoch_rsi_k", "stoch_rsi_d", "pgo", "fisher"], smooth)
    df = X.zscore(df, X.PEERS, {f"{o}_z": o for o in OSCILLATORS}, group_rows=group_rows)
    return df.select("date", "ticker", *[f"{o}_z" for o in OSCILLATORS])
