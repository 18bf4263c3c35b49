"""The ten feature families and the support / resistance set, on the dense grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.expr import flag, null_flag, null_if_zero, safe_div
from crosspanel.operators import rolling as R
from crosspanel.plans.featureset import FeatureSet

LN2 = math.log(2)


def _ret(*ns):
    return {f"r{n}": R.pct_change("close", n) for n in ns}


def _voltail():
    return [
        {**_ret(1), "hl": safe_div(F.col("high") - F.col("low"), "close")},
        {
            "vol_20d": R.std("r1", 20),
            "vol_spike": safe_div(R.std("r1", 5), R.std("r1", 60)),
            "hl_spike": safe_div(R.mean("hl", 5), R.mean("hl", 60)),
        },
        {"vol_of_vol_60d": safe_div(R.std("vol_20d", 60), R.mean("vol_20d", 60))},
    ]


VOLTAIL = FeatureSet(
    "voltail",
    ["vol_20d", "vol_pctile_1y", "vol_of_vol_60d", "vol_spike", "vol_cat_rank", "vol_top_decile", "hl_spike"],
    trail=_voltail,
    own_ranks={"vol_pctile_1y": ("vol_20d", 252)},
    ranks={"vol_cat_rank": "vol_20d"},
    final=lambda: {"vol_top_decile": null_flag(F.col("vol_cat_rank") >= 0.9)},
)

PEERMOM = FeatureSet(
    "peermom",
    [
        "ret_5d_peerrel", "ret_5d_catrank", "ret_20d_peerrel", "ret_20d_catrank", "ret_60d_peerrel",
        "ret_60d_catrank", "ret_20d_skip5_peerrel", "mom_consistency_20d", "streak_rel_5d",
    ],
    trail=lambda: [
        {**_ret(1, 5, 20, 60), "r_skip": safe_div(R.lag("close", 5), R.lag("close", 25)) - 1},
        {"up_frac": R.mean(flag(F.col("r1") > 0), 20)},
    ],
    loo={"loo_r1": "r1", "loo_r5": "r5", "loo_r20": "r20", "loo_r60": "r60", "loo_skip": "r_skip"},
    ranks={"ret_5d_catrank": "r5", "ret_20d_catrank": "r20", "ret_60d_catrank": "r60", "mom_consistency_20d": "up_frac"},
    trail2=lambda: [
        {"rel_1": F.col("r1") - F.col("loo_r1")},
        {"streak_rel_5d": R.total("rel_1", 5)},
    ],
    final=lambda: {
        **{f"ret_{n}d_peerrel": F.col(f"r{n}") - F.col(f"loo_r{n}") for n in (5, 20, 60)},
        "ret_20d_skip5_peerrel": F.col("r_skip") - F.col("loo_skip"),
    },
)

PEEREXT = FeatureSet(
    "peerext",
    [
        "px_to_52w_high", "px_to_52w_high_catrank", "px_to_52w_low", "px_to_52w_low_catrank", "px_to_sma_200",
        "px_to_sma_200_catrank", "px_to_sma_200_peerrel", "px_to_sma_50_catrank", "range_pos_52w",
        "range_pos_52w_catrank",
    ],
    trail=lambda: [
        {"hi_252": R.highest("close", 252), "lo_252": R.lowest("close", 252)},
        {
            "px_to_52w_high": safe_div("close", "hi_252") - 1,
            "px_to_52w_low": safe_div("close", "lo_252") - 1,
            "px_to_sma_200": safe_div("close", R.mean("close", 200)) - 1,
            "px_to_sma_50": safe_div("close", R.mean("close", 50)) - 1,
            "range_pos_52w": safe_div(F.col("close") - F.col("lo_252"), F.col("hi_252") - F.col("lo_252")),
        },
    ],
    loo={"loo_sma200": "px_to_sma_200"},
    ranks={
        f"{c}_catrank": c
        for c in ("px_to_52w_high", "px_to_52w_low", "px_to_sma_200", "px_to_sma_50", "range_pos_52w")
    },
    final=lambda: {"px_to_sma_200_peerrel": F.col("px_to_sma_200") - F.col("loo_sma200")},
)

LIQUIDITY = FeatureSet(
    "liquidity",
    [
        "dollar_vol_log", "dollar_vol_catrank", "amihud_20d", "amihud_catrank", "volume_trend", "volume_spike_5d",
        "zero_vol_frac_20d", "turnover_vol_20d",
    ],
    trail=lambda: [
        {
            **_ret(1),
            "dv": F.col("close") * F.col("volume"),
            "idle": flag((F.col("volume") == 0) & F.col("close").isNotNull()),
            "live": F.col("close").isNotNull().cast("double"),
        },
        {
            "dv_20": R.mean("dv", 20),
            "dv_std_20": R.std("dv", 20),
            "amihud_20d": R.mean(safe_div(F.abs("r1"), null_if_zero("dv")), 20),
            "volume_trend": safe_div(R.mean("volume", 20), R.mean("volume", 60)) - 1,
            "volume_spike_5d": safe_div(R.mean("volume", 5), R.mean("volume", 60)) - 1,
            "zero_vol_frac_20d": safe_div(R.total("idle", 20), R.total("live", 20)),
        },
    ],
    ranks={"dollar_vol_catrank": "dv_20", "amihud_catrank": "amihud_20d"},
    final=lambda: {"dollar_vol_log": F.log1p("dv_20"), "turnover_vol_20d": safe_div("dv_std_20", "dv_20")},
)

BETAIDIO = FeatureSet(
    "betaidio",
    [
        "beta_60d", "beta_catrank", "corr_cat_60d", "resid_ret_5d", "resid_ret_20d", "idio_vol_20d",
        "idio_vol_catrank", "idio_frac_20d", "tstat_rel_5d",
    ],
    trail=lambda: [_ret(1), {"vol_20d": R.std("r1", 20)}],
    loo={"loo_r1": "r1"},
    trail2=lambda: [
        {"rel_1": F.col("r1") - F.col("loo_r1")},
        {
            **R.pair_sums("peer", "r1", "loo_r1", 60),
            "resid_ret_5d": R.total("rel_1", 5),
            "resid_ret_20d": R.total("rel_1", 20),
            "idio_vol_20d": R.std("rel_1", 20),
            "tstat_rel_5d": safe_div(R.mean("rel_1", 5), null_if_zero(R.std("rel_1", 5)) / math.sqrt(5)),
        },
        {"beta_60d": R.pair_beta("peer", 60), "corr_cat_60d": R.pair_corr("peer", 60)},
    ],
    ranks2={"beta_catrank": "beta_60d", "idio_vol_catrank": "idio_vol_20d"},
    final=lambda: {"idio_frac_20d": safe_div("idio_vol_20d", "vol_20d")},
)

CATCONTEXT = FeatureSet(
    "catcontext",
    [
        "cat_disp_5d", "cat_disp_20d", "cat_ret_5d", "cat_ret_20d", "cat_vol_20d", "cat_n", "cat_breadth_5d",
        "disp_x_vol_rank",
    ],
    trail=lambda: [_ret(1, 5, 20), {"vol_20d": R.std("r1", 20)}],
    stats=lambda: {
        "cat_disp_5d": F.stddev_samp("r5"),
        "cat_disp_20d": F.stddev_samp("r20"),
        "cat_ret_5d": F.avg("r5"),
        "cat_ret_20d": F.avg("r20"),
        "cat_vol_20d": F.avg("vol_20d"),
        "cat_live": F.count("close"),
        "cat_breadth_5d": F.avg(null_flag(F.col("r5") > 0)),
    },
    ranks={"vol_cat_rank": "vol_20d"},
    final=lambda: {
        "cat_n": F.col("cat_live").cast("double"),
        "disp_x_vol_rank": F.col("vol_cat_rank") * F.col("cat_disp_5d"),
    },
)


def _floored_log(ratio):
    return F.ln(F.when(ratio.isNotNull(), F.greatest(ratio, F.lit(1e-12))))


RANGE = FeatureSet(
    "range",
    [
        "parkinson_20d", "gk_20d", "parkinson_catrank", "clv_20d", "gap_20d", "gap_abs_20d", "range_ratio_5_60",
        "pk_to_ccvol",
    ],
    trail=lambda: [
        {
            **_ret(1),
            "log_hl": _floored_log(safe_div("high", null_if_zero("low"))),
            "log_co": _floored_log(safe_div(null_if_zero("close"), null_if_zero("open"))),
            "clv": safe_div(2 * F.col("close") - F.col("high") - F.col("low"), null_if_zero(F.col("high") - F.col("low"))),
            "gap": safe_div("open", null_if_zero(R.lag("close"))) - 1,
            "hl": safe_div(F.col("high") - F.col("low"), "close"),
        },
        {
            "parkinson_20d": F.sqrt(R.mean(F.col("log_hl") * F.col("log_hl") / (4 * LN2), 20)),
            "gk_day": 0.5 * F.col("log_hl") * F.col("log_hl") - (2 * LN2 - 1) * F.col("log_co") * F.col("log_co"),
            "clv_20d": R.mean("clv", 20),
            "gap_20d": R.mean("gap", 20),
            "gap_abs_20d": R.mean(F.abs("gap"), 20),
            "range_ratio_5_60": safe_div(R.mean("hl", 5), null_if_zero(R.mean("hl", 60))),
            "vol_20d": R.std("r1", 20),
        },
        {
            "gk_20d": F.sqrt(R.mean(F.when(F.col("gk_day").isNotNull(), F.greatest("gk_day", F.lit(0.0))), 20)),
            "pk_to_ccvol": safe_div("parkinson_20d", null_if_zero("vol_20d")),
        },
    ],
    ranks={"parkinson_catrank": "parkinson_20d"},
)

DOWNSIDE = FeatureSet(
    "downside",
    [
        "dd_60d", "dd_252d", "days_since_high_60d", "downside_share_20d", "sortino_20d", "skew_60d", "kurt_60d",
        "dd_catrank",
    ],
    trail=lambda: [
        {
            **_ret(1),
            "filled": R.ffill("close"),
            "dd_60d": safe_div("close", R.highest("close", 60)) - 1,
            "hi_252": R.highest("close", 252),
        },
        {
            "dd_252d": safe_div("close", "hi_252") - 1,
            "vol_20d": R.std("r1", 20),
            "semivol": R.std(F.when(F.col("r1") < 0, F.col("r1")), 20, 5),
            "mean_r1_20": R.mean("r1", 20),
            **R.power_sums("shape", "r1", 60),
            "days_since_high_60d": R.rows_since_high("filled", "close", 60),
        },
        {
            "downside_share_20d": safe_div("semivol", "vol_20d"),
            "sortino_20d": safe_div("mean_r1_20", "semivol"),
            "skew_60d": R.skew_of("shape", 60),
            "kurt_60d": R.kurt_of("shape", 60),
        },
    ],
    ranks={"dd_catrank": "dd_60d"},
)

TEMPORAL = FeatureSet(
    "temporal",
    [
        "autocorr1_60d", "sharpe_mom_20d", "sharpe_mom_60d", "mom_accel_20d", "updays_frac_20d", "trend_str_20d",
        "sharpe_mom_catrank",
    ],
    trail=lambda: [
        {**_ret(1, 20, 60), "log_close": F.ln("close"), "t_axis": F.col("t").cast("double")},
        {
            "r1_before": R.lag("r1"),
            "sharpe_mom_20d": safe_div("r20", R.std("r1", 20) * math.sqrt(20)),
            "sharpe_mom_60d": safe_div("r60", R.std("r1", 60) * math.sqrt(60)),
            "mom_accel_20d": F.col("r20") - R.lag("r20", 20),
            "updays_frac_20d": R.mean(null_flag(F.col("r1") > 0), 20, 15),
            **R.pair_sums("trend", "log_close", "t_axis", 20),
        },
        {"trend_corr": R.pair_corr("trend", 20), **R.pair_sums("auto", "r1", "r1_before", 60)},
        {
            "autocorr1_60d": R.pair_corr("auto", 60),
            "trend_str_20d": F.col("trend_corr") * F.col("trend_corr") * F.signum("trend_corr"),
        },
    ],
    ranks={"sharpe_mom_catrank": "sharpe_mom_20d"},
)

OVERNIGHT = FeatureSet(
    "overnight",
    [
        "on_ret_20d", "id_ret_20d", "on_share_20d", "on_minus_id_20d", "on_vol_ratio_20d", "on_ret_catrank",
        "id_ret_catrank",
    ],
    trail=lambda: [
        {"night": safe_div("open", R.lag("close")) - 1, "intra": safe_div("close", "open") - 1},
        {
            "on_ret_20d": R.total("night", 20),
            "id_ret_20d": R.total("intra", 20),
            "on_abs": R.total(F.abs("night"), 20),
            "id_abs": R.total(F.abs("intra"), 20),
            "on_vol_ratio_20d": safe_div(R.std("night", 20), null_if_zero(R.std("intra", 20))),
        },
    ],
    ranks={"on_ret_catrank": "on_ret_20d", "id_ret_catrank": "id_ret_20d"},
    final=lambda: {
        "on_share_20d": safe_div("on_abs", F.col("on_abs") + F.col("id_abs")),
        "on_minus_id_20d": F.col("on_ret_20d") - F.col("id_ret_20d"),
    },
)

# order matters: of two columns with one name the first family's is kept
FAMILIES = [VOLTAIL, PEERMOM, PEEREXT, LIQUIDITY, BETAIDIO, CATCONTEXT, RANGE, DOWNSIDE, TEMPORAL, OVERNIGHT]

SR_WINDOWS = (20, 60)
SR_TOLERANCE = 0.02


def support_resistance(grid: DataFrame, windows=SR_WINDOWS, tolerance: float = SR_TOLERANCE) -> DataFrame:
    """Distance to the highest high and lowest low of the rows before the current one."""
    c = F.col("close")
    df = grid.withColumns(
        {
            **{f"res_{w}": R.highest("high", w, skip=1) for w in windows},
            **{f"sup_{w}": R.lowest("low", w, skip=1) for w in windows},
        }
    )
    names = []
    added = {}
    for w in windows:
        res, sup = F.col(f"res_{w}"), F.col(f"sup_{w}")
        added[f"dist_res_{w}"] = safe_div(res - c, c)
        added[f"dist_sup_{w}"] = safe_div(c - sup, c)
        added[f"range_pos_{w}"] = safe_div(c - sup, null_if_zero(res - sup))
        names += [f"dist_res_{w}", f"dist_sup_{w}", f"range_pos_{w}"]
    near = windows[0]
    res, sup = F.col(f"res_{near}"), F.col(f"sup_{near}")
    added["at_res"] = flag(F.col("high") >= res * (1 - tolerance))
    added["at_sup"] = flag(F.col("low") <= sup * (1 + tolerance))
    added[f"sr_width_{near}"] = safe_div(res - sup, c)
    added[f"broke_res_{near}"] = flag(c > res)
    added[f"broke_sup_{near}"] = flag(c < sup)
    df = df.withColumns(added).withColumns(
        {
            f"res_touch_{near}": R.total("at_res", near, skip=1),
            f"sup_touch_{near}": R.total("at_sup", near, skip=1),
        }
    )
    names += [f"{n}_{near}" for n in ("sr_width", "res_touch", "sup_touch", "broke_res", "broke_sup")]
    return df.select("date", "ticker", *names)
