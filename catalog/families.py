"""Feature families: one query each, and the combined build."""

from __future__ import annotations

from catalog import base as B
from catalog.base import DC, chg, lag, loo, pr, r, roll, w
from catalog.peers import SEC_COLS, COMPOSITION_SQL, composition
from catalog.registry import query
from catalog.trailing import own_rank_sql, pair
from crosspanel.plans import extras as EX
from crosspanel.plans import families as FM
from crosspanel.plans.featureset import build


def staged(stages: list[dict[str, str]], prefix: str = B.PANEL_SQL, source: str = "panel") -> str:
    """A chain of CTEs, each adding columns to the one before; the last is ``z``."""
    out, prev = prefix, source
    for i, stage in enumerate(stages):
        name = "z" if i == len(stages) - 1 else f"s{i}"
        out += f",\n{name} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {prev})"
        prev = name
    return out


def out_sql(stages, columns, prefix: str = B.PANEL_SQL, scale: dict[str, float] | None = None) -> str:
    cols = ", ".join(r(f"{c} * {scale[c]}" if scale and c in scale else c, c) for c in columns)
    return f"{staged(stages, prefix)} SELECT date, ticker, {cols} FROM z"


def ret(*ns):
    return {f"r{n}": chg("close", n) for n in ns}


def div(a, b):
    return f"(({a}) / nullif({b}, 0))"


def flag(c):
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


def null_flag(c, x):
    return f"CASE WHEN {x} IS NOT NULL THEN {flag(c)} END"


def cat(agg):
    return f"{agg} OVER (PARTITION BY {DC})"


FAMILY_SQL: dict[str, list[dict[str, str]]] = {
    "voltail": [
        {**ret(1), "hl": div("high - low", "close")},
        {"vol_20d": roll("stddev_samp", "r1", 20), "vol_spike": div(roll("stddev_samp", "r1", 5), f"({roll('stddev_samp', 'r1', 60)})"),
         "hl_spike": div(roll("avg", "hl", 5), f"({roll('avg', 'hl', 60)})")},
        {"vol_pctile_1y": own_rank_sql("vol_20d", 252),
         "vol_of_vol_60d": div(roll("stddev_samp", "vol_20d", 60), f"({roll('avg', 'vol_20d', 60)})"),
         "vol_cat_rank": pr("vol_20d", DC)},
        {"vol_top_decile": null_flag("vol_cat_rank >= 0.9", "vol_cat_rank")},
    ],
    "peermom": [
        {**ret(1, 5, 20, 60), "r_skip": f"({lag('close', 5)} / nullif({lag('close', 25)}, 0) - 1)"},
        {"up": flag("r1 > 0"), "rel_1": f"r1 - {loo('r1')}", **{f"ret_{n}d_peerrel": f"r{n} - {loo(f'r{n}')}" for n in (5, 20, 60)},
         **{f"ret_{n}d_catrank": pr(f"r{n}", DC) for n in (5, 20, 60)}, "ret_20d_skip5_peerrel": f"r_skip - {loo('r_skip')}"},
        {"up_frac": roll("avg", "up", 20), "streak_rel_5d": roll("sum", "rel_1", 5)},
        {"mom_consistency_20d": pr("up_frac", DC)},
    ],
    "peerext": [
        {"hi": roll("max", "close", 252), "lo": roll("min", "close", 252), "s200": roll("avg", "close", 200), "s50": roll("avg", "close", 50)},
        {"px_to_52w_high": "close / hi - 1", "px_to_52w_low": "close / lo - 1", "px_to_sma_200": "close / s200 - 1",
         "px_to_sma_50": "close / s50 - 1", "range_pos_52w": div("close - lo", "hi - lo")},
        {**{f"{c}_catrank": pr(c, DC) for c in ("px_to_52w_high", "px_to_52w_low", "px_to_sma_200", "px_to_sma_50", "range_pos_52w")},
         "px_to_sma_200_peerrel": f"px_to_sma_200 - {loo('px_to_sma_200')}"},
    ],
    "liquidity": [
        {**ret(1), "dv": "close * volume", "idle": flag("volume = 0 AND close IS NOT NULL"), "live": flag("close IS NOT NULL")},
        {"illiq": div("abs(r1)", "dv"), "dv_20": roll("avg", "dv", 20), "dv_sd": roll("stddev_samp", "dv", 20),
         "volume_trend": f"({roll('avg', 'volume', 20)}) / ({roll('avg', 'volume', 60)}) - 1",
         "volume_spike_5d": f"({roll('avg', 'volume', 5)}) / ({roll('avg', 'volume', 60)}) - 1",
         "zero_vol_frac_20d": f"({roll('sum', 'idle', 20)}) / nullif(({roll('sum', 'live', 20)}), 0)"},
        {"amihud_20d": roll("avg", "illiq", 20), "dollar_vol_log": "ln(1 + dv_20)", "dollar_vol_catrank": pr("dv_20", DC),
         "turnover_vol_20d": "dv_sd / dv_20"},
        {"amihud_catrank": pr("amihud_20d", DC)},
    ],
    "betaidio": [
        ret(1),
        {"m": loo("r1"), "sd20": roll("stddev_samp", "r1", 20)},
        {"e": "r1 - m"},
        {"beta_60d": div(pair("covar_samp", "r1", "m", 60), f"({roll('var_samp', 'm', 60)})"), "corr_cat_60d": pair("corr", "r1", "m", 60),
         "resid_ret_5d": roll("sum", "e", 5), "resid_ret_20d": roll("sum", "e", 20), "idio_vol_20d": roll("stddev_samp", "e", 20),
         "tstat_rel_5d": div(roll("avg", "e", 5), f"(({roll('stddev_samp', 'e', 5)}) / sqrt(5))")},
        {"beta_catrank": pr("beta_60d", DC), "idio_vol_catrank": pr("idio_vol_20d", DC), "idio_frac_20d": div("idio_vol_20d", "sd20")},
    ],
    "catcontext": [
        ret(1, 5, 20),
        {"v": roll("stddev_samp", "r1", 20)},
        {"cat_disp_5d": cat("stddev_samp(r5)"), "cat_disp_20d": cat("stddev_samp(r20)"), "cat_ret_5d": cat("avg(r5)"),
         "cat_ret_20d": cat("avg(r20)"), "cat_vol_20d": cat("avg(v)"), "cat_n": cat("count(close)"),
         "cat_breadth_5d": cat(f"avg({null_flag('r5 > 0', 'r5')})"), "vr": pr("v", DC)},
        {"disp_x_vol_rank": "vr * cat_disp_5d"},
    ],
    "range": [
        {**ret(1), "log_hl": "ln(greatest(high / nullif(low, 0), 1e-12))", "log_co": "CASE WHEN close IS NOT NULL THEN ln(greatest(close / nullif(open, 0), 1e-12)) END",
         "clv": div("2 * close - high - low", "high - low"), "gap": f"(open / nullif({lag('close')}, 0) - 1)", "hl": "(high - low) / close"},
        {"hl2": "CASE WHEN high IS NOT NULL THEN log_hl * log_hl / (4 * ln(2)) END",
         "gk": "CASE WHEN high IS NOT NULL THEN greatest(0, 0.5 * log_hl * log_hl - (2 * ln(2) - 1) * log_co * log_co) END",
         "clv_20d": roll("avg", "clv", 20), "gap_20d": roll("avg", "gap", 20), "gap_abs_20d": roll("avg", "abs(gap)", 20),
         "range_ratio_5_60": div(roll("avg", "hl", 5), f"({roll('avg', 'hl', 60)})"), "sd20": roll("stddev_samp", "r1", 20)},
        {"parkinson_20d": f"sqrt({roll('avg', 'hl2', 20)})", "gk_20d": f"sqrt({roll('avg', 'gk', 20)})"},
        {"parkinson_catrank": pr("parkinson_20d", DC), "pk_to_ccvol": div("parkinson_20d", "sd20")},
    ],
    "downside": [
        {**ret(1), "dd_60d": f"close / ({roll('max', 'close', 60)}) - 1", "dd_252d": f"close / ({roll('max', 'close', 252)}) - 1",
         "ff": f"last_value(close IGNORE NULLS) OVER ({B.AXIS} ROWS UNBOUNDED PRECEDING)"},
        {"neg": "CASE WHEN r1 < 0 THEN r1 END", "v": f"list(coalesce(ff, -1e300)) OVER {w(60)}"},
        {"semi_sd": roll("stddev_samp", "neg", 20, 5), "sd20": roll("stddev_samp", "r1", 20), "m20": roll("avg", "r1", 20),
         "skew_60d": roll("skewness", "r1", 60), "kurt_60d": roll("kurtosis", "r1", 60), "dd_catrank": pr("dd_60d", DC),
         "days_since_high_60d": "CASE WHEN close IS NOT NULL AND len(v) = 60 THEN 60.0 - list_position(v, list_max(v)) END"},
        {"downside_share_20d": div("semi_sd", "sd20"), "sortino_20d": div("m20", "semi_sd")},
    ],
    "temporal": [
        {**ret(1, 20, 60), "lc": "ln(close)", "td": "cast(t AS double)"},
        {"r0": lag("r1"), "sharpe_mom_20d": div("r20", f"(({roll('stddev_samp', 'r1', 20)}) * sqrt(20))"),
         "sharpe_mom_60d": div("r60", f"(({roll('stddev_samp', 'r1', 60)}) * sqrt(60))"),
         "mom_accel_20d": f"r20 - {lag('r20', 20)}", "up": null_flag("r1 > 0", "r1"), "k": pair("corr", "lc", "td", 20)},
        {"autocorr1_60d": pair("corr", "r1", "r0", 60), "updays_frac_20d": roll("avg", "up", 20, 15), "trend_str_20d": "k * k * sign(k)",
         "sharpe_mom_catrank": pr("sharpe_mom_20d", DC)},
    ],
    "overnight": [
        {"night": f"(open / nullif({lag('close')}, 0) - 1)", "intra": "(close / nullif(open, 0) - 1)"},
        {"on_ret_20d": roll("sum", "night", 20), "id_ret_20d": roll("sum", "intra", 20), "na": roll("sum", "abs(night)", 20),
         "ia": roll("sum", "abs(intra)", 20), "on_vol_ratio_20d": div(roll("stddev_samp", "night", 20), f"({roll('stddev_samp', 'intra', 20)})")},
        {"on_share_20d": div("na", "na + ia"), "on_minus_id_20d": "on_ret_20d - id_ret_20d", "on_ret_catrank": pr("on_ret_20d", DC),
         "id_ret_catrank": pr("id_ret_20d", DC)},
    ],
}

SCALE = {"amihud_20d": 1e6}


def _family(fs: FM.FeatureSet, ident: str):
    def run(spark, sf):
        df = build(B.panel(spark, sf), [fs], B.universe_rows(spark, sf))
        return df.withColumns({c: df[c] * s for c, s in SCALE.items() if c in df.columns})

    run.__name__ = f"family_{fs.name}"
    query(ident, out_sql(FAMILY_SQL[fs.name], fs.columns, scale=SCALE))(run)


for _i, _fs in enumerate(FM.FAMILIES):
    _family(_fs, f"F{_i + 3}")


def _combined_sql():
    parts, selects, joins = B.PANEL_SQL, [], []
    for fs in FM.FAMILIES:
        prev = "panel"
        for i, stage in enumerate(FAMILY_SQL[fs.name]):
            name = f"{fs.name}_{i}"
            parts += f",\n{name} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {prev})"
            prev = name
        selects += [r(f"{prev}.{c} * {SCALE[c]}" if c in SCALE else f"{prev}.{c}", c) for c in fs.columns]
        joins.append(f"JOIN {prev} ON {prev}.date = p.date AND {prev}.ticker = p.ticker")
    return f"{parts} SELECT p.date, p.ticker, {', '.join(selects)} FROM panel p {' '.join(joins)}"


@query("F13 J5 S3", _combined_sql())
def family_combined(spark, sf):
    df = build(B.panel(spark, sf), FM.FAMILIES, B.universe_rows(spark, sf))
    return df.withColumns({c: df[c] * s for c, s in SCALE.items()})


def _sr_sql():
    s0 = {}
    for k in (20, 60):
        s0[f"res_{k}"] = roll("max", "high", k, skip=1)
        s0[f"sup_{k}"] = roll("min", "low", k, skip=1)
    s1 = {"at_res": flag("high >= res_20 * (1 - 0.02)"), "at_sup": flag("low <= sup_20 * (1 + 0.02)")}
    for k in (20, 60):
        s1[f"dist_res_{k}"] = f"(res_{k} - close) / close"
        s1[f"dist_sup_{k}"] = f"(close - sup_{k}) / close"
        s1[f"range_pos_{k}"] = div(f"close - sup_{k}", f"res_{k} - sup_{k}")
    s1.update({"sr_width_20": "(res_20 - sup_20) / close", "broke_res_20": flag("close > res_20"), "broke_sup_20": flag("close < sup_20")})
    s2 = {"res_touch_20": roll("sum", "at_res", 20, skip=1), "sup_touch_20": roll("sum", "at_sup", 20, skip=1)}
    cols = [*[f"{n}_{k}" for k in (20, 60) for n in ("dist_res", "dist_sup", "range_pos")],
            "sr_width_20", "res_touch_20", "sup_touch_20", "broke_res_20", "broke_sup_20"]
    return out_sql([s0, s1, s2], cols)


@query("F2", _sr_sql())
def support_resistance(spark, sf):
    return FM.support_resistance(B.panel(spark, sf))


STATIC = ["pos_stock", "top1_weight", "earn_yield"]


def _composition_sql():
    base = (f"{B.PANEL_SQL}, {COMPOSITION_SQL}, f AS (SELECT m.ticker, m.category, "
            + ", ".join(f"CASE WHEN pos_stock IS NOT NULL THEN coalesce({c}, 0) ELSE {c} END AS {c}" for c in SEC_COLS)
            + ", pos_stock, top1_weight, earn_yield FROM meta m LEFT JOIN comp USING (ticker)), "
            + "g AS (SELECT *, (" + " + ".join(f"coalesce(abs({c} - avg({c}) OVER (PARTITION BY category)), 0)" for c in SEC_COLS)
            + ") / 2 AS sec_dist_cat, pos_stock - avg(pos_stock) OVER (PARTITION BY category) AS pos_stock_catrel FROM f), ")
    names = [*SEC_COLS, *STATIC, "sec_dist_cat", "pos_stock_catrel"]
    base += ("h AS (SELECT p.date, p.ticker, p.category, " + ", ".join(f"CASE WHEN p.close IS NOT NULL THEN g.{c} END AS {c}" for c in names)
             + " FROM panel p JOIN g USING (ticker))")
    cols = ", ".join(r(c) for c in names)
    return (f"{base} SELECT date, ticker, {cols}, {r(pr('top1_weight', DC), 'top1_weight_catrank')}, "
            f"{r(pr('earn_yield', DC), 'earn_yield_catrank')} FROM h")


@query("F14 S8 J10", _composition_sql())
def composition_features(spark, sf):
    comp = EX.align_composition(composition(spark, sf), B.metadata(spark, sf).select("ticker", "category"), SEC_COLS, ["pos_stock"])
    return EX.composition(B.panel(spark, sf), comp, SEC_COLS, STATIC, ["top1_weight", "earn_yield"], group_rows=B.universe_rows(spark, sf))


# fixed choice: tickers standing for the market proxies
PROXIES = {role: f"F{i:09d}" for i, role in enumerate(EX.ROLES)}


def _droll(agg, x, k):
    o = f"OVER (ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {o} >= {k} THEN {agg}({x}) {o} END"


def _state_stages():
    roles = ", ".join(f"max(r1) FILTER (ticker = '{t}') AS {role}" for role, t in PROXIES.items())
    base = staged([{**ret(1), "sma": roll("avg", "close", 50)}]).replace("z AS MATERIALIZED", "a AS MATERIALIZED")
    s = lambda c: f"({_droll('sum', c, 20)})"
    return f"""{base}, d0 AS (SELECT date, t, avg(r1) AS mkt, stddev_samp(r1) AS sd,
  avg(CASE WHEN close IS NOT NULL THEN CASE WHEN close > sma THEN 1.0 ELSE 0.0 END END) AS mkt_breadth_50, {roles} FROM a GROUP BY 1, 2),
d AS (SELECT date, mkt, rates, mkt_breadth_50, {s('equity')} AS mkt_eq_trend_20d, {_droll('stddev_samp', 'equity', 20)} AS mkt_eq_vol_20d,
  {_droll('avg', 'sd', 5)} AS mkt_disp_5d, {s('rates')} AS mkt_rates_mom_20d, {s('rates')} - {s('short_rates')} AS mkt_curve_mom_20d,
  {s('high_yield')} - {s('investment_grade')} AS mkt_credit_mom_20d, {s('gold')} AS mkt_gold_mom_20d, {s('dollar')} AS mkt_dollar_mom_20d FROM d0),
b AS (SELECT a.date, t, ticker, category, close, r1, d.* EXCLUDE (date) FROM a JOIN d USING (date)),
c AS (SELECT *, {div(pair('covar_samp', 'r1', 'mkt', 60), '(' + roll('var_samp', 'mkt', 60) + ')')} AS beta, {pair('corr', 'r1', 'rates', 60)} AS dur_corr_60d FROM b),
e AS (SELECT *, beta * mkt_eq_trend_20d AS beta_x_eqtrend, beta * mkt_eq_vol_20d AS beta_x_eqvol, dur_corr_60d * mkt_rates_mom_20d AS durcorr_x_ratesmom FROM c)
"""


STATES = ["mkt_eq_trend_20d", "mkt_eq_vol_20d", "mkt_disp_5d", "mkt_rates_mom_20d", "mkt_curve_mom_20d", "mkt_credit_mom_20d",
          "mkt_gold_mom_20d", "mkt_dollar_mom_20d", "mkt_breadth_50"]
INTER = f"""{B.rs('beta_x_eqtrend', 'beta_x_eqvol', 'dur_corr_60d', 'durcorr_x_ratesmom')},
  {r(pr('beta_x_eqvol', DC), 'beta_x_eqvol_catrank')}, {r(pr('dur_corr_60d', DC), 'durcorr_catrank')}"""


@query("F15 J3", f"""{_state_stages()} SELECT date, ticker, {', '.join(r(f'CASE WHEN close IS NOT NULL THEN {c} END', c) for c in STATES)},
  {INTER} FROM e""")
def market_state(spark, sf):
    return EX.market_state(B.panel(spark, sf), PROXIES, B.universe_rows(spark, sf))


@query("F16", f"{_state_stages()} SELECT date, ticker, {INTER} FROM e")
def market_interactions(spark, sf):
    return EX.market_state(B.panel(spark, sf), PROXIES, B.universe_rows(spark, sf)).select("date", "ticker", *EX.INTERACTIONS)


SPILL = staged([
    ret(1, 5, 20),
    {"p1": loo("r1"), "p5": loo("r5"), "p20": loo("r20"), "c5": cat("avg(r5)"), "c20": cat("avg(r20)")},
    {"spill_gap_5d": f"lag(p5 - r5) OVER ({B.AXIS})", "spill_gap_20d": f"lag(p20 - r20) OVER ({B.AXIS})", "p0": lag("p1")},
    {"follower_60d": pair("corr", "r1", "p0", 60), "cat_persist_60d": pair("corr", "p1", "p0", 60)},
])


@query("F17", f"""{SPILL}, k AS (SELECT date, category, any_value(c5) AS c5, any_value(c20) AS c20 FROM z GROUP BY 1, 2),
kr AS (SELECT date, category, {pr('c5', 'date')} AS k5, {pr('c20', 'date')} AS k20 FROM k)
SELECT z.date, ticker, {B.rs('spill_gap_5d', 'spill_gap_20d', 'follower_60d', 'cat_persist_60d')}, {r('follower_60d * spill_gap_5d', 'follow_x_spill')},
  {r('CASE WHEN close IS NOT NULL THEN k20 END', 'cat_mom_rank_20d')}, {r('CASE WHEN close IS NOT NULL THEN k5 END', 'cat_mom_rank_5d')}
FROM z JOIN kr USING (date, category)""")
def spillover_features(spark, sf):
    return EX.spillover(B.panel(spark, sf), B.universe_rows(spark, sf))
