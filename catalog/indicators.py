"""Feature sets with exponential smoothing, and the smaller named sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import DC, chg, lag, loo, pr, r, roll, rs
from catalog.families import cat, div, flag, out_sql, staged
from catalog.quality import NEWS_SQL, news
from catalog.registry import query
from catalog.trailing import beta_sql, ewm_cte, pair
from crosspanel.operators import joins as J
from crosspanel.operators import recurrence as E
from crosspanel.operators import rolling as R
from crosspanel.plans import indicators as I
from crosspanel.sources import news as N

RECURSIVE = B.PANEL_SQL.replace("WITH", "WITH RECURSIVE", 1)
W14 = 1 / 14
STEP = f"(close - {lag('close')})"
PC = lag("close")


def retd(*ns):
    return {f"ret_{n}d": chg("close", n) for n in ns}


GL = {"gain": f"CASE WHEN {STEP} IS NOT NULL THEN greatest({STEP}, 0) END",
      "loss": f"CASE WHEN {STEP} IS NOT NULL THEN -least({STEP}, 0) END"}
TR = (f"CASE WHEN high IS NOT NULL AND {PC} IS NOT NULL THEN greatest(high - low, abs(high - {PC}), abs(low - {PC})) END")
UP, DOWN = f"(high - {lag('high')})", f"({lag('low')} - low)"
DM = {"plus_dm": f"CASE WHEN {UP} > {DOWN} AND {UP} > 0 THEN {UP} ELSE 0.0 END",
      "minus_dm": f"CASE WHEN {DOWN} > {UP} AND {DOWN} > 0 THEN {DOWN} ELSE 0.0 END"}


def smoothed(first_stage: dict, series: dict, derived: dict, second: dict, table: str = "a") -> str:
    """Grid columns, recursive means and their second smoothing as one table ``g``."""
    pre = staged([first_stage], RECURSIVE).replace("z AS MATERIALIZED", f"{table} AS MATERIALIZED")
    pre += f",\n{ewm_cte('e', table, series, derived, second)}"
    firsts = ", ".join(f"e_d.{c}" for c in [*series, *derived])
    seconds = ", ".join(f"e_2.{c}" for c in second)
    return pre + (f",\ng AS MATERIALIZED (SELECT a.*, {firsts}, {seconds} FROM {table} a "
                  "JOIN e_d ON e_d.ticker = a.ticker AND e_d.t = a.t JOIN e_2 ON e_2.ticker = a.ticker AND e_2.t = a.t)")


def ownz(x, k, need):
    return f"({x} - ({roll('avg', x, k, need)})) / nullif(({roll('stddev_samp', x, k, need)}), 0)"


def bounded(x, lo, hi):
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


V3_BASE = smoothed(
    {**retd(1, 5, 10, 20, 60), "tr": TR, **DM, **GL},
    {"ema_20": ("close", E.span(20)), "ema_50": ("close", E.span(50)), "e12": ("close", E.span(12)), "e26": ("close", E.span(26)),
     "atr_14": ("tr", W14), "pdm": ("plus_dm", W14), "mdm": ("minus_dm", W14), "ag": ("gain", W14), "al": ("loss", W14)},
    {"macd": "e12 - e26", "dx": "100 * abs(100 * pdm / nullif(atr_14, 0) - 100 * mdm / nullif(atr_14, 0)) / nullif(100 * pdm / nullif(atr_14, 0) + 100 * mdm / nullif(atr_14, 0), 0)"},
    {"macd_signal": ("macd", E.span(9)), "adx_14": ("dx", W14)},
)
DAY = "OVER (PARTITION BY date)"


def v3_stages(dc: str):
    catw = lambda a: f"{a} OVER (PARTITION BY {dc})"
    return [
        {"vol_20d": roll("stddev_samp", "ret_1d", 20), "rsi_14": "100 - 100 / (1 + ag / nullif(al, 0))", "macd_hist": "macd - macd_signal",
         "hh": roll("max", "high", 14), "ll": roll("min", "low", 14), "mid": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20),
         "tp": "(high + low + close) / 3", "dv": "close * volume",
         "mfm": "CASE WHEN high = low AND close IS NOT NULL THEN 0.0 ELSE least(1, greatest(-1, ((close - low) - (high - close)) / nullif(high - low, 0))) END"},
        {"mkt_ret_1d": f"avg(ret_1d) {DAY}", "breadth_50d": f"sum(CASE WHEN close > ema_50 THEN 1.0 ELSE 0.0 END) {DAY} / nullif(count(close) {DAY}, 0)",
         "cs_rank_ret_5d": pr("ret_5d", "date"), "cs_rank_ret_20d": pr("ret_20d", "date"), "cs_rank_rsi": pr("rsi_14", "date"),
         "cs_rank_volatility": pr("vol_20d", "date"), "cs_rank_volume": pr("volume", "date"), "cat_ret_1d": catw("avg(ret_1d)"),
         "cat_ret_5d": catw("avg(ret_5d)"), "cat_ret_20d": catw("avg(ret_20d)"), "cat_disp_5d": catw("stddev_samp(ret_5d)"),
         "peer_rank_20d": pr("ret_20d", dc), "dtp": f"tp - {lag('tp')}"},
        {"beat_rate_20d": catw("avg(CASE WHEN ret_20d > cat_ret_20d THEN 1.0 ELSE 0.0 END)"), "mkt_vol_20d": roll("stddev_samp", "mkt_ret_1d", 20),
         "pf": "CASE WHEN dtp > 0 THEN tp * volume ELSE 0.0 END", "nf": "CASE WHEN dtp < 0 THEN tp * volume ELSE 0.0 END", "fl": "mfm * volume",
         "ema20_dist": "close / ema_20 - 1", "ema50_dist": "close / ema_50 - 1",
         "willr_14": bounded("(-100 * (hh - close) / nullif(hh - ll, 0))", -100, 0), "stoch_k": bounded("(100 * (close - ll) / nullif(hh - ll, 0))", 0, 100),
         "bb_pctb": "(close - (mid - 2 * sd)) / nullif(4 * sd, 0)", "bb_bandwidth": "4 * sd / mid", "vol_zscore": ownz("vol_20d", 252, 60),
         "beta_60d": beta_sql("ret_1d", "cat_ret_1d", 60),
         "obv": f"sum(sign(coalesce(ret_1d, 0)) * coalesce(volume, 0)) OVER ({B.AXIS} ROWS UNBOUNDED PRECEDING)",
         "dollar_vol_20d": roll("avg", "dv", 20), "rel_volume_20d": f"volume / ({roll('avg', 'volume', 20)}) - 1",
         "d_rsi_5d": f"rsi_14 - {lag('rsi_14', 5)}", "d_peer_rank_5d": f"peer_rank_20d - {lag('peer_rank_20d', 5)}",
         "d_vol_5d": f"vol_20d - {lag('vol_20d', 5)}", "d_macd_hist_5d": f"macd_hist - {lag('macd_hist', 5)}",
         "d_volume_pct_5d": f"cs_rank_volume - {lag('cs_rank_volume', 5)}"},
        {"mkt_vol_zscore": ownz("mkt_vol_20d", 252, 60), "stoch_d": roll("avg", "stoch_k", 3),
         "mfi_14": f"100 - 100 / (1 + ({roll('sum', 'pf', 14)}) / nullif(({roll('sum', 'nf', 14)}), 0))",
         "cmf_20": f"({roll('sum', 'fl', 20)}) / nullif(({roll('sum', 'volume', 20)}), 0)"},
    ]


@query("F1", f"""{staged(v3_stages(DC), V3_BASE, 'g')}
SELECT date, ticker, {rs(*[c for c in I.V3_COLUMNS if c != 'dollar_vol_20d'])}, {r('dollar_vol_20d / 1000', 'dollar_vol_20d')} FROM z""")
def main_features(spark, sf):
    df = I.v3(B.panel(spark, sf), B.universe_rows(spark, sf)).drop("t", "close")
    return df.withColumn("dollar_vol_20d", F.col("dollar_vol_20d") / 1000)


@query("F20", f"""{staged(v3_stages('date'), V3_BASE, 'g')}
SELECT date, ticker, {', '.join(r(f'{c} / close' if c in I.PRICE_UNIT else c, c) for c in I.V3_COLUMNS if c not in I.ABSOLUTE_SCALE)} FROM z""")
def scale_free_features(spark, sf):
    return I.scale_free(B.panel(spark, sf), B.universe_rows(spark, sf))


V2_BASE = smoothed(
    {**retd(1, 5, 10, 20), "lstep": f"ln(close) - ln({lag('close')})", "ret_20d_skip5": f"({lag('close', 5)} / {lag('close', 25)} - 1)", **GL, "dv": "close * volume"},
    {"ema_10": ("close", E.span(10)), "ema_20": ("close", E.span(20)), "ema_50": ("close", E.span(50)), "e12": ("close", E.span(12)),
     "e26": ("close", E.span(26)), "ag": ("gain", W14), "al": ("loss", W14)},
    {"line": "e12 - e26"}, {"sig": ("line", E.span(9))},
)


def _mode(m, m5, m20, sfx):
    cov = f"(({roll('avg', f'(ret_1d * {m})', 60)}) - ({roll('avg', 'ret_1d', 60)}) * ({roll('avg', m, 60)}))"
    one = {f"beta_60d{sfx}": f"{cov} / greatest(({roll('var_samp', m, 60)}), 1e-8)", f"corr_cat_60d{sfx}": pair("corr", "ret_1d", m, 60),
           f"beat_rate_20d{sfx}": roll("avg", f"(CASE WHEN ret_1d IS NOT NULL AND {m} IS NOT NULL THEN CASE WHEN ret_1d > {m} THEN 1.0 ELSE 0.0 END END)", 20),
           f"cat_ret_5d{sfx}": m5, f"rel_str_5d{sfx}": f"ret_5d - {m5}"}
    two = {f"resid_ret_5d{sfx}": f"ret_5d - beta_60d{sfx} * {m5}", f"resid_ret_20d{sfx}": f"ret_20d - beta_60d{sfx} * {m20}",
           f"idio_vol_20d{sfx}": f"CASE WHEN corr_cat_60d{sfx} IS NOT NULL THEN vol_20d * sqrt(1 - least(1, corr_cat_60d{sfx} * corr_cat_60d{sfx})) END",
           f"tstat_rel_5d{sfx}": f"CASE WHEN vol_20d IS NOT NULL THEN rel_str_5d{sfx} / greatest(vol_20d / sqrt(252) * sqrt(5), 1e-6) END"}
    return one, two


_i1, _i2 = _mode("all_1", "all_5", "all_20", "")
_x1, _x2 = _mode("oth_1", "oth_5", "oth_20", "_xself")
V2_STAGES = [
    {"vol_20d": f"({roll('stddev_samp', 'lstep', 20)}) * sqrt(252)", "vol_20d_raw": roll("stddev_samp", "ret_1d", 20),
     "seen": f"count(gain) OVER ({B.AXIS} ROWS UNBOUNDED PRECEDING)"},
    {"all_1": cat("avg(ret_1d)"), "all_5": cat("avg(ret_5d)"), "all_20": cat("avg(ret_20d)"), "oth_1": loo("ret_1d", DC, True),
     "oth_5": loo("ret_5d", DC, True), "oth_20": loo("ret_20d", DC, True), "volm": cat("avg(vol_20d)"), "cat_disp_5d": cat("stddev_samp(ret_5d)"),
     "known": cat("count(ret_5d)"), "vm": cat("avg(volume)"), "vsd": cat("stddev_samp(volume)"),
     "cs_rank_ret_1d": pr("ret_1d", DC), "cs_rank_ret_5d": pr("ret_5d", DC), "cs_rank_skip_mom": pr("ret_20d_skip5", DC),
     "cs_rank_vol_20d": pr("vol_20d", DC), "peer_rank_20d": pr("ret_20d", DC), "cs_rank_dollar_vol": pr("dv", DC)},
    {**_i1, **_x1, **{f"px_to_sma_{n}": f"close / ({roll('avg', 'close', n)}) - 1" for n in (10, 20, 50)},
     **{f"px_to_ema_{n}": f"close / ema_{n} - 1" for n in (10, 20, 50)}, "macd": "line / close", "macd_signal": "sig / close",
     "macd_hist": "(line - sig) / close", "mid": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20),
     "rsi_14": "CASE WHEN seen >= 14 THEN CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 END ELSE 100 - 100 / (1 + ag / al) END END",
     "rel_vol_20d": "vol_20d / volm", "px_to_52w_high": f"close / ({roll('max', 'close', 252, 60)}) - 1",
     "ret_60d_skip5": f"{lag('close', 5)} / {lag('close', 65)} - 1", "cat_n": "CASE WHEN close IS NOT NULL THEN known END",
     "v20": roll('avg', 'volume', 20), "v5": roll('avg', 'volume', 5), "vzx": "(volume - vm) / (vsd + 1e-8)"},
    {**_i2, **_x2, "bb_pctb": "(close - (mid - 2 * sd)) / nullif(4 * sd, 0)", "bb_bandwidth": "4 * sd / mid",
     "rel_volume_20d": bounded("(v5 / CASE WHEN v20 IS NOT NULL THEN greatest(v20, 1e-6) END - 1)", -5, 5), "vol_zscore": bounded("vzx", -5, 5)},
]


@query("F18 F19", f"{staged(V2_STAGES, V2_BASE, 'g')} SELECT date, ticker, {rs(*I.V2_COLUMNS)} FROM z")
def second_features(spark, sf):
    return I.v2(B.panel(spark, sf), B.universe_rows(spark, sf))


BASIC_BASE = smoothed(
    {**retd(1, 5, 10, 20, 60), **GL, "hl": "(high - low) / close", "gap": f"(open / {lag('close')} - 1)", "dv": "close * volume"},
    {"e12": ("close", E.span(12)), "e26": ("close", E.span(26)), "ag": ("gain", W14), "al": ("loss", W14)},
    {"line": "e12 - e26"}, {"sig": ("line", E.span(9))},
)


@query("F21", f"""{staged([
    {'ret_20d_skip5': f"{lag('close', 5)} / {lag('close', 25)} - 1", 'ret_60d_skip5': f"{lag('close', 5)} / {lag('close', 65)} - 1",
     'vol_20d': roll('stddev_samp', 'ret_1d', 20), 'vol_60d': roll('stddev_samp', 'ret_1d', 60), 'hl_range_20d': roll('avg', 'hl', 20),
     'gap_20d': roll('avg', 'gap', 20), **{f'px_to_sma_{n}': f"close / ({roll('avg', 'close', n)}) - 1" for n in (10, 20, 50, 200)},
     'px_to_ema_12': 'close / e12 - 1', 'px_to_ema_26': 'close / e26 - 1', 'rsi_14': '100 - 100 / (1 + ag / nullif(al, 0))',
     'macd': 'line / close', 'macd_hist': '(line - sig) / close', 'mid': roll('avg', 'close', 20), 'sd': roll('stddev_samp', 'close', 20),
     'px_to_52w_high': f"close / ({roll('max', 'close', 252)}) - 1", 'px_to_52w_low': f"close / ({roll('min', 'close', 252)}) - 1",
     'rel_volume_20d': f"volume / ({roll('avg', 'volume', 20)}) - 1", 'dollar_vol_log': f"ln(1 + ({roll('avg', 'dv', 20)}))",
     'vol_zscore_20d': ownz('dv', 20, 20)},
    {'bb_pctb': '(close - (mid - 2 * sd)) / nullif(4 * sd, 0)', 'bb_bandwidth': '4 * sd / mid'}], BASIC_BASE, 'g')}
SELECT date, ticker, {rs(*I.BASIC_COLUMNS)} FROM z""")
def basic_features(spark, sf):
    return I.basic(B.panel(spark, sf))


@query("F22", out_sql([
    {"r1": chg("close"), "hl": "(high - low) / close"},
    {"vol_20d": roll("stddev_samp", "r1", 20), "vol_60d": roll("stddev_samp", "r1", 60), "hl_range_20d": roll("avg", "hl", 20)},
    {"vol_20d_rel": f"vol_20d - {loo('vol_20d')}", "vol_60d_rel": f"vol_60d - {loo('vol_60d')}", "vol_20d_catrank": pr("vol_20d", DC)},
], I.VOLATILITY_COLUMNS))
def volatility_levels(spark, sf):
    return I.volatility_levels(B.panel(spark, sf), B.universe_rows(spark, sf))


@query("F23", f"{B.PANEL_SQL} SELECT date, ticker, {rs('open', 'high', 'low', 'close', 'volume')} FROM panel")
def raw_floor(spark, sf):
    return I.raw_floor(B.panel(spark, sf))


@query("F27", out_sql([{"r1": chg("close"), "ret_5d": chg("close", 5)},
                       {"vol_21d": roll("stddev_samp", "r1", 21), "rel_str_5d": f"ret_5d - {cat('avg(ret_5d)')}"}],
                      ["ret_5d", "vol_21d", "rel_str_5d"]))
def simple_features(spark, sf):
    return I.simple(B.panel(spark, sf), B.universe_rows(spark, sf))


CHANNEL_STAGES = [
    {"r1": chg("close"), "logv": "CASE WHEN volume > 0 THEN ln(1 + volume) END", "hl": "(high - low) / close",
     "clv": "((close - low) - (high - close)) / nullif(high - low, 0)", "gap": f"open / {lag('close')} - 1",
     "dd60": f"close / ({roll('max', 'close', 60)}) - 1"},
    {"volz": ownz("logv", 60, 60), "r1_rel": f"r1 - {loo('r1')}", "rank_r1": f"({pr('r1', DC)}) - 0.5"},
]


@query("F25 W17", f"""{staged(CHANNEL_STAGES)}, k AS (SELECT *, {', '.join(f"count({c}) OVER {B.w(20)} AS n_{c}, sum({c}) OVER {B.w(20)} AS s_{c}" for c in I.CHANNELS)} FROM z)
SELECT date, ticker, 20 AS steps, {', '.join(r(f's_{c}', f'sum_{c}') for c in I.CHANNELS)} FROM k
WHERE {' AND '.join(f'n_{c} = 20' for c in I.CHANNELS)}""")
def channel_sequences(spark, sf):
    ch = I.channels(B.panel(spark, sf), B.universe_rows(spark, sf))
    s = R.sequences(ch, I.CHANNELS, 20)
    add = lambda f: F.aggregate(F.col(f"window.{f}"), F.lit(0.0), lambda a, x: a + x)
    return s.select("date", "ticker", F.size("window").alias("steps"), *[add(c).alias(f"sum_{c}") for c in I.CHANNELS])


@query("F26 J7", f"""{B.OHLCV_SQL}, {NEWS_SQL}, cal AS (SELECT DISTINCT date FROM ohlcv),
m AS (SELECT ticker, sent, coalesce((SELECT min(c.date) FROM cal c WHERE c.date >= n.day + 1), (SELECT max(date) FROM cal)) AS date FROM news n),
d AS (SELECT date, ticker, avg(sent) AS s, cast(count(*) AS double) AS n FROM m GROUP BY 1, 2)
SELECT date, ticker, {r('s', 'news_sent_1d')}, n AS news_n_1d,
  {r('avg(s) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING)', 'news_sent_5d')},
  sum(n) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING) AS news_n_5d FROM d""")
def news_features(spark, sf):
    days = B.ohlcv(spark, sf).select("date").distinct()
    placed = J.next_date(news(spark, sf).withColumn("after", F.date_add("day", 1)), "after", days, "date")
    return N.daily_sentiment(placed.select("date", "ticker", "sent"))


def _osc(spark, sf, lengths=None):
    return I.oscillators(B.panel(spark, sf), lengths, B.universe_rows(spark, sf))


def _osc_sql(n):
    k, s = n["rsi"], n["stoch_rsi"]
    p, f = n["pgo"], n["fisher"]
    pre = smoothed(
        {**GL, "tr": TR, "tp": "(high + low + close) / 3", "hl2": "(high + low) / 2"},
        {"g1": ("gain", 1 / k), "l1": ("loss", 1 / k), "g2": ("gain", 1 / s), "l2": ("loss", 1 / s), "atr_all": ("tr", 1 / p)},
        {"dummy": "0.0"}, {"dummy2": ("dummy", 0.5)})
    z = lambda x: f"({x} - {cat(f'avg({x})')}) / nullif({cat(f'stddev_samp({x})')}, 0)"
    return f"""{pre},
h AS MATERIALIZED (SELECT *, count(tr) OVER ({B.AXIS} ROWS UNBOUNDED PRECEDING) AS seen_tr, count(gain) OVER ({B.AXIS} ROWS UNBOUNDED PRECEDING) AS seen,
  {roll('avg', 'tp', n['cci'])} AS tpm, list(tp) FILTER (tp IS NOT NULL) OVER {B.w(n['cci'])} AS tpl, {roll('avg', 'close', n['bands'])} AS mid,
  {roll('stddev_samp', 'close', n['bands'])} AS sd, {roll('avg', 'close', p)} AS sp, {roll('min', 'hl2', f)} AS lo, {roll('max', 'hl2', f)} AS hi FROM g),
i AS MATERIALIZED (SELECT *, CASE WHEN seen >= {k} THEN 100 * g1 / nullif(g1 + l1, 0) END AS rsi, CASE WHEN seen >= {s} THEN 100 * g2 / nullif(g2 + l2, 0) END AS slow,
  CASE WHEN seen_tr >= {p} THEN atr_all END AS atr, (hl2 - lo) / greatest(hi - lo, 0.001) - 0.5 AS place,
  (tp - tpm) / nullif(0.015 * (list_sum(list_transform(tpl, lambda x: abs(x - tpm))) / {n['cci']}), 0) AS cci,
  (close - (mid - 2 * sd)) / nullif(4 * sd, 0) AS band_position FROM h),
i2 AS MATERIALIZED (SELECT *, 100 * (slow - ({roll('min', 'slow', s)})) / nullif(({roll('max', 'slow', s)}) - ({roll('min', 'slow', s)}), 0) AS st,
  count(atr) OVER ({B.AXIS} ROWS UNBOUNDED PRECEDING) AS seen_atr FROM i),
i3 AS MATERIALIZED (SELECT *, {roll('avg', 'st', 3)} AS stoch_rsi_k FROM i2),
i4 AS MATERIALIZED (SELECT *, {roll('avg', 'stoch_rsi_k', 3)} AS stoch_rsi_d FROM i3),
{ewm_cte('pe', 'i4', {'ema_atr': ('atr', E.span(p))})},
fi AS (SELECT ticker, t, 0.0::DOUBLE AS v, 0.0::DOUBLE AS lev, false AS got FROM i4 WHERE t = 0 UNION ALL
  SELECT ticker, t, nv, CASE WHEN got THEN 0.5 * (ln((1 + nv) / (1 - nv)) + lev) ELSE lev END, got FROM (
    SELECT s.ticker, s.t, q.lev, s.place IS NOT NULL AS got,
      CASE WHEN s.place IS NULL THEN q.v ELSE least(0.999, greatest(-0.999, 0.66 * s.place + 0.67 * q.v)) END AS nv
    FROM fi q JOIN i4 s ON s.ticker = q.ticker AND s.t = q.t + 1)),
y AS (SELECT i4.*, CASE WHEN seen_atr >= {p} THEN (close - sp) / nullif(ema_atr, 0) END AS pgo, CASE WHEN got THEN lev END AS fisher
  FROM i4 JOIN pe ON pe.ticker = i4.ticker AND pe.t = i4.t JOIN fi ON fi.ticker = i4.ticker AND fi.t = i4.t)
SELECT date, ticker, {', '.join(r(z(o), f'{o}_z') for o in I.OSCILLATORS)} FROM y"""


TWENTY = {k: 20 for k in I.OSCILLATOR_DEFAULTS}


@query("F24", _osc_sql(I.OSCILLATOR_DEFAULTS))
def oscillators_default(spark, sf):
    return _osc(spark, sf)


@query("F24", _osc_sql(TWENTY))
def oscillators_twenty(spark, sf):
    return _osc(spark, sf, TWENTY)
