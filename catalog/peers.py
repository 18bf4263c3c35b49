"""Cross-sectional and peer-group functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import DC, chg, loo, pr, r, roll, rs, tile_sql
from catalog.registry import query
from crosspanel.operators import cross as X
from crosspanel.operators import peers as G
from crosspanel.operators import rolling as R

RET = f"""{B.PANEL_SQL}, a AS (SELECT *, {chg('close')} AS r1, {chg('close', 5)} AS r5, {chg('close', 20)} AS r20 FROM panel)"""


def returns(spark, sf):
    g = B.panel(spark, sf)
    return g.withColumns({"r1": R.pct_change("close"), "r5": R.pct_change("close", 5), "r20": R.pct_change("close", 20)})


@query("X1 X2", f"""{RET}
SELECT date, ticker, {r(pr('r20', 'date'), 'rank_all')}, {r(pr('r20', DC), 'rank_peers')},
  {r(pr('volume', 'date'), 'rank_volume')} FROM a""")
def percentile_ranks(spark, sf):
    n = B.universe_rows(spark, sf)
    g = X.pct_rank(returns(spark, sf), X.DATE, {"rank_all": "r20", "rank_volume": "volume"}, n)
    g = X.pct_rank(g, X.PEERS, {"rank_peers": "r20"}, n)
    return g.select("date", "ticker", "rank_all", "rank_peers", "rank_volume")


def over(fn):
    return f"{fn} OVER (PARTITION BY {DC})"


@query("X3", f"""{RET}
SELECT date, ticker, {r(over('avg(r5)'), 'mean')}, {r(over('median(r5)'), 'median')}, {r(over('stddev_samp(r5)'), 'std')},
  {r(over('sum(volume)'), 'total')}, {over('count(r5)')} AS n FROM a""")
def category_stats(spark, sf):
    n = B.universe_rows(spark, sf)
    g = X.group_stats(returns(spark, sf), X.PEERS, {
        "mean": F.avg("r5"), "std": F.stddev_samp("r5"), "total": F.sum("volume"), "n": F.count("r5")}, n)
    g = X.group_median(g, X.PEERS, {"median": "r5"}, n)
    return g.select("date", "ticker", "mean", "median", "std", "total", "n")


@query("X4 X5", f"""{RET}
SELECT date, ticker, {r(loo('r5', DC, True), 'loo_own')}, {r(loo('r5'), 'loo_others')}, {r('r5 - ' + loo('r5'), 'rel')} FROM a""")
def leave_one_out(spark, sf):
    n = B.universe_rows(spark, sf)
    g = X.add_loo(returns(spark, sf), X.PEERS, {"loo_own": "r5"}, True, n)
    g = X.add_loo(g, X.PEERS, {"loo_others": "r5"}, False, n)
    return g.select("date", "ticker", "loo_own", "loo_others", (F.col("r5") - F.col("loo_others")).alias("rel"))


def z(x, keys):
    o = f"OVER (PARTITION BY {keys})"
    return f"({x} - avg({x}) {o}) / nullif(stddev_samp({x}) {o}, 0)"


@query("X6 X7", f"""{RET}
SELECT date, ticker, CASE WHEN {z('volume', DC)} IS NOT NULL THEN {r(f"least(5, greatest(-5, {z('volume', DC)}))").split(' AS ')[0]} END AS z_peers,
  {r(f"(r5 - avg(r5) OVER (PARTITION BY date)) / CASE WHEN stddev_samp(r5) OVER (PARTITION BY date) > 0 THEN stddev_samp(r5) OVER (PARTITION BY date) ELSE 1 END", 'z_day')} FROM a
""")
def zscores(spark, sf):
    n = B.universe_rows(spark, sf)
    g = X.zscore(returns(spark, sf), X.PEERS, {"z_peers": "volume"}, bound=5.0, group_rows=n)
    g = X.zscore(g, X.DATE, {"z_day": "r5"}, flat="one", group_rows=n)
    return g.select("date", "ticker", "z_peers", "z_day")


@query("X8", f"""{RET}
SELECT date, ticker, {r('median(r20) OVER (PARTITION BY date)', 'day_median')},
  {r('abs(r20 - median(r20) OVER (PARTITION BY date))', 'conviction')} FROM a""")
def daily_conviction(spark, sf):
    g = X.group_median(returns(spark, sf), X.DATE, {"day_median": "r20"}, B.universe_rows(spark, sf))
    return g.select("date", "ticker", "day_median", F.abs(F.col("r20") - F.col("day_median")).alias("conviction"))


@query("X9", f"""{RET}, o AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY r20, ticker) AS rn,
  count(*) OVER (PARTITION BY date) AS n FROM a WHERE r20 IS NOT NULL)
SELECT date, ticker, {tile_sql('rn', 'n', 3)} AS tercile, {tile_sql('rn', 'n', 10)} AS decile FROM o""")
def first_rank_tiles(spark, sf):
    n = B.universe_rows(spark, sf)
    g = returns(spark, sf).filter(F.col("r20").isNotNull())
    g = X.quantile_tile(g, X.DATE, "r20", "tercile", 3, group_rows=n)
    return X.quantile_tile(g, X.DATE, "r20", "decile", 10, group_rows=n).select("date", "ticker", "tercile", "decile")


DAYS = "(ORDER BY t ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def droll(agg, x, k, need=None):
    o = f"OVER {DAYS.format(k - 1)}"
    return f"CASE WHEN count({x}) {o} >= {need or k} THEN {agg}({x}) {o} END"


@query("X10", f"""{B.PANEL_SQL}, a AS (SELECT *, {chg('close')} AS r1, {roll('avg', 'close', 50)} AS sma FROM panel),
d AS (SELECT date, t, avg(r1) AS m, sum(CASE WHEN close > sma THEN 1.0 ELSE 0.0 END) / nullif(count(close), 0) AS breadth_50d FROM a GROUP BY 1, 2),
v AS (SELECT *, {droll('stddev_samp', 'm', 20)} AS vol FROM d)
SELECT date, {r('m', 'mkt_ret_1d')}, {r('vol', 'mkt_vol_20d')},
  {r(f"(vol - ({droll('avg', 'vol', 252, 60)})) / nullif(({droll('stddev_samp', 'vol', 252, 60)}), 0)", 'mkt_vol_zscore')}, {rs('breadth_50d')} FROM v""")
def market_series(spark, sf):
    g = B.panel(spark, sf).select("date", "t", "ticker", "close").withColumns(
        {"ret_1d": R.pct_change("close"), "sma_50": R.mean("close", 50)})
    return G.market_regime(g, "sma_50")


@query("X11", f"""{RET}, c AS (SELECT date, category, avg(r20) AS m FROM a GROUP BY 1, 2),
k AS (SELECT date, category, {pr('m', 'date')} AS k FROM c)
SELECT a.date, ticker, CASE WHEN close IS NOT NULL THEN round(k, 6) + 0.0 END AS category_rank FROM a JOIN k USING (date, category)""")
def category_rank(spark, sf):
    return G.category_rank(returns(spark, sf), "r20", "category_rank").select("date", "ticker", "category_rank")


@query("X12 X13", f"""{RET}, b AS (SELECT *, {over('avg(r20)')} AS m FROM a)
SELECT date, ticker, {r(over('avg(CASE WHEN r5 IS NOT NULL THEN CASE WHEN r5 > 0 THEN 1.0 ELSE 0.0 END END)'), 'up_share')},
  {r(over('avg(CASE WHEN r20 > m THEN 1.0 ELSE 0.0 END)'), 'beat_share')} FROM b""")
def category_breadth(spark, sf):
    n = B.universe_rows(spark, sf)
    g = G.breadth(returns(spark, sf), "r5", "up_share", n)
    return G.share_above_mean(g, "r20", "beat_share", n).select("date", "ticker", "up_share", "beat_share")


@query("X14", f"""{RET}, d AS (SELECT date, t, stddev_samp(r1) AS sd FROM a GROUP BY 1, 2)
SELECT date, {r(droll('avg', 'sd', 5), 'dispersion')} FROM d""")
def return_dispersion(spark, sf):
    return G.dispersion(returns(spark, sf)).select("date", "dispersion")


# fixed list: the sizes of parts whose share of a ticker's volume stands for a sector weight
SECTORS = 5

COMPOSITION_SQL = f"""
comp AS MATERIALIZED (SELECT {B.TICKER_SQL.format(k='l_suppkey')} AS ticker,
  {', '.join(f"CASE WHEN sum(l_quantity) FILTER (p_size % {SECTORS} = {i}) > 0 THEN sum(l_quantity) FILTER (p_size % {SECTORS} = {i}) / sum(l_quantity) END AS sec_{i}" for i in range(SECTORS))},
  sum(l_quantity) FILTER (p_type = 'ECONOMY') / sum(l_quantity) AS pos_stock,
  max(l_quantity) / sum(l_quantity) AS top1_weight,
  sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS earn_yield
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def composition(spark, sf):
    """A per-ticker composition snapshot from shipped parts."""
    li = B.table(spark, sf, "lineitem")
    p = B.table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    rows = li.join(p, li.l_partkey == p.p_partkey).select(
        B._ticker("l_suppkey").alias("ticker"), "l_quantity", "p_size", "p_type", "l_extendedprice", "l_discount")
    q = F.sum("l_quantity")
    sec = [F.sum(F.when(F.col("p_size") % SECTORS == i, F.col("l_quantity"))) for i in range(SECTORS)]
    return rows.groupBy("ticker").agg(
        *[F.when(s > 0, s / q).alias(f"sec_{i}") for i, s in enumerate(sec)],
        (F.sum(F.when(F.col("p_type") == "ECONOMY", F.col("l_quantity"))) / q).alias("pos_stock"),
        (F.max("l_quantity") / q).alias("top1_weight"),
        (F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")).alias("earn_yield"),
    )


SEC_COLS = [f"sec_{i}" for i in range(SECTORS)]


@query("X15 S8", f"""{B.META.replace('meta AS', 'WITH meta AS', 1)}, {COMPOSITION_SQL},
f AS (SELECT m.ticker, m.category, {', '.join(f'CASE WHEN pos_stock IS NOT NULL THEN coalesce({c}, 0) ELSE {c} END AS {c}' for c in SEC_COLS)} FROM meta m LEFT JOIN comp USING (ticker))
SELECT ticker, category, {r('(' + ' + '.join(f'coalesce(abs({c} - avg({c}) OVER (PARTITION BY category)), 0)' for c in SEC_COLS) + ') / 2', 'mix_distance')} FROM f""")
def sector_mix_distance(spark, sf):
    from crosspanel.plans.extras import align_composition

    comp = align_composition(composition(spark, sf), B.metadata(spark, sf).select("ticker", "category"), SEC_COLS, ["pos_stock"])
    return G.mix_distance(comp, SEC_COLS, ["category"], "mix_distance", B.universe_rows(spark, sf)).select(
        "ticker", "category", "mix_distance")


@query("X16", f"""{RET}, k AS (SELECT *, exp(r20 * 10 - max(r20 * 10) OVER (PARTITION BY {DC})) AS w FROM a WHERE r20 IS NOT NULL)
SELECT date, ticker, {r(over('sum(r5 * w)') + ' / ' + over('sum(w)'), 'pool_r5')}, {r(over('sum(volume * w)') + ' / ' + over('sum(w)'), 'pool_volume')} FROM k""")
def attention_pool(spark, sf):
    g = returns(spark, sf).filter(F.col("r20").isNotNull()).withColumn("score", F.col("r20") * 10)
    return G.softmax_pool(g, "score", ["r5", "volume"], B.universe_rows(spark, sf)).select("date", "ticker", "pool_r5", "pool_volume")


@query("X17", f"""{RET}, o AS (SELECT date, ticker, category, r5, row_number() OVER (PARTITION BY date, category ORDER BY ('0x' || substr(md5(concat_ws('|', date::VARCHAR, category, ticker)), 1, 15))::BIGINT, ticker) AS pos,
  count(*) OVER (PARTITION BY date, category) AS n FROM a WHERE r5 IS NOT NULL),
d AS (SELECT *, (pos - 1 + draw) % n + 1 AS partner FROM (SELECT *, unnest(generate_series(1, 4)) AS draw FROM o) WHERE draw < n)
SELECT d.date, d.category, d.draw, d.ticker, o.ticker AS other, {r('d.r5', 'r5')}, {r('o.r5', 'other_rel')}
FROM d JOIN o ON o.date = d.date AND o.category = d.category AND o.pos = d.partner WHERE o.r5 <> d.r5""")
def peer_pairs(spark, sf):
    return G.sample_pairs(returns(spark, sf), "r5", 4, B.universe_rows(spark, sf))
