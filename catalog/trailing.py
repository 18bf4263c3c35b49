"""Trailing window functions along one ticker."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import AXIS, chg, lag, r, roll, rs, w
from catalog.quality import NEWS_SQL, news
from catalog.registry import query
from crosspanel.operators import cross as X
from crosspanel.operators import recurrence as E
from crosspanel.operators import rolling as R
from crosspanel.operators import scan as SC
from crosspanel.sources import news as N


def _close(spark, sf, *more):
    return B.panel(spark, sf).select("date", "t", "ticker", "close", *more)


def _returns(spark, sf):
    return _close(spark, sf, "category").withColumn("r1", R.pct_change("close"))


RET = f"{B.PANEL_SQL}, a AS (SELECT *, {chg('close')} AS r1 FROM panel)"


@query("W1 W2 W3", f"""{B.PANEL_SQL}
SELECT date, ticker, {r(lag('close', 3), 'back_3')}, {r(f'lead(close, 2) OVER ({AXIS})', 'ahead_2')},
       {r(chg('close', 5), 'ret_5')}, {r('close - ' + lag('close'), 'step')} FROM panel""")
def shift_and_change(spark, sf):
    return _close(spark, sf).select(
        "date", "ticker", R.lag("close", 3).alias("back_3"), R.lead("close", 2).alias("ahead_2"),
        R.pct_change("close", 5).alias("ret_5"), R.diff("close").alias("step"))


@query("W2 U9", f"""{B.DAILY_SQL} SELECT date, ticker, {r(chg('close', 1), 'ret_1')}, {r(chg('close', 7), 'ret_7')} FROM panel""")
def change_with_gaps(spark, sf):
    g = B.panel(spark, sf, B.daily(spark, sf))
    return g.select("date", "ticker", R.pct_change("close").alias("ret_1"), R.pct_change("close", 7).alias("ret_7"))


@query("W4", f"""{B.PANEL_SQL}
SELECT date, ticker, {r(roll('avg', 'close', 20), 'mean_20')}, {r(roll('sum', 'volume', 5), 'sum_5')},
  {r(roll('min', 'low', 14), 'low_14')}, {r(roll('max', 'high', 14), 'high_14')},
  {r(roll('stddev_samp', 'close', 20), 'std_20')}, count(close) OVER {w(20)} AS seen_20 FROM panel""")
def rolling_stats(spark, sf):
    return B.panel(spark, sf).select(
        "date", "ticker", R.mean("close", 20).alias("mean_20"), R.total("volume", 5).alias("sum_5"),
        R.lowest("low", 14).alias("low_14"), R.highest("high", 14).alias("high_14"),
        R.std("close", 20).alias("std_20"), R.observed("close", 20).alias("seen_20"))


@query("W5", f"""{RET}, v AS (SELECT *, {roll('stddev_samp', 'r1', 20)} AS vol FROM a)
SELECT date, ticker, {r(roll('avg', 'vol', 252, 60), 'mean_252')}, {r(roll('stddev_samp', 'vol', 252, 60), 'std_252')},
  {r(roll('avg', 'CASE WHEN r1 < 0 THEN r1 END', 20, 5), 'down_20')} FROM v""")
def rolling_min_periods(spark, sf):
    v = _returns(spark, sf).withColumn("vol", R.std("r1", 20))
    return v.select("date", "ticker", R.mean("vol", 252, 60).alias("mean_252"), R.std("vol", 252, 60).alias("std_252"),
                    R.mean(F.when(F.col("r1") < 0, F.col("r1")), 20, 5).alias("down_20"))


def pair(agg: str, x: str, y: str, k: int) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
    out = f"CASE WHEN count({a}) OVER {w(k)} >= {k} THEN {agg}({a}, {b}) OVER {w(k)} END"
    if agg == "corr":
        out = (f"CASE WHEN stddev_pop({a}) OVER {w(k)} > 1e-12 AND stddev_pop({b}) OVER {w(k)} > 1e-12 THEN {out} END")
    return out


@query("W6", f"""{RET}, m AS (SELECT *, avg(r1) OVER (PARTITION BY date) AS mkt FROM a)
SELECT date, ticker, {r(pair('covar_samp', 'r1', 'mkt', 60), 'cov_60', 9)}, {r(roll('var_samp', 'mkt', 60), 'var_60', 9)},
  {r(pair('corr', 'r1', 'mkt', 60), 'corr_60')} FROM m""", digits=9)
def rolling_pairs(spark, sf):
    m = X.group_stats(_returns(spark, sf), X.DATE, {"mkt": F.avg("r1")}, B.universe_rows(spark, sf))
    m = m.withColumns({**R.pair_sums("p", "r1", "mkt", 60), "var_60": R.var("mkt", 60)})
    return m.select("date", "ticker", R.pair_cov("p", 60).alias("cov_60"), "var_60", F.round(R.pair_corr("p", 60), 6).alias("corr_60"))


def beta_sql(x: str, m: str, k: int) -> str:
    num = f"({roll('avg', f'({x} * {m})', k)}) - ({roll('avg', x, k)}) * ({roll('avg', m, k)})"
    den = f"(({roll('avg', f'({m} * {m})', k)}) - ({roll('avg', m, k)}) * ({roll('avg', m, k)}))"
    return f"CASE WHEN abs({den}) > 1e-24 THEN ({num}) / {den} END"


@query("W7", f"""{RET}, m AS (SELECT *, avg(r1) OVER (PARTITION BY date, category) AS peer FROM a)
SELECT date, ticker, {r(beta_sql('r1', 'peer', 60), 'beta_60')} FROM m""")
def rolling_moment_beta(spark, sf):
    m = X.group_stats(_returns(spark, sf), X.PEERS, {"peer": F.avg("r1")}, B.universe_rows(spark, sf))
    return m.withColumns(R.pair_sums("p", "r1", "peer", 60)).select("date", "ticker", R.pair_beta("p", 60).alias("beta_60"))


@query("W8", f"""{RET} SELECT date, ticker, {r(roll('skewness', 'r1', 60), 'skew_60')},
  {r(roll('kurtosis', 'r1', 60), 'kurt_60')} FROM a""")
def rolling_shape(spark, sf):
    p = _returns(spark, sf).withColumns(R.power_sums("p", "r1", 60))
    return p.select("date", "ticker", R.skew_of("p", 60).alias("skew_60"), R.kurt_of("p", 60).alias("kurt_60"))


def own_rank_sql(x: str, k: int) -> str:
    v = f"list({x}) FILTER ({x} IS NOT NULL) OVER {w(k)}"
    return (f"CASE WHEN len({v}) = {k} THEN (len(list_filter({v}, lambda e: e < {x})) + "
            f"(len(list_filter({v}, lambda e: e = {x})) + 1) / 2.0) / {k} END")


@query("W9", f"{B.PANEL_SQL} SELECT date, ticker, {r(own_rank_sql('volume', 252), 'own_rank')} FROM panel")
def own_history_rank(spark, sf):
    return E.own_rank(_close(spark, sf, "volume"), {"own_rank": ("volume", 252)}).select("date", "ticker", "own_rank")


@query("W10 W11", f"""{B.PANEL_SQL},
f AS (SELECT *, last_value(close IGNORE NULLS) OVER ({AXIS} ROWS UNBOUNDED PRECEDING) AS ff,
  first_value(close IGNORE NULLS) OVER ({AXIS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM panel),
l AS (SELECT *, list(coalesce(ff, -1e300)) OVER {w(60)} AS v FROM f)
SELECT date, ticker, {r('ff', 'forward')}, {r('bf', 'backward')},
  CASE WHEN close IS NOT NULL AND len(v) = 60 THEN 60.0 - list_position(v, list_max(v)) END AS since_high FROM l""")
def fill_and_since_high(spark, sf):
    f = _close(spark, sf).withColumns({"forward": R.ffill("close"), "backward": R.bfill("close")})
    return f.select("date", "ticker", "forward", "backward", R.rows_since_high("forward", "close", 60).alias("since_high"))


@query("W12", f"""{RET}, c AS (SELECT *, sum(sign(coalesce(r1, 0)) * coalesce(volume, 0)) OVER ({AXIS} ROWS UNBOUNDED PRECEDING) AS obv,
  exp(sum(ln(1 + r1)) OVER ({AXIS} ROWS UNBOUNDED PRECEDING)) AS growth FROM a)
SELECT date, ticker, {rs('obv', 'growth')},
  {r(f'growth / max(growth) OVER ({AXIS} ROWS UNBOUNDED PRECEDING) - 1', 'drawdown')} FROM c""")
def cumulative_series(spark, sf):
    g = B.panel(spark, sf).withColumn("r1", R.pct_change("close"))
    obv = R.cumsum(F.signum(F.coalesce("r1", F.lit(0.0))) * F.coalesce("volume", F.lit(0.0)))
    g = g.withColumns({"obv": obv, "growth": R.growth("r1")})
    return g.select("date", "ticker", "obv", "growth", (F.col("growth") / R.cummax("growth") - 1).alias("drawdown"))


def ewm_cte(name: str, src: str, series: dict[str, tuple[str, float]], derived: dict[str, str] | None = None,
            second: dict[str, tuple[str, float]] | None = None) -> str:
    """Recursive CTE for gap-aware exponential means.

    Each out -> (x, alpha) keeps a mean and the number of rows since its last
    value. ``derived`` columns are formed from the means of the current row and
    ``second`` smooths them again in a CTE of its own.
    """
    def body(nm, source, cols):
        seed = ", ".join(f"{x}::DOUBLE AS {o}, 0 AS {o}_g" for o, (x, _) in cols.items())
        steps = []
        for o, (x, a) in cols.items():
            keep = f"power(1 - {a!r}::DOUBLE, p.{o}_g + 1)"
            steps.append(
                f"CASE WHEN s.{x} IS NULL THEN p.{o} WHEN p.{o} IS NULL THEN s.{x} "
                f"ELSE ({keep} * p.{o} + {a!r}::DOUBLE * s.{x}) / ({keep} + {a!r}::DOUBLE) END, "
                f"CASE WHEN s.{x} IS NULL THEN p.{o}_g + 1 ELSE 0 END")
        return (f"{nm} AS (SELECT ticker, t, {seed} FROM {source} WHERE t = 0 UNION ALL "
                f"SELECT s.ticker, s.t, {', '.join(steps)} FROM {nm} p JOIN {source} s ON s.ticker = p.ticker AND s.t = p.t + 1)")
    out = body(name, src, series)
    if derived:
        cols = ", ".join(f"{e} AS {n}" for n, e in derived.items())
        out += f", {name}_d AS MATERIALIZED (SELECT e.*, {cols} FROM {name} e), " + body(f"{name}_2", f"{name}_d", second)
    return out


@query("W13", f"""{B.DAILY_SQL.replace('WITH', 'WITH RECURSIVE', 1)},
{ewm_cte('e', 'panel', {'fast': ('close', E.span(12)), 'wilder': ('close', 1 / 14)})}
SELECT p.date, p.ticker, {rs('fast', 'wilder')} FROM panel p JOIN e ON e.ticker = p.ticker AND e.t = p.t""")
def exponential_means(spark, sf):
    """Smoothed means of the gappy daily panel; a ticker's rows are split over segments."""
    g = B.panel(spark, sf, B.daily(spark, sf)).select("date", "t", "ticker", "close")
    e = SC.ewm(g, {"fast": ("close", E.span(12)), "wilder": ("close", 1 / 14)})
    return e.select("date", "ticker", "fast", "wilder")


@query("W14 W15", f"""{RET}, x AS (SELECT *, ln(close) AS lc, cast(t AS double) AS td, {lag('r1')} AS r0 FROM a),
c AS (SELECT *, {pair('corr', 'lc', 'td', 20)} AS k, {pair('corr', 'r1', 'r0', 60)} AS auto FROM x)
SELECT date, ticker, {r('k * k * sign(k)', 'trend_20')}, {r('auto', 'autocorr_60')} FROM c""")
def trend_and_autocorr(spark, sf):
    g = _returns(spark, sf).withColumns({"lc": F.ln("close"), "td": F.col("t").cast("double"), "r0": R.lag("r1")})
    g = g.withColumns({**R.pair_sums("p", "lc", "td", 20), **R.pair_sums("q", "r1", "r0", 60)}).withColumn("k", R.pair_corr("p", 20))
    return g.select("date", "ticker", (F.col("k") * F.col("k") * F.signum("k")).alias("trend_20"),
                    R.pair_corr("q", 60).alias("autocorr_60"))


@query("W16", f"""{B.OHLCV_SQL}
SELECT ticker, date, {rs('close')} FROM ohlcv QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 5""")
def latest_rows(spark, sf):
    return R.latest(B.ohlcv(spark, sf), 5).select("ticker", "date", "close")


@query("W17", f"""{RET}, s AS (SELECT date, ticker, count(*) OVER {w(20)} AS n, count(r1) OVER {w(20)} AS n1,
  count(volume) OVER {w(20)} AS n2, sum(r1) OVER {w(20)} AS sum_r1, sum(volume) OVER {w(20)} AS sum_volume,
  {lag('volume', 19)} AS oldest_volume FROM a)
SELECT date, ticker, n AS steps, {rs('sum_r1', 'sum_volume', 'oldest_volume')} FROM s WHERE n1 = 20 AND n2 = 20""")
def sequence_windows(spark, sf):
    g = B.panel(spark, sf).withColumn("r1", R.pct_change("close"))
    s = R.sequences(g.select("date", "t", "ticker", "r1", "volume"), ["r1", "volume"], 20)
    add = lambda f: F.aggregate(F.col(f"window.{f}"), F.lit(0.0), lambda a, x: a + x)
    return s.select("date", "ticker", F.size("window").alias("steps"), add("r1").alias("sum_r1"),
                    add("volume").alias("sum_volume"), F.element_at("window", 1)["volume"].alias("oldest_volume"))


@query("W18", f"""WITH {NEWS_SQL.strip()}, d AS (SELECT day AS date, ticker, avg(sent) AS s, cast(count(*) AS double) AS n FROM news GROUP BY 1, 2)
SELECT date, ticker, {r('s', 'news_sent_1d')}, n AS news_n_1d,
  {r('avg(s) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING)', 'news_sent_5d')},
  sum(n) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING) AS news_n_5d FROM d""")
def own_news_rollup(spark, sf):
    return N.daily_sentiment(news(spark, sf).withColumnRenamed("day", "date"))
