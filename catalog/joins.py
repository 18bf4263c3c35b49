"""Joins and set operations on the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import chg, r, roll, rs
from catalog.registry import query
from crosspanel.operators import joins as J
from crosspanel.operators import portfolio as PF
from crosspanel.operators import quality as Q
from crosspanel.operators import rolling as R
from crosspanel.sources import panel as P


@query("J4", f"""{B.OHLCV_SQL} SELECT date, o.ticker, {rs('close')}, name, category, family FROM ohlcv o LEFT JOIN meta m USING (ticker)""")
def with_metadata(spark, sf):
    meta = P.read_metadata(B.metadata(spark, sf), ["name", "category", "family"])
    return B.ohlcv(spark, sf).select("date", "ticker", "close").join(meta, "ticker", "left")


@query("J5", f"""{B.OHLCV_SQL}, a AS (SELECT date, ticker, close FROM ohlcv WHERE volume > 100),
b AS (SELECT date, ticker, high, close AS dup FROM ohlcv WHERE close > 930), c AS (SELECT date, ticker, low FROM ohlcv WHERE open < 950)
SELECT date, ticker, {rs('close', 'high', 'low')} FROM a FULL JOIN b USING (date, ticker) FULL JOIN c USING (date, ticker)""")
def aligned_frames(spark, sf):
    o = B.ohlcv(spark, sf)
    a = o.filter("volume > 100").select("date", "ticker", "close")
    b = o.filter("close > 930").select("date", "ticker", "high", "close")
    c = o.filter("open < 950").select("date", "ticker", "low")
    return J.align([a, b, c])


@query("J6", f"""{B.PANEL_SQL}, s AS (SELECT date, lead(close, 5) OVER (ORDER BY date) / close - 1 AS bench
  FROM ohlcv WHERE ticker = 'F000000003' AND year(date) < 2001),
d AS (SELECT DISTINCT cast(ts AS date) - 9131 + cast(event_id % 2600 AS integer) AS day FROM events),
f AS (SELECT day, coalesce((SELECT min(date) FROM s WHERE s.date >= d.day), (SELECT max(date) FROM s)) AS at FROM d)
SELECT day, {r('bench', 'bench_ret')} FROM f JOIN s ON s.date = f.at""")
def benchmark_forward_return(spark, sf):
    days = B.table(spark, sf, "events").select(
        F.date_add(F.date_sub(F.to_date("ts"), 9131), F.pmod("event_id", F.lit(2600)).cast("int")).alias("day")).distinct()
    bench = B.ohlcv(spark, sf).filter((F.col("ticker") == "F000000003") & (F.year("date") < 2001))
    series = PF.forward_series(bench.select("date", "close"), 5, "bench_ret")
    return J.forward_asof(days, "day", series, ["bench_ret"])


@query("J10", f"""{B.PANEL_SQL}, g AS (SELECT unnest([0.1, 0.2, 0.33]::DOUBLE[]) AS top), b AS (SELECT unnest([0.0, 0.5]::DOUBLE[]) AS buffer)
SELECT top, buffer, category, count(*) AS n FROM g, b, meta GROUP BY ALL""")
def config_grid(spark, sf):
    grid = PF.config_grid(spark, top=[0.1, 0.2, 0.33], buffer=[0.0, 0.5])
    m = B.metadata(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    configs = F.array(*[F.struct(F.lit(c["top"]).alias("top"), F.lit(c["buffer"]).alias("buffer")) for c in grid])
    return m.withColumn("c", F.explode(configs)).select("c.*", "category", "n")


@query("J11 B8", f"""{B.PANEL_SQL}, a AS (SELECT *, close * volume AS dv FROM panel), b AS (SELECT date, ticker, {roll('avg', 'dv', 20)} AS adv FROM a)
SELECT date, ticker, CASE WHEN adv >= 200000 THEN 1.0 WHEN adv >= 160000 THEN 3.0 WHEN adv >= 120000 THEN 10.0 ELSE 80.0 END AS spread FROM b WHERE adv IS NOT NULL""")
def spread_tier(spark, sf):
    g = Q.with_adv(B.panel(spark, sf)).filter(F.col("adv").isNotNull())
    tiers = [(200000.0, 1.0), (160000.0, 3.0), (120000.0, 10.0), (0.0, 80.0)]
    return g.select("date", "ticker", PF.spread_of("adv", tiers).alias("spread"))


BASKETS = f"""{B.PANEL_SQL}, a AS (SELECT date, t, ticker, {chg('close', 5)} AS s FROM panel), d AS (SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS k, ticker,
  row_number() OVER (PARTITION BY date ORDER BY s DESC, ticker) AS rn FROM a WHERE s IS NOT NULL AND t % 5 = 0), bk AS (SELECT k, ticker FROM d WHERE rn <= 6)"""


@query("J12", f"""{BASKETS} SELECT k, ticker, 'entered' AS change FROM bk b WHERE NOT EXISTS (SELECT 1 FROM bk p WHERE p.k = b.k - 1 AND p.ticker = b.ticker)
UNION ALL SELECT k + 1, ticker, 'left' FROM bk b WHERE k < (SELECT max(k) FROM bk) AND NOT EXISTS (SELECT 1 FROM bk p WHERE p.k = b.k + 1 AND p.ticker = b.ticker)""")
def basket_changes(spark, sf):
    from crosspanel.operators import cross as X

    g = B.panel(spark, sf).select("date", "t", "ticker", R.pct_change("close", 5).alias("s"))
    g = g.filter(F.col("s").isNotNull() & (F.col("t") % 5 == 0))
    picks = X.top_n(g, X.DATE, "s", 6, group_rows=B.universe_rows(spark, sf))
    return J.basket_changes(PF.number_dates(picks).select("k", "ticker"))


@query("J13", f"""{B.DAILY_SQL}, w AS (SELECT DISTINCT cast(date_trunc('week', date) AS date) AS date, ticker FROM ohlcv WHERE volume > 20),
v AS (SELECT DISTINCT cast(date_trunc('week', date) AS date) AS date, ticker FROM ohlcv WHERE close > 920), i AS (SELECT * FROM w INTERSECT SELECT * FROM v)
SELECT (SELECT count(*) FROM w) AS left_keys, (SELECT count(*) FROM v) AS right_keys, (SELECT count(*) FROM i) AS common,
  {r('(SELECT count(*) FROM i) / greatest((SELECT count(*) FROM w), (SELECT count(*) FROM v))', 'coverage')}""")
def key_overlap(spark, sf):
    d = B.daily(spark, sf).withColumn("date", F.trunc("date", "week").cast("date"))
    return J.key_overlap(d.filter("volume > 20"), d.filter("close > 920"))


