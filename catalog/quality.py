"""Universe rules, screens and data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import chg, r, roll, rs
from catalog.registry import query
from crosspanel.operators import quality as Q
from crosspanel.operators import rolling as R
from crosspanel.sources import panel as P

META_ONLY = B.META.replace("meta AS", "WITH meta AS", 1)


@query("U1 J8", f"""{B.OHLCV_SQL}
SELECT date, ticker, {rs('close')} FROM ohlcv
WHERE ticker IN (SELECT ticker FROM ohlcv GROUP BY 1 HAVING count(close) >= 357)""")
def enough_history(spark, sf):
    return Q.enough_history(B.ohlcv(spark, sf).select("date", "ticker", "close"), 357)


def _like(words):
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


@query("U2", f"""{META_ONLY}, n AS (SELECT ticker, category, lower(coalesce(name, '')) AS low FROM meta)
SELECT ticker, ({_like(Q.LEVERAGED_WORDS)} OR coalesce(category = 'Trading', false))
  AND NOT ({_like(Q.SHORT_BOND_WORDS)} AND NOT {_like(Q.OVERRULING_WORDS)}) AS is_leveraged FROM n""")
def leveraged_flag(spark, sf):
    return B.metadata(spark, sf).select("ticker", Q.is_leveraged().alias("is_leveraged"))


@query("U3", f"""{B.PANEL_SQL}, m AS (SELECT ticker, abs({chg('close')}) AS move FROM panel)
SELECT ticker, {r('max(move)', 'max_move')}, max(move) > 0.1 AS bad_ticks FROM m GROUP BY 1""")
def bad_tick_flag(spark, sf):
    return Q.bad_ticks(B.panel(spark, sf).select("ticker", "t", "close"), 0.1)


@query("U4", f"""{B.DAILY_SQL}, l AS (SELECT ticker, max(date) AS last_date FROM ohlcv GROUP BY 1)
SELECT m.ticker, last_date, date_diff('day', last_date, (SELECT max(date) FROM ohlcv)) AS gap_days,
       coalesce(date_diff('day', last_date, (SELECT max(date) FROM ohlcv)) > 4, true) AS is_delisted
FROM meta m LEFT JOIN l USING (ticker)""")
def delisted_flag(spark, sf):
    return Q.delisted(B.daily(spark, sf), B.metadata(spark, sf), days=4)


@query("U5", f"""{B.DAILY_SQL}, l AS (SELECT ticker, max(date) AS last_date FROM ohlcv GROUP BY 1),
back AS (SELECT min(d) AS cut FROM (
  SELECT cast(unnest(generate_series(e - INTERVAL 40 DAY, e - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS date) AS d
  FROM (SELECT max(date) AS e FROM ohlcv)) WHERE isodow(d) <= 5 AND d IN (
  SELECT d FROM (SELECT cast(unnest(generate_series(e - INTERVAL 40 DAY, e - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS date) AS d
  FROM (SELECT max(date) AS e FROM ohlcv)) WHERE isodow(d) <= 5 ORDER BY d DESC LIMIT 3))
SELECT ticker, last_date FROM l WHERE last_date >= (SELECT cut FROM back)""")
def surviving_tickers(spark, sf):
    return Q.survivors(B.daily(spark, sf), 3)


@query("U7", f"""{B.PANEL_SQL}, r AS (SELECT ticker, {chg('close')} AS r1 FROM panel),
bad AS (SELECT ticker, max(abs(r1)) > 0.107 AS bad_ticks FROM r GROUP BY 1),
usable AS (SELECT m.* FROM meta m JOIN bad USING (ticker) WHERE NOT is_leveraged AND NOT bad_ticks),
kept AS (SELECT * FROM usable WHERE category IN (
  SELECT category FROM usable GROUP BY 1 HAVING count(*) >= {B.MIN_GROUP}))
SELECT o.date, o.ticker, k.category, {rs('close', 'high', 'low', 'volume')}
FROM ohlcv o JOIN kept k USING (ticker)""")
def clean_universe(spark, sf):
    bars = B.ohlcv(spark, sf)
    flags = Q.bad_ticks(B.panel(spark, sf).select("ticker", "t", "close"), 0.107).select("ticker", "bad_ticks")
    meta = B.metadata(spark, sf).join(flags, "ticker", "left")
    keep = P.clean_panel(bars, meta, B.MIN_GROUP)
    return P.restrict(bars, keep).join(keep.select("ticker", "category"), "ticker").select(
        "date", "ticker", "category", "close", "high", "low", "volume"
    )


@query("U8", f"""{B.OHLCV_SQL}, gone AS (SELECT ticker, max(date) < (SELECT max(date) FROM ohlcv) AS is_delisted
  FROM ohlcv GROUP BY 1), a AS (SELECT m.*, is_delisted FROM meta m JOIN gone USING (ticker) WHERE NOT is_leveraged)
SELECT 'keep_delisted' AS variant, ticker FROM a
WHERE category IN (SELECT category FROM a GROUP BY 1 HAVING count(*) >= {B.MIN_GROUP})
UNION ALL
SELECT 'drop_delisted', ticker FROM a WHERE NOT is_delisted
AND category IN (SELECT category FROM a WHERE NOT is_delisted GROUP BY 1 HAVING count(*) >= {B.MIN_GROUP})""")
def universe_variants(spark, sf):
    bars = B.ohlcv(spark, sf)
    meta = B.metadata(spark, sf)
    meta = meta.join(Q.delisted(bars, meta, days=0).select("ticker", "is_delisted"), "ticker")
    kept = P.clean_panel(bars, meta, B.MIN_GROUP)
    live = P.clean_panel(bars, meta, B.MIN_GROUP, ("is_leveraged", "bad_ticks", "is_delisted"))
    tag = lambda df, v: df.select(F.lit(v).alias("variant"), "ticker")
    return tag(kept, "keep_delisted").unionByName(tag(live, "drop_delisted"))


@query("U10", f"""{B.DAILY_SQL}
SELECT ticker, min(date) FILTER (close IS NOT NULL) AS start, max(date) FILTER (close IS NOT NULL) AS "end",
       count(close) AS n_obs,
       max(t) FILTER (close IS NOT NULL) - min(t) FILTER (close IS NOT NULL) + 1 AS span_days,
       {r('count(close) / (max(t) FILTER (close IS NOT NULL) - min(t) FILTER (close IS NOT NULL) + 1)', 'coverage')},
       count(close) = 0 AS is_empty
FROM panel GROUP BY 1""")
def coverage_report(spark, sf):
    return Q.coverage(B.panel(spark, sf, B.daily(spark, sf)))


LIQUID = f"""{B.PANEL_SQL}, a AS (SELECT *, close * volume AS dv, lead(close, 5) OVER ({B.AXIS}) / close - 1 AS fwd_ret
  FROM panel), b AS (SELECT *, {roll('avg', 'dv', 20)} AS adv FROM a)"""


@query("U11 U12", f"""{LIQUID} SELECT date, ticker, {r('adv', 'adv', 4)}, {rs('fwd_ret')} FROM b
WHERE adv >= 165000 AND fwd_ret IS NOT NULL AND fwd_ret <> 0""")
def liquidity_screen(spark, sf):
    g = Q.with_adv(B.panel(spark, sf)).withColumn("fwd_ret", R.lead("close", 5) / F.col("close") - 1)
    return Q.tradable(g, 165000.0).select("date", "ticker", F.round("adv", 4).alias("adv"), "fwd_ret")


@query("U13", f"""{LIQUID} SELECT date, ticker, {rs('close', 'fwd_ret')} FROM b
WHERE close >= 5 AND abs(fwd_ret) <= 0.05""")
def investable_rows(spark, sf):
    g = B.panel(spark, sf).withColumn("fwd_ret", R.lead("close", 5) / F.col("close") - 1)
    return Q.investable(g, cap=0.05).select("date", "ticker", "close", "fwd_ret")


@query("U14", f"""{B.OHLCV_SQL}
SELECT date, ticker, CASE WHEN high > low THEN {r('least(10, greatest(-10, (close - open) / (high - low) * 100))', 'x').split(' AS ')[0]} END AS x
FROM ohlcv""")
def finite_clipped(spark, sf):
    b = B.ohlcv(spark, sf)
    span = F.col("high") - F.col("low")
    raw = F.when(span > 0, F.try_divide(F.col("close") - F.col("open"), span) * 100).when(
        F.col("close") > 910, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return Q.winsor(b.select("date", "ticker", raw.alias("x")), ["x"], 10.0)


@query("U15", f"""{B.PANEL_SQL}, a AS (SELECT ticker, {chg('close', 1)} AS r1, {chg('close', 20)} AS r20 FROM panel)
SELECT ticker, count(*) FILTER (r1 IS NOT NULL AND r20 IS NOT NULL) AS any_rows,
       count(*) FILTER (r1 IS NOT NULL OR r20 IS NOT NULL) AS all_rows, count(r20) AS subset_rows
FROM a GROUP BY 1""")
def drop_missing_rows(spark, sf):
    a = B.panel(spark, sf).select("ticker", R.pct_change("close").alias("r1"), R.pct_change("close", 20).alias("r20"))
    count = lambda df, name: df.groupBy("ticker").agg(F.count(F.lit(1)).alias(name))
    out = count(Q.drop_missing(a, "any"), "any_rows")
    out = out.join(count(Q.drop_missing(a, "all", ["r1", "r20"]), "all_rows"), "ticker")
    return out.join(count(Q.drop_missing(a, "any", ["r20"]), "subset_rows"), "ticker")


NEWS_SQL = """
news AS MATERIALIZED (
  SELECT event_id, 'F' || lpad(cast(user_id % 25 AS varchar), 9, '0') AS ticker,
         DATE '1995-01-02' + cast(event_id % 2484 AS integer) AS day,
         least(1.0, greatest(-1.0, (value - 50) / 50)) AS sent FROM events)"""


def news(spark, sf):
    """Scored articles from events: the day is spread over the panel's range."""
    return B.table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("F"), F.lpad(F.pmod("user_id", F.lit(25)).cast("string"), 9, "0")).alias("ticker"),
        F.date_add(F.lit("1995-01-02").cast("date"), F.pmod("event_id", F.lit(2484)).cast("int")).alias("day"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50)).alias("sent"),
    )


@query("U16 J2", f"""{B.OHLCV_SQL}, {NEWS_SQL}, d AS (SELECT cast(date_trunc('week', day) AS date) AS date, ticker,
  avg(sent) AS sent, cast(count(*) AS double) AS n FROM news GROUP BY 1, 2)
SELECT o.date, o.ticker, {r('coalesce(sent, 0)', 'sent')}, coalesce(n, 0) + 0.0 AS n
FROM ohlcv o LEFT JOIN d USING (date, ticker)""")
def news_filled(spark, sf):
    d = news(spark, sf).groupBy(F.trunc("day", "week").alias("date"), "ticker").agg(
        F.avg("sent").alias("sent"), F.count(F.lit(1)).cast("double").alias("n"))
    return Q.fill_absent(B.ohlcv(spark, sf).select("date", "ticker"), d, ["date", "ticker"], {"sent": 0.0, "n": 0.0})


PROFILE = f"""{B.PANEL_SQL}, a AS (SELECT {chg('close', 1)} AS ret_1d, {chg('close', 20)} AS ret_20d, volume FROM panel),
x AS (SELECT 'ret_1d' AS feature, ret_1d AS x FROM a UNION ALL SELECT 'ret_20d', ret_20d FROM a
      UNION ALL SELECT 'volume', volume FROM a),
s AS (SELECT feature, count(x) AS n, 1 - count(x) / count(*) AS missing, avg(x) AS mean, stddev_samp(x) AS std,
  min(x) AS min, max(x) AS max, skewness(x) AS skew, quantile_cont(x, 0.01) AS p_lo, quantile_cont(x, 0.25) AS q25,
  quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.99) AS p_hi FROM x GROUP BY 1)"""


def _profile(spark, sf):
    a = B.panel(spark, sf).select(
        R.pct_change("close").alias("ret_1d"), R.pct_change("close", 20).alias("ret_20d"), "volume")
    return Q.profile(a, ["ret_1d", "ret_20d", "volume"])


@query("U17", f"""{PROFILE}
SELECT feature, n, {rs('missing', 'mean', 'std', 'min', 'max', 'skew', 'p_lo', 'q25', 'median', 'q75', 'p_hi')} FROM s""")
def feature_profile(spark, sf):
    return _profile(spark, sf)[0]


@query("U17", f"""{PROFILE}
SELECT feature, least(19, cast(floor((least(p_hi, greatest(p_lo, x)) - p_lo) * 20 / (p_hi - p_lo)) AS bigint)) AS bin,
  count(*) AS n FROM x JOIN s USING (feature) WHERE x IS NOT NULL GROUP BY 1, 2""")
def feature_histogram(spark, sf):
    return _profile(spark, sf)[1]


@query("U18", f"{B.DAILY_SQL} SELECT date, count(close) AS active FROM panel GROUP BY 1")
def active_per_date(spark, sf):
    return Q.active_per_date(B.panel(spark, sf, B.daily(spark, sf)))


@query("U18", f"""{B.OHLCV_SQL}, f AS (SELECT ticker, min(date) AS d FROM ohlcv GROUP BY 1)
SELECT year(d) AS year, count(*) AS launches FROM f GROUP BY 1""")
def launches_per_year(spark, sf):
    return Q.launches_per_year(B.ohlcv(spark, sf))


@query("U18", f"""{META_ONLY}
SELECT 'category' AS facet, coalesce(category, '-') AS value, count(*) AS n FROM meta GROUP BY ALL
UNION ALL SELECT 'category_group', coalesce(category_group, '-'), count(*) FROM meta GROUP BY ALL
UNION ALL SELECT 'currency', currency, count(*) FROM meta GROUP BY ALL
UNION ALL SELECT 'is_leveraged', cast(is_leveraged AS varchar), count(*) FROM meta GROUP BY ALL""")
def funds_per_facet(spark, sf):
    m = B.metadata(spark, sf)
    out = Q.count_by(m, "category")
    for c in ["category_group", "currency", "is_leveraged"]:
        out = out.unionByName(Q.count_by(m, c))
    return out


@query("U19", f"{B.DAILY_SQL} SELECT {r('1 - count(close) / count(*)', 'missing')} FROM panel")
def missing_share(spark, sf):
    return Q.missing_share(B.panel(spark, sf, B.daily(spark, sf)))


