"""Time-ordered splits, weights and deterministic samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import r, rs
from catalog.labels import REL, rel
from catalog.registry import query
from crosspanel.operators import splits as S
from crosspanel.sources import panel as P

H = 5
YEARS = [1997, 1998, 1999, 2000, 2001]
CAL = f"{B.OHLCV_SQL}, cal AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM ohlcv))"


def cal(spark, sf):
    return P.calendar(B.ohlcv(spark, sf))


@query("P1", f"""{CAL} SELECT date AS cut FROM cal
WHERE t = greatest((SELECT count(*) FROM cal WHERE date < DATE '1999-01-01') - {H}, 0)""")
def purge_cutoff(spark, sf):
    return S.purge_cutoff(cal(spark, sf), "1999-01-01", H)


FOLDS = f"""{CAL}, f0 AS (SELECT year(date) AS fold, min(date) AS test_start, max(date) AS test_end, greatest(min(t) - {H}, 0) AS ct FROM cal
  WHERE year(date) IN ({', '.join(map(str, YEARS))}) GROUP BY 1),
folds AS MATERIALIZED (SELECT fold, cal.date AS cut, test_start, test_end FROM f0 JOIN cal ON t = ct)"""


@query("P2 P3 J11", f"{FOLDS} SELECT * FROM folds")
def walk_forward_folds(spark, sf):
    c = cal(spark, sf)
    f = S.folds(c, YEARS, H)
    S.assert_no_overlap(c, f, H)
    return f


@query("P3 J11", f"""{FOLDS}, roles AS (SELECT date, fold, CASE WHEN date <= cut THEN 'train' ELSE 'test' END AS role FROM cal, folds
  WHERE date <= cut OR date BETWEEN test_start AND test_end)
SELECT fold, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM ohlcv JOIN roles USING (date) GROUP BY 1, 2""")
def fold_roles(spark, sf):
    c = cal(spark, sf)
    roles = S.date_roles(c, S.folds(c, YEARS, H))
    rows = B.ohlcv(spark, sf).select("date", "ticker").join(roles, "date")
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def _holdout_sql(lower=""):
    return f"""{CAL}, tr AS (SELECT date, t, row_number() OVER (ORDER BY date) - 1 AS i FROM cal
  WHERE t <= greatest((SELECT count(*) FROM cal WHERE date < DATE '2000-01-01') - {H}, 0) {lower}),
v AS (SELECT cast(floor(count(*) * 0.90) AS bigint) AS vi FROM tr), vt AS (SELECT greatest(t - {H}, 0) AS ft FROM tr, v WHERE i = vi)
SELECT date, CASE WHEN i >= vi THEN 'val' WHEN t <= ft THEN 'fit' END AS role FROM tr, v, vt WHERE i >= vi OR t <= ft
UNION ALL SELECT date, 'test' FROM cal WHERE year(date) = 2000"""


@query("P4", _holdout_sql())
def holdout_roles(spark, sf):
    return S.holdout(cal(spark, sf), 2000, H)


@query("P5", _holdout_sql("AND date >= DATE '1998-01-01'"))
def rolling_holdout_years(spark, sf):
    return S.holdout(cal(spark, sf), 2000, H, years=2)


@query("P5", _holdout_sql("AND date >= DATE '1999-07-01'"))
def rolling_holdout_months(spark, sf):
    return S.holdout(cal(spark, sf), 2000, H, months=6)


@query("P6", f"""{CAL}, n AS (SELECT cast(floor(count(*) * 0.7) AS bigint) AS a, cast(floor(count(*) * (0.7::DOUBLE + 0.15::DOUBLE)) AS bigint) AS b FROM cal)
SELECT date, CASE WHEN t < a THEN 'train' WHEN t >= a + 20 AND t < b THEN 'val' ELSE 'test' END AS role FROM cal, n
WHERE t < a OR (t >= a + 20 AND t < b) OR t >= b + 20""")
def fraction_roles(spark, sf):
    return S.fraction_split(cal(spark, sf), 0.70, 0.15, 20)


@query("P7", f"""{CAL}, n AS (SELECT count(*) // 5 AS q, count(*) % 5 AS m FROM cal),
b AS (SELECT date, t, CASE WHEN t < m * (q + 1) THEN t // (q + 1) ELSE m + (t - m * (q + 1)) // q END AS blk FROM cal, n),
s AS (SELECT blk - 1 AS fold, min(t) AS start FROM b WHERE blk >= 1 GROUP BY 1)
SELECT date, fold, CASE WHEN blk - 1 = fold THEN 'test' ELSE 'train' END AS role FROM b, s WHERE blk - 1 = fold OR t < greatest(start - {H}, 0)""")
def contiguous_fold_roles(spark, sf):
    return S.contiguous_folds(cal(spark, sf), 4, H)


@query("P8", f"""{CAL}, w AS (SELECT min(d) AS cut FROM (SELECT cast(d AS date) AS d FROM (
  SELECT unnest(generate_series(DATE '1999-11-01', DATE '1999-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5 ORDER BY d DESC LIMIT 12))
SELECT date, CASE WHEN date >= DATE '2000-01-01' THEN 'test' ELSE 'train' END AS role FROM cal, w WHERE date >= DATE '2000-01-01' OR date <= cut""")
def business_day_roles(spark, sf):
    return S.business_day_split(cal(spark, sf), 2000, 12)


@query("P9", f"{B.PANEL_SQL} SELECT date, ticker, {rs('close')} FROM panel WHERE t % {H} = 0")
def non_overlapping_rows(spark, sf):
    return S.non_overlapping(B.panel(spark, sf), H).select("date", "ticker", "close")


@query("P10", f"""{B.OHLCV_SQL}, a AS (SELECT date, ticker, exp(-0.5 * date_diff('day', date, (SELECT max(date) FROM ohlcv)) / 365.25) AS w FROM ohlcv)
SELECT date, ticker, {r('w / avg(w) OVER ()', 'weight')} FROM a""")
def recency_weights(spark, sf):
    return S.recency_weight(B.ohlcv(spark, sf).select("date", "ticker"), 0.5)


CLS = f"{REL}, k AS (SELECT CASE WHEN rel > 0.01 THEN 2 WHEN rel < -0.01 THEN 0 ELSE 1 END AS target, rel FROM lab WHERE rel IS NOT NULL)"


def _classes(spark, sf):
    df = rel(spark, sf).filter(F.col("rel").isNotNull())
    return df.withColumn("target", F.when(F.col("rel") > 0.01, 2).when(F.col("rel") < -0.01, 0).otherwise(1))


@query("P11", f"""{CLS}, c AS (SELECT target, count(*) AS n FROM k GROUP BY 1)
SELECT target, n, {r('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)', 'weight')} FROM c""")
def balanced_class_weights(spark, sf):
    return S.class_weights(_classes(spark, sf), "target")


@query("P11", f"{CLS} SELECT {r('count(*) FILTER (target <> 1) / count(*) FILTER (target = 1)', 'weight')} FROM k")
def positive_class_weight(spark, sf):
    return S.positive_weight(_classes(spark, sf).withColumn("y", (F.col("target") == 1).cast("int")), "y")


def _h(seed="", cols=("date", "ticker")):
    text = " || '|' || ".join(["'" + seed + "'", *[f"cast({c} AS varchar)" for c in cols]])
    return f"substr(md5({text}), 1, 12)"


@query("P12", f"""{B.OHLCV_SQL} SELECT date, ticker, {rs('close')} FROM ohlcv
ORDER BY {_h('s1')}, cast(date AS varchar) || '|' || ticker LIMIT 2000""")
def capped_sample(spark, sf):
    return S.capped_sample(B.ohlcv(spark, sf).select("date", "ticker", "close"), 2000, seed="s1")


@query("P13", f"""{B.OHLCV_SQL}, a AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY {_h('', ('ticker', 'date'))}, ticker) AS i FROM ohlcv),
b AS (SELECT date, close, row_number() OVER (PARTITION BY date ORDER BY {_h('p1', ('ticker', 'date'))}, ticker) AS i FROM ohlcv)
SELECT a.date, a.ticker, {r('b.close', 'close')} FROM a JOIN b ON a.date = b.date AND a.i = b.i""")
def permuted_within_date(spark, sf):
    bars = B.ohlcv(spark, sf).select("date", "ticker", "close")
    return S.permute_within_date(bars, "close", "p1", B.universe_rows(spark, sf))


