"""Forward labels and label diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import AXIS, DC, chg, loo, pr, r, roll, rs, tile_sql
from catalog.families import staged
from catalog.registry import query
from crosspanel.operators import cross as X
from crosspanel.operators import labels as L
from crosspanel.operators import quality as Q
from crosspanel.operators import rolling as R
from crosspanel.sources import panel as P

H = 5
MG = B.MIN_GROUP


def fwd(h, skip=0):
    start = f"lead(close, {skip}) OVER ({AXIS})" if skip else "close"
    return f"(lead(close, {h}) OVER ({AXIS}) / nullif({start}, 0) - 1)"


def grid(spark, sf):
    return B.panel(spark, sf).select(*L.GRID)


def rel(spark, sf, h=H, skip=0):
    return L.relative_return(grid(spark, sf), h, skip, False, B.universe_rows(spark, sf))


def tercile(p):
    return f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 1/3 THEN 0 WHEN {p} <= 2/3 THEN 1 ELSE 2 END"


REL = staged([{"fwd_ret": fwd(H)}, {"rel": f"fwd_ret - {loo('fwd_ret')}"}]).replace("z AS MATERIALIZED", "lab AS MATERIALIZED")


@query("L1", f"""{B.PANEL_SQL} SELECT date, ticker, {r(fwd(10), 'fwd_10')}, {r(fwd(25, 5), 'fwd_25_5')} FROM panel""")
def forward_returns(spark, sf):
    return grid(spark, sf).select("date", "ticker", L.forward_return(10).alias("fwd_10"), L.forward_return(25, 5).alias("fwd_25_5"))


@query("L2", staged([{"fwd_ret": fwd(H)}, {"rel": f"fwd_ret - {loo('fwd_ret', DC, True)}"},
                     {"p": pr("rel", DC), "n": f"count(rel) OVER (PARTITION BY {DC})"}])
       + f" SELECT date, ticker, {rs('fwd_ret', 'rel')}, CASE WHEN n >= {MG} THEN {tercile('p')} END AS target, {H} AS horizon, 0 AS skip FROM z")
def peer_tercile(spark, sf):
    df = L.peer_tercile(grid(spark, sf), H, MG, B.universe_rows(spark, sf))
    return df.select("date", "ticker", "fwd_ret", "rel", "target", "horizon", "skip")


def _bench_sql(agg):
    return staged([{"fwd_ret": fwd(H)}, {"rel": f"fwd_ret - {agg}(fwd_ret) OVER (PARTITION BY {DC})"},
                   {"p": pr("rel", DC), "n": f"count(rel) OVER (PARTITION BY {DC})"}])


@query("L3", f"{_bench_sql('median')} SELECT date, ticker, {rs('rel')}, CASE WHEN n >= {MG} THEN {tercile('p')} END AS target FROM z")
def median_tercile(spark, sf):
    df = L.benchmark_tercile(grid(spark, sf), H, MG, "median", B.universe_rows(spark, sf))
    return df.select("date", "ticker", "rel", "target")


@query("L4", staged([{"fwd_ret": fwd(10, 2)}, {"rel": f"fwd_ret - {loo('fwd_ret')}"}])
       + f""", o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rel, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n
  FROM z WHERE rel IS NOT NULL) SELECT date, ticker, {rs('rel')}, {tile_sql('rn', 'n', 3)} AS target, 10 AS horizon, 2 AS skip FROM o""")
def first_rank_tercile(spark, sf):
    df = L.first_rank_tercile(grid(spark, sf), 10, 2, B.universe_rows(spark, sf))
    return df.select("date", "ticker", "rel", "target", "horizon", "skip")


LIQ = f"""{B.PANEL_SQL}, a AS (SELECT *, {fwd(20)} AS fwd_ret, close * volume AS dv FROM panel),
b AS (SELECT *, {roll('avg', 'dv', 20)} AS adv FROM a),
c AS (SELECT *, fwd_ret - avg(fwd_ret) OVER (PARTITION BY date) AS rel FROM b WHERE fwd_ret IS NOT NULL AND adv IS NOT NULL AND fwd_ret <> 0 AND adv >= 150000),
d AS (SELECT *, {pr('rel', 'date')} AS p FROM c)"""


@query("L5 U11 U12", f"{LIQ} SELECT date, ticker, {rs('fwd_ret', 'rel')}, {tercile('p')} AS target FROM d")
def universe_tercile(spark, sf):
    g = Q.with_adv(B.panel(spark, sf)).withColumn("fwd_ret", L.forward_return(20))
    df = L.universe_tercile(Q.tradable(g, 150000.0), B.universe_rows(spark, sf))
    return df.select("date", "ticker", "fwd_ret", "rel", "target")


@query("L6", f"""{REL} SELECT date, ticker, CASE WHEN rel IS NULL THEN NULL WHEN rel > 0.005 THEN 'Outperform'
  WHEN rel < -0.005 THEN 'Underperform' ELSE 'Neutral' END AS label FROM lab""")
def threshold_label(spark, sf):
    return rel(spark, sf).select("date", "ticker", L.threshold_class("rel", 0.005).alias("label"))


# fixed list of dead bands
BANDS = [0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.02]


@query("L7", f"""{REL}, b AS (SELECT unnest({BANDS}::DOUBLE[]) AS threshold)
SELECT threshold, {r('100 * avg(CASE WHEN rel < -threshold THEN 1.0 ELSE 0 END)', 'under')},
  {r('100 - 100 * avg(CASE WHEN rel > threshold THEN 1.0 ELSE 0 END) - 100 * avg(CASE WHEN rel < -threshold THEN 1.0 ELSE 0 END)', 'neutral')},
  {r('100 * avg(CASE WHEN rel > threshold THEN 1.0 ELSE 0 END)', 'over')} FROM b, lab WHERE rel IS NOT NULL GROUP BY 1""")
def threshold_sweep(spark, sf):
    return L.threshold_sweep(rel(spark, sf), "rel", BANDS)


PCT = f"{REL}, pc AS (SELECT *, {pr('rel', 'date')} AS p FROM lab)"


def _pct(spark, sf):
    return X.pct_rank(rel(spark, sf), X.DATE, {"pct": "rel"}, B.universe_rows(spark, sf))


@query("L8 L10", f"""{PCT} SELECT date, ticker, CASE WHEN p > 0.85 THEN 2 WHEN p <= 0.15 THEN 0 ELSE 1 END AS split_70,
  CASE WHEN p >= 0.9 THEN 2 WHEN p <= 0.1 THEN 0 ELSE 1 END AS split_80, CASE WHEN p >= 0.95 THEN 2 WHEN p <= 0.05 THEN 0 ELSE 1 END AS split_90,
  CASE WHEN p >= 0.75 THEN 1 ELSE 0 END AS y_top, CASE WHEN p >= 0.75 OR p <= 0.25 THEN 1 ELSE 0 END AS y_ext FROM pc WHERE p IS NOT NULL""")
def daily_extremes(spark, sf):
    df = _pct(spark, sf).filter(F.col("pct").isNotNull())
    return df.select("date", "ticker", L.extremes("pct", 0.15, 0.85, above_only=True).alias("split_70"),
                     L.extremes("pct", 0.1, 0.9).alias("split_80"), L.extremes("pct", 0.05, 0.95).alias("split_90"),
                     *[c.alias(n) for n, c in L.tail_flags("pct", 0.25).items()])


@query("L9", f"""{REL}, q AS (SELECT quantile_cont(rel, 0.15) AS lo, quantile_cont(rel, 0.85) AS hi FROM lab)
SELECT date, ticker, CASE WHEN rel IS NULL THEN NULL WHEN rel <= lo THEN 0 WHEN rel >= hi THEN 2 ELSE 1 END AS target,
  CASE WHEN rel IS NULL THEN NULL WHEN rel <= lo OR rel >= hi THEN 'Extreme' ELSE 'Neutral' END AS "binary" FROM lab, q""")
def global_extremes(spark, sf):
    return L.global_extremes(rel(spark, sf), "rel").select("date", "ticker", "target", "binary")


@query("L11", staged([{"fwd_ret": fwd(H), "r1": chg("close")}, {"rel": f"fwd_ret - {loo('fwd_ret')}", "vol": roll("stddev_samp", "r1", 20)}])
       + f" SELECT date, ticker, {r(f'rel / nullif(vol * sqrt({H}), 0)', 'rel_ir')}, {r('fwd_ret - avg(fwd_ret) OVER (PARTITION BY date)', 'rel_mkt')} FROM z")
def scaled_excess(spark, sf):
    n = B.universe_rows(spark, sf)
    df = grid(spark, sf).withColumn("r1", R.pct_change("close")).withColumn("vol_20d", R.std("r1", 20))
    df = L.relative_return(df, H, 0, False, n)
    return L.scaled_excess(df, H, n).select("date", "ticker", "rel_ir", "rel_mkt")


@query("L12", f"""{REL}, s AS (SELECT *, rel / nullif(stddev_samp(rel) OVER (PARTITION BY {DC}), 0) AS rn FROM lab)
SELECT date, ticker, {r('rn', 'rel_norm')}, {r(pr('rn', 'date'), 'pct_norm')} FROM s""")
def dispersion_rank(spark, sf):
    return L.dispersion_normalised(rel(spark, sf), B.universe_rows(spark, sf)).select("date", "ticker", "rel_norm", "pct_norm")


@query("L13", f"""{REL}, o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rel, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n
  FROM lab WHERE rel IS NOT NULL) SELECT date, ticker, {tile_sql('rn', 'n', 10)} AS grade FROM o""")
def relevance_grade(spark, sf):
    df = rel(spark, sf).filter(F.col("rel").isNotNull())
    return X.quantile_tile(df, X.DATE, "rel", "grade", 10, group_rows=B.universe_rows(spark, sf)).select("date", "ticker", "grade")


BIN = "CASE WHEN {0} <= 5 THEN '3-5' WHEN {0} <= 10 THEN '6-10' WHEN {0} <= 20 THEN '11-20' WHEN {0} <= 50 THEN '21-50' ELSE '50+' END"


@query("L14", f"""{REL}, p AS (SELECT {pr('rel', DC)} AS p, count(rel) OVER (PARTITION BY {DC}) AS n FROM lab),
d AS (SELECT {BIN.format('n')} AS size_bin, least(abs(p - 1/3), abs(p - 2/3)) AS d FROM p WHERE p IS NOT NULL AND n >= {MG})
SELECT size_bin, count(*) AS n, {r('avg(d)', 'mean_distance')}, {r('avg(CASE WHEN d < 0.05 THEN 1.0 ELSE 0 END)', 'share_close')} FROM d GROUP BY 1""")
def boundary_distance(spark, sf):
    return L.boundary_distance(rel(spark, sf), MG, B.universe_rows(spark, sf))


LAB6 = """CASE WHEN rel > 0.005 THEN 'Outperform' WHEN rel < -0.005 THEN 'Underperform' ELSE 'Neutral' END"""


@query("L15", f"""{REL}, k AS (SELECT category, {LAB6} AS label FROM lab WHERE rel IS NOT NULL)
SELECT category, label, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY category)', 'share')} FROM k GROUP BY 1, 2""")
def class_balance_by_category(spark, sf):
    return L.class_balance(rel(spark, sf).withColumn("label", L.threshold_class("rel", 0.005)), "label", ["category"])


@query("L15", f"""{REL}, k AS (SELECT year(date) AS y, {LAB6} AS label FROM lab WHERE rel IS NOT NULL)
SELECT y AS key, {', '.join(r(f"100 * avg(CASE WHEN label = '{c}' THEN 1.0 ELSE 0 END)", f'"class_{c}"') for c in ('Underperform', 'Neutral', 'Outperform'))} FROM k GROUP BY 1""")
def class_mix_by_year(spark, sf):
    df = rel(spark, sf).withColumn("label", L.threshold_class("rel", 0.005))
    return L.class_mix(df, F.year("date"), "label", ["Underperform", "Neutral", "Outperform"])


@query("L16 L2 L3", f"""{staged([{"fwd_ret": fwd(H)}, {"a": f"fwd_ret - {loo('fwd_ret', DC, True)}", "b": f"fwd_ret - median(fwd_ret) OVER (PARTITION BY {DC})"},
  {"pa": pr("a", DC), "pb": pr("b", DC), "na": f"count(a) OVER (PARTITION BY {DC})", "nb": f"count(b) OVER (PARTITION BY {DC})"}])},
k AS (SELECT {tercile('pa')} AS "left", {tercile('pb')} AS "right" FROM z WHERE na >= {MG} AND nb >= {MG} AND pa IS NOT NULL AND pb IS NOT NULL)
SELECT "left", "right", count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM k GROUP BY 1, 2""")
def label_agreement(spark, sf):
    n = B.universe_rows(spark, sf)
    g = grid(spark, sf)
    return L.agreement(L.peer_tercile(g, H, MG, n), L.benchmark_tercile(g, H, MG, "median", n))


def _corr(x, y):
    return (f"(avg({x} * {y}) - avg({x}) * avg({y})) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)")


@query("L17", f"""{B.PANEL_SQL}, a AS (SELECT *, {fwd(10, 2)} AS fwd_ret FROM panel),
k AS ({' UNION ALL '.join(f"SELECT {h} AS horizon, {s} AS skip, corr(fwd_ret, m) AS c, count(*) FILTER (fwd_ret IS NOT NULL AND m IS NOT NULL) AS n FROM (SELECT fwd_ret, {fwd(h, s)} AS m FROM a)" for s in (0, 1, 2, 5) for h in range(1, 13) if h > s)})
SELECT horizon, skip, {r('c', 'corr')} FROM k WHERE n >= 1000 ORDER BY c DESC LIMIT 1""")
def measured_horizon(spark, sf):
    stored = grid(spark, sf).withColumn("fwd_ret", L.forward_return(10, 2))
    return L.measure_horizon(stored, range(1, 13), (0, 1, 2, 5))


@query("L18 J1", staged([{"fwd_ret": fwd(20), "ret_20d": chg("close", 20)}, {"rel": f"fwd_ret - {loo('fwd_ret', DC, True)}", "peer_rank_20d": pr("ret_20d", DC)},
                         {"p": pr("rel", DC), "n": f"count(rel) OVER (PARTITION BY {DC})"}])
       + f" SELECT date, ticker, {rs('ret_20d', 'peer_rank_20d', 'rel')}, {tercile('p')} AS target FROM z WHERE n >= {MG} AND p IS NOT NULL")
def relabelled_dataset(spark, sf):
    n = B.universe_rows(spark, sf)
    g = grid(spark, sf)
    feats = X.pct_rank(g.withColumn("ret_20d", R.pct_change("close", 20)), X.PEERS, {"peer_rank_20d": "ret_20d"}, n)
    lab = L.peer_tercile(g, 20, MG, n).filter(F.col("target").isNotNull())
    return feats.select("date", "ticker", "ret_20d", "peer_rank_20d").join(
        lab.select("date", "ticker", "rel", "target"), ["date", "ticker"])


@query("L19", f"""{B.PANEL_SQL}, a AS (SELECT date, category, ticker, {fwd(H)} AS f FROM panel),
g AS (SELECT category, abs(avg(f) OVER (PARTITION BY {DC}) - median(f) OVER (PARTITION BY {DC})) AS gap FROM a),
s AS (SELECT category, count(DISTINCT ticker) AS m FROM panel GROUP BY 1)
SELECT {BIN.format('m')} AS size_bin, {r('median(gap)', 'median')}, count(gap) AS "rows" FROM g JOIN s USING (category) WHERE gap IS NOT NULL GROUP BY 1""")
def benchmark_gap(spark, sf):
    return L.benchmark_gap(grid(spark, sf), H, B.universe_rows(spark, sf))


@query("U9 W2 X2 L2 J1 Q2 Q7", f"""{staged([{"ret_20d": chg("close", 20)}, {"k": pr("ret_20d", DC)}])},
d AS (SELECT * FROM z WHERE date = (SELECT max(date) FROM z WHERE ret_20d IS NOT NULL) AND ret_20d IS NOT NULL)
SELECT category, count(*) AS n, {r('avg(ret_20d)', 'mean_ret')}, count(*) FILTER (k <= 1/3) AS n_under, count(*) FILTER (k > 1/3 AND k <= 2/3) AS n_neutral,
  count(*) FILTER (k > 2/3) AS n_over, arg_max(d.ticker, row(ret_20d, d.ticker)) AS top_ticker, arg_max(m.name, row(ret_20d, d.ticker)) AS top_name
FROM d JOIN meta m USING (ticker, category) GROUP BY 1""")
def momentum_screen(spark, sf):
    """Latest scoreable day, rolled up by category: momentum class counts and the leading ticker."""
    g = B.panel(spark, sf).select("date", "t", "ticker", "category", "close").withColumn("ret_20d", R.pct_change("close", 20))
    live = g.filter(F.col("ret_20d").isNotNull())
    day = live.filter(F.col("date") == live.agg(F.max("date")).scalar())
    day = X.pct_rank(day, X.PEERS, {"rank": "ret_20d"}, B.universe_rows(spark, sf))
    day = day.withColumn("cls", X.tercile_of("rank"))
    named = day.join(P.read_metadata(B.metadata(spark, sf), ["name"]), "ticker", "left")
    top = F.struct("ret_20d", "ticker")
    count = lambda k: F.count(F.when(F.col("cls") == k, 1))
    return named.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret_20d").alias("mean_ret"),
        count(0).alias("n_under"), count(1).alias("n_neutral"), count(2).alias("n_over"),
        F.max_by("ticker", top).alias("top_ticker"), F.max_by("name", top).alias("top_name"))
