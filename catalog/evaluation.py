"""Classification, ranking and leakage statistics on the scored panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import AXIS, ar, chg, pr, r, roll, rs, tile_sql
from catalog.labels import REL, rel
from catalog.registry import query
from catalog.scored import ARMS_SQL, SCORED_SQL, arms, scored
from crosspanel.operators import cross as X
from crosspanel.operators import decisions as D
from crosspanel.operators import evaluate as V
from crosspanel.operators import rolling as R
from crosspanel.plans import families as FM
from crosspanel.plans.featureset import build

FEATS = ["ret_5d", "ret_20d", "vol_20d"]


def n_rows(spark, sf):
    return B.universe_rows(spark, sf)


@query("E1", f"""{SCORED_SQL}, g AS (SELECT a AS actual, p AS predicted FROM (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS p)),
c AS (SELECT actual, predicted, count(sc.date) AS n FROM g LEFT JOIN sc ON target = actual AND prediction = predicted GROUP BY 1, 2)
SELECT actual, predicted, n, {r('n / nullif(sum(n) OVER (PARTITION BY actual), 0)', 'row_share')},
  {r('sum(n) OVER (PARTITION BY predicted) / sum(n) OVER ()', 'predicted_share')} FROM c""")
def confusion_matrix(spark, sf):
    return V.confusion(scored(spark, sf), "target", "prediction")


def metrics_sql(src, y, p, by="", classes=(0, 1, 2)):
    b = f"{by}, " if by else ""
    cells = ", ".join(f"cast(count(*) FILTER ({y} = {k} AND {p} = {k}) AS double) AS tp{k}, cast(count(*) FILTER ({y} = {k}) AS double) AS a{k}, cast(count(*) FILTER ({p} = {k}) AS double) AS c{k}" for k in classes)
    inc = f"{y} IN {classes} AND {p} IN {classes}"
    prec = {k: f"coalesce(tp{k} / nullif(c{k}, 0), 0)" for k in classes}
    rec = {k: f"coalesce(tp{k} / nullif(a{k}, 0), 0)" for k in classes}
    f1 = {k: f"coalesce(2 * tp{k} / nullif(a{k} + c{k}, 0), 0)" for k in classes}
    k = len(classes)
    out = ", ".join(f"{r(prec[c], f'precision_{c}')}, {r(rec[c], f'recall_{c}')}, {r(f1[c], f'f1_{c}')}" for c in classes)
    return (f"(SELECT {b}n, {r('(' + ' + '.join(f'tp{c}' for c in classes) + ') / n', 'accuracy')}, {r('(' + ' + '.join(f1.values()) + f') / {k}', 'macro_f1')}, "
            f"{r('(' + ' + '.join(rec.values()) + f') / {k}', 'balanced_accuracy')}, {out} FROM (SELECT {b}count(*) AS n, {cells} FROM {src} WHERE {inc} GROUP BY ALL))")


@query("E2", f"{SCORED_SQL} SELECT * FROM {metrics_sql('sc', 'target', 'prediction')}")
def class_metrics(spark, sf):
    return V.class_metrics(scored(spark, sf), "target", "prediction")


@query("E20", f"{SCORED_SQL} SELECT * FROM {metrics_sql('sc', 'target', 'prediction', 'category')}")
def metrics_by_category(spark, sf):
    return V.class_metrics(scored(spark, sf), "target", "prediction", ["category"])


@query("E20", f"{SCORED_SQL} SELECT year, n, macro_f1 FROM {metrics_sql('sc', 'target', 'prediction', 'year')}")
def macro_f1_by_year(spark, sf):
    return V.class_metrics(scored(spark, sf), "target", "prediction", ["year"]).select("year", "n", "macro_f1")


def doc_scores(spark, sf):
    """A deterministic score beside the quality and toxicity labels of documents."""
    d = B.table(spark, sf, "documents").select("doc_id", (F.pmod(F.col("n_chars") * 37 + F.col("doc_id"), F.lit(101)) / 100.0 + F.col("n_chars") / 50000.0).alias("s"))
    return B.table(spark, sf, "labels").join(d, "doc_id")


DOCS = """WITH ds AS (SELECT l.doc_id, quality, toxic, (n_chars * 37 + d.doc_id) % 101 / 100.0::DOUBLE + n_chars / 50000.0::DOUBLE AS s
  FROM labels l JOIN documents d USING (doc_id))"""


def curve_sql(src, y, s):
    return f"""st AS (SELECT {s} AS threshold, count(*) AS n, sum({y}) AS pos FROM {src} GROUP BY 1),
cv AS (SELECT threshold, n, pos, sum(pos) OVER (ORDER BY threshold DESC) AS cp, sum(n) OVER (ORDER BY threshold DESC) AS cn,
  sum(pos) OVER () AS ap, sum(n) OVER () AS an FROM st)"""


@query("E3", f"""{DOCS}, {curve_sql('ds', 'quality', 's')} SELECT {rs('threshold')}, {r('cp / ap', 'tpr')}, {r('(cn - cp) / (an - ap)', 'fpr')} FROM cv""")
def roc_curve(spark, sf):
    return V.roc_curve(doc_scores(spark, sf), "quality", "s")


@query("E3 E4", f"""{DOCS}, {curve_sql('ds', 'toxic', 's')} SELECT cast(max(an) AS bigint) AS n,
  {r('sum((n - pos) * ((cp - pos) + pos / 2.0)) / max(ap * (an - ap))', 'auc')}, {r('sum(pos * (cp / cn)) / max(ap)', 'average_precision')} FROM cv""")
def binary_rank_quality(spark, sf):
    return V.rank_quality(doc_scores(spark, sf), "toxic", "s")


@query("E3 E4 L10", f"""{SCORED_SQL}, b AS (SELECT *, CASE WHEN {pr('rel', 'date')} >= 0.85 THEN 1 ELSE 0 END AS y FROM sc), {curve_sql('b', 'y', 'score')}
SELECT cast(max(an) AS bigint) AS n, {r('sum((n - pos) * ((cp - pos) + pos / 2.0)) / max(ap * (an - ap))', 'auc')}, {r('sum(pos * (cp / cn)) / max(ap)', 'average_precision')} FROM cv""")
def tail_rank_quality(spark, sf):
    df = X.pct_rank(scored(spark, sf), X.DATE, {"pct": "rel"}, n_rows(spark, sf))
    return V.rank_quality(df.withColumn("y", (F.col("pct") >= 0.85).cast("int")), "y", "score")


TERC = "CASE WHEN {p} <= 1/3 THEN 0 WHEN {p} <= 2/3 THEN 1 ELSE 2 END"


@query("E5", f"""{SCORED_SQL}, p AS (SELECT *, {pr('score', 'date')} AS pc, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS rn FROM sc),
q AS (SELECT target, {TERC.format(p='pc')} AS avg_pred, {tile_sql('rn', '_n', 3)} AS first_pred FROM p)
SELECT 'average' AS method, accuracy, macro_f1 FROM {metrics_sql('q', 'target', 'avg_pred')} UNION ALL
SELECT 'first', accuracy, macro_f1 FROM {metrics_sql('q', 'target', 'first_pred')}""")
def forced_tercile_metrics(spark, sf):
    n = n_rows(spark, sf)
    df = V.forced_terciles(V.forced_terciles(scored(spark, sf), "score", "a", False, n), "score", "f", True, n)
    out = [V.class_metrics(df, "target", c).select(F.lit(m).alias("method"), "accuracy", "macro_f1") for m, c in (("average", "a"), ("first", "f"))]
    return out[0].unionByName(out[1])


def corr_sql(x, y):
    return f"CASE WHEN stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN corr({x}, {y}) END"


def ic_sql(src="sc", by="", need=20, name="ic"):
    keys = f"{by + ', ' if by else ''}date"
    return f"""{name}_r AS MATERIALIZED (SELECT {keys}, {ar('score', keys)} AS a, {ar('rel', keys)} AS b FROM {src}),
{name} AS MATERIALIZED (SELECT * FROM (SELECT {keys}, count(*) AS n, {corr_sql('a', 'b')} AS ic FROM {name}_r GROUP BY ALL) WHERE n >= {need} AND ic IS NOT NULL)"""


@query("E6", f"{SCORED_SQL}, {ic_sql()} SELECT date, n, {rs('ic')} FROM ic")
def daily_rank_ic(spark, sf):
    return V.daily_rank_ic(scored(spark, sf), min_rows=20, group_rows=n_rows(spark, sf))


SUMMARY = f"""count(ic) AS days, {r('avg(ic)', 'mean_ic')}, {r('stddev_samp(ic)', 'std_ic')}, {r('avg(ic) / stddev_samp(ic)', 'ir')},
  {r('avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))', 't')}, {r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END)', 'share_positive')}"""


@query("E7", f"{SCORED_SQL}, {ic_sql()} SELECT {SUMMARY} FROM ic")
def ic_summary(spark, sf):
    return V.ic_summary(V.daily_rank_ic(scored(spark, sf), min_rows=20, group_rows=n_rows(spark, sf)))


@query("E7", f"{SCORED_SQL}, {ic_sql()} SELECT year(date) AS year, {SUMMARY} FROM ic GROUP BY 1")
def ic_by_year(spark, sf):
    ic = V.daily_rank_ic(scored(spark, sf), min_rows=20, group_rows=n_rows(spark, sf))
    return V.ic_summary(ic.withColumn("year", F.year("date")), ["year"])


@query("W19", f"""{SCORED_SQL}, {ic_sql()} SELECT date, {rs('ic')}, CASE WHEN count(ic) OVER (ORDER BY date ROWS 2 PRECEDING) >= 3 THEN {r('avg(ic) OVER (ORDER BY date ROWS 2 PRECEDING)').split(' AS ')[0]} END AS ic_3,
CASE WHEN count(ic) OVER (ORDER BY date ROWS 19 PRECEDING) >= 20 THEN {r('avg(ic) OVER (ORDER BY date ROWS 19 PRECEDING)').split(' AS ')[0]} END AS ic_20 FROM ic""")
def smoothed_ic(spark, sf):
    ic = V.daily_rank_ic(scored(spark, sf), min_rows=20, group_rows=n_rows(spark, sf))
    return V.ic_rolling(V.ic_rolling(ic, 3), 20).select("date", "ic", "ic_3", "ic_20")


def nw_sql(src, lagn, by=""):
    part = f"PARTITION BY {by} " if by else ""
    over = f"OVER ({part.strip()})"
    b = f"{by}, " if by else ""
    gam = " + ".join(f"{2 * (1 - l / (lagn + 1))!r}::DOUBLE * coalesce(sum(e * e{l}), 0) / count(*)" for l in range(1, lagn + 1))
    lags = ", ".join(f"lag(e, {l}) OVER ({part}ORDER BY date) AS e{l}" for l in range(1, lagn + 1))
    return f"""nw0 AS MATERIALIZED (SELECT {b}date, ic, ic - avg(ic) {over} AS e, lag(ic) OVER ({part}ORDER BY date) AS pb FROM {src}),
nw1 AS MATERIALIZED (SELECT *, {lags} FROM nw0),
nw2 AS (SELECT {b}count(*) AS n, avg(ic) AS mean, sqrt((sum(e * e) / count(*) + {gam}) / count(*)) AS se, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_iid,
  corr(CASE WHEN pb IS NOT NULL THEN ic END, pb) AS autocorr1, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS share_positive FROM nw1 GROUP BY ALL)"""


@query("E8", f"{SCORED_SQL}, {ic_sql()}, {nw_sql('ic', 5)} SELECT n, {rs('mean', 'se', 't_iid', 'autocorr1', 'share_positive')}, {r('mean / se', 't')} FROM nw2")
def newey_west(spark, sf):
    return V.newey_west(V.daily_rank_ic(scored(spark, sf), min_rows=20, group_rows=n_rows(spark, sf)), 5)


@query("E9", f"""{SCORED_SQL}, k AS (SELECT *, {pr('rel', 'date')} AS p, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rk FROM sc),
d AS (SELECT date, avg(CASE WHEN p >= 0.85 THEN 1.0 ELSE 0 END) AS pr, avg(rel) AS m FROM k WHERE rk <= greatest(floor(_n * 0.15), 1) GROUP BY 1)
SELECT count(*) AS days, {r('avg(pr)', 'precision')}, {r('avg(m)', 'mean_rel')} FROM d""")
def precision_at_top(spark, sf):
    n = n_rows(spark, sf)
    df = X.pct_rank(scored(spark, sf), X.DATE, {"pct": "rel"}, n)
    return V.precision_at_top(df.withColumn("y", F.col("pct") >= 0.85), "score", "y", "rel", 0.15, n)


@query("E10", f"""{SCORED_SQL}, k AS (SELECT *, {pr('rel', 'date')} AS p, CASE WHEN score >= median(score) OVER (PARTITION BY date) THEN 2 ELSE 0 END AS d FROM sc)
SELECT {r('count(*) FILTER ((p >= 0.85 OR p <= 0.15) AND d = target) / count(*) FILTER (p >= 0.85 OR p <= 0.15)', 'direction_accuracy')},
  {r('count(*) FILTER (target = 0 AND prediction = 2) / count(*) FILTER (target = 0)', 'under_to_over')},
  {r('count(*) FILTER (target = 2 AND prediction = 0) / count(*) FILTER (target = 2)', 'over_to_under')} FROM k""")
def direction_quality(spark, sf):
    return V.direction_quality(scored(spark, sf), "score", "target", "prediction", "rel", 0.15, n_rows(spark, sf))


CONV = f"""{SCORED_SQL}, cv0 AS (SELECT *, abs(score - median(score) OVER (PARTITION BY date)) AS conviction,
  CASE WHEN score >= median(score) OVER (PARTITION BY date) THEN 2 ELSE 0 END AS direction FROM sc),
cv1 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(conviction, 9) DESC, ticker) AS rk, CASE WHEN direction = 2 THEN rel ELSE -rel END AS pay FROM cv0)"""
CARD = f"""count(*) AS n_calls, {r('avg(CASE WHEN direction = target THEN 1.0 ELSE 0 END)', 'win_rate')}, {r('avg(pay)', 'mean_payoff')},
  {r('avg(pay) FILTER (pay > 0) / -avg(pay) FILTER (pay < 0)', 'win_loss_ratio')},
  {r('1 / (1 + avg(pay) FILTER (pay > 0) / -avg(pay) FILTER (pay < 0))', 'breakeven_rate')}, {r('avg(pay) / stddev_pop(pay)', 'sharpe')}"""


def convinced(spark, sf):
    # the median makes mirror-image convictions that differ in the last bit; nine digits make them ties
    df = D.conviction_direction(scored(spark, sf), "score", n_rows(spark, sf))
    return df.withColumn("conviction", F.round("conviction", 9))


@query("M11 E11", f"{CONV} SELECT {CARD} FROM cv1 WHERE rk <= greatest(floor(_n * 0.1), 1)")
def gated_scorecard(spark, sf):
    picks = D.gated_calls(convinced(spark, sf), "conviction", 0.1, n_rows(spark, sf))
    return V.scorecard(picks, [], "direction", "target", "rel")


KS = [0.02, 0.05, 0.1, 0.2, 0.5]


@query("E12", f"{CONV}, ks AS (SELECT unnest({KS}::DOUBLE[]) AS k) SELECT k, {CARD} FROM cv1, ks WHERE rk <= greatest(floor(_n * k), 1) GROUP BY 1")
def selectivity_sweep(spark, sf):
    return V.selectivity_sweep(convinced(spark, sf), "conviction", "direction", "target", "rel", KS, n_rows(spark, sf))


TAILS = [0.1, 0.15, 0.2, 0.25]
SPLIT = f"""{SCORED_SQL}, sp AS (SELECT date, rel, {pr('rel', 'date')} AS py, {pr('score', 'date')} AS ps FROM sc), ts AS (SELECT unnest({TAILS}::DOUBLE[]) AS tail),
e AS (SELECT date, rel, tail, CASE WHEN py <= tail THEN 0 WHEN py >= 1 - tail THEN 2 ELSE 1 END AS y, CASE WHEN ps <= tail THEN 0 WHEN ps >= 1 - tail THEN 2 ELSE 1 END AS p FROM sp, ts),
q AS (SELECT * FROM {metrics_sql('e', 'y', 'p', 'tail')}),
d AS (SELECT tail, date, avg(CASE WHEN p = 2 THEN rel ELSE -rel END) AS day, count(*) AS n, sum(CASE WHEN p = 2 THEN rel ELSE -rel END) AS s,
  count(*) FILTER (CASE WHEN p = 2 THEN rel ELSE -rel END > 0) AS h FROM e WHERE p <> 1 GROUP BY 1, 2),
m AS (SELECT tail, {r('avg(n)', 'calls_per_day')}, {r('sum(h) / sum(n)', 'hit_rate')}, {r('sum(s) / sum(n)', 'gross_per_call')}, {r('sum(s) / sum(n) - 0.001', 'net_per_call')},
  {r('avg(day) * 252 / 5', 'ann_gross')}, {r('(avg(day) - 0.001) * 252 / 5', 'ann_net')}, {r('(avg(day) - 0.001) / stddev_samp(day) * sqrt(252 / 5)', 'sharpe_net')} FROM d GROUP BY 1)"""


@query("E13 L8", f"""{SPLIT} SELECT m.*, macro_f1, f1_0 AS f1_under, f1_1 AS f1_neutral, f1_2 AS f1_over, precision_2 AS prec_over, precision_0 AS prec_under
FROM m JOIN q USING (tail)""")
def label_split_sweep(spark, sf):
    return V.split_sweep(scored(spark, sf), "score", "rel", TAILS, 0.001, 5, n_rows(spark, sf))


LONG = f"""{SCORED_SQL}, lf AS ({' UNION ALL '.join(f"SELECT date, ticker, year, rel, target, '{f}' AS feature, {f} AS x FROM sc" for f in FEATS)})"""


def decile(keys="feature"):
    return (f"dk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x, cast(date AS varchar) || '|' || ticker) AS rn, count(*) OVER (PARTITION BY {keys}) AS cnt FROM lf), "
            f"dc AS (SELECT *, {tile_sql('rn', 'cnt', 10)} + 1 AS decile FROM dk)")


@query("E14", f"""{LONG}, {decile()}, tb AS (SELECT feature, decile, count(*) AS n, avg(rel) * 1e4 AS mean_bps FROM dc GROUP BY 1, 2)
SELECT feature, decile, n, {rs('mean_bps')}, {r('max(mean_bps) FILTER (decile = 10) OVER (PARTITION BY feature) - max(mean_bps) FILTER (decile = 1) OVER (PARTITION BY feature)', 'spread_bps')} FROM tb""")
def decile_table(spark, sf):
    return V.decile_table(scored(spark, sf), FEATS)


@query("E15", f"""{LONG}, {decile('year, feature')}
SELECT year, feature, count(*) AS n, {r('avg(rel) FILTER (decile = 1) * 1e4', 'd1_bps')}, {r('avg(rel) FILTER (decile BETWEEN 2 AND 9) * 1e4', 'mid_bps')},
  {r('avg(rel) FILTER (decile = 10) * 1e4', 'd10_bps')}, {r('avg(rel) FILTER (decile = 10) / (stddev_samp(rel) FILTER (decile = 10) / sqrt(count(*) FILTER (decile = 10)))', 'd10_t')}
FROM dc GROUP BY 1, 2 HAVING count(*) >= 100""")
def decile_stability(spark, sf):
    return V.decile_stability(scored(spark, sf), FEATS).filter("n >= 100")


@query("E18", f"{LONG}, {decile()} SELECT feature, decile, count(*) AS n, {r('avg(CASE WHEN target = 2 THEN 1.0 ELSE 0 END)', 'class_rate')} FROM dc GROUP BY 1, 2")
def class_rate_by_decile(spark, sf):
    return V.class_rate_by_decile(scored(spark, sf), FEATS, "target")


@query("E16", f"""{SCORED_SQL}, e AS (SELECT list_distinct([{', '.join(f'quantile_cont(score, {i / 20!r})' for i in range(21))}]) AS all_e FROM sc),
e2 AS (SELECT list_sort(all_e)[2:] AS e FROM e), b AS (SELECT len(list_filter(e, lambda x: x < score)) AS bin, score, rel FROM sc, e2)
SELECT bin, count(*) AS n, {r('avg(score)', 'score_mean')}, {r('avg(rel)', 'outcome_mean')}, {r('stddev_samp(rel) / sqrt(count(*))', 'se')},
  {r('avg(rel) - 1.96 * stddev_samp(rel) / sqrt(count(*))', 'low')}, {r('avg(rel) + 1.96 * stddev_samp(rel) / sqrt(count(*))', 'high')} FROM b GROUP BY 1""")
def calibration_bins(spark, sf):
    return V.calibration(scored(spark, sf), "score", "rel")


@query("E17", f"""{SCORED_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, cast(date AS varchar) || '|' || ticker) AS rk, count(*) OVER () AS cnt,
  row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS dk FROM sc),
a AS (SELECT avg(rel) FILTER (rk <= floor(cnt * 0.1)) AS tm, avg(rel) FILTER (rk > cnt - floor(cnt * 0.1)) AS bm, avg(rel) FILTER (dk <= 5) AS dm, avg(rel) AS am FROM k)
SELECT {r('tm', 'top_mean')}, {r('bm', 'bottom_mean')}, {r('dm', 'daily_top_mean')}, {r('am', 'all_mean')}, {r('tm - bm', 'spread')}, {r('tm / abs(bm)', 'ratio')} FROM a""")
def tails_spread(spark, sf):
    return V.tails_spread(scored(spark, sf), "score", "rel", 0.1, 5, group_rows=n_rows(spark, sf))


QS = [0.01, 0.05, 0.1, 0.2]


@query("E30", f"""{SCORED_SQL}, cut AS ({' UNION ALL '.join(f'SELECT {q}::DOUBLE AS q, quantile_cont(score, {1 - q!r}) AS c FROM sc' for q in QS)})
SELECT q, count(*) AS n, {r('avg(fwd_ret)', 'mean_outcome')}, {r('avg(CASE WHEN target = 2 THEN 1.0 ELSE 0 END)', 'precision')} FROM cut, sc WHERE score >= c GROUP BY 1""")
def top_score_quantiles(spark, sf):
    return V.top_quantiles(scored(spark, sf), "score", "fwd_ret", "target", QS)


@query("E31", f"""{SCORED_SQL}, s AS (SELECT year, prediction, count(*) AS n, avg(fwd_ret) AS m, median(fwd_ret) AS md FROM sc GROUP BY 1, 2),
u AS (SELECT year, avg(fwd_ret) AS um, avg(fwd_ret) FILTER (prediction = 2) - avg(fwd_ret) FILTER (prediction = 0) AS ls FROM sc GROUP BY 1)
SELECT year, prediction, n, {r('m', 'mean')}, {r('md', 'median')}, {r('um', 'universe_mean')}, {r('ls', 'long_short')} FROM s JOIN u USING (year)""")
def outcome_by_prediction(spark, sf):
    return V.outcome_by_prediction(scored(spark, sf), ["year"], "prediction", "fwd_ret")


BIN = f"""{REL}, k AS (SELECT *, {pr('rel', 'date')} AS p, {pr('abs(close - 950)', 'date')} AS q FROM lab WHERE rel IS NOT NULL AND close IS NOT NULL),
b AS (SELECT date, ticker, category, rel, CASE WHEN p >= 0.85 OR p <= 0.15 THEN 1 ELSE 0 END AS y, CASE WHEN q >= 0.7 THEN 1 ELSE 0 END AS h FROM k)"""


def binary(spark, sf):
    df = rel(spark, sf).filter(F.col("rel").isNotNull() & F.col("close").isNotNull()).withColumn("gap", F.abs(F.col("close") - 950))
    df = X.pct_rank(df, X.DATE, {"p": "rel", "q": "gap"}, n_rows(spark, sf))
    return df.select("date", "ticker", "category", "rel", ((F.col("p") >= 0.85) | (F.col("p") <= 0.15)).cast("int").alias("y"),
                     (F.col("q") >= 0.7).cast("int").alias("h"))


@query("E19", f"""{BIN}, m AS (SELECT category, arg_max(y, row(n, -y)) AS md FROM (SELECT category, y, count(*) AS n FROM b WHERE year(date) < 2000 GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT y, 0 AS c, coalesce(md, 0) AS k FROM b LEFT JOIN m USING (category) WHERE year(date) >= 2000)
SELECT 'constant' AS baseline, n, accuracy, macro_f1 FROM {metrics_sql('t', 'y', 'c', classes=(0, 1))} UNION ALL
SELECT 'category_mode', n, accuracy, macro_f1 FROM {metrics_sql('t', 'y', 'k', classes=(0, 1))}""")
def naive_baselines(spark, sf):
    b = binary(spark, sf)
    return V.category_mode_baseline(b.filter(F.year("date") < 2000), b.filter(F.year("date") >= 2000), "y", 0)


@query("E21", f"""{BIN}, c AS (SELECT quantile_cont(rel, 0.15) AS lo, quantile_cont(rel, 0.85) AS hi, quantile_cont(rel, 0.05) AS p05, quantile_cont(rel, 0.95) AS p95 FROM b),
kk AS (SELECT CASE WHEN y = 1 THEN 'Extreme' ELSE 'Neutral' END AS a, CASE WHEN h = 1 THEN 'Extreme' ELSE 'Neutral' END AS p, rel, lo, hi, p05, p95 FROM b, c)
SELECT a || '>' || p AS kind, count(*) AS n, count(*) FILTER (CASE WHEN a = 'Neutral' THEN abs(rel - lo) < (hi - lo) / 2 OR abs(rel - hi) < (hi - lo) / 2
  ELSE (rel >= p05 AND rel < lo) OR (rel <= p95 AND rel > hi) END) AS near, count(*) FILTER (a = 'Extreme' AND (rel < p05 OR rel > p95)) AS deep,
  {r('median(abs(rel))', 'median_abs')} FROM kk GROUP BY 1""")
def boundary_errors(spark, sf):
    word = lambda c: F.when(F.col(c) == 1, "Extreme").otherwise("Neutral")
    b = binary(spark, sf).withColumns({"a": word("y"), "p": word("h")})
    return V.boundary_errors(b, "rel", "a", "p")


@query("E22", f"""{SCORED_SQL} {' UNION ALL '.join(f"SELECT '{f}' AS feature, {r(f'abs(corr({f}, rel))', 'abs_corr')} FROM sc" for f in FEATS)}""")
def forward_correlation(spark, sf):
    return V.forward_correlation(scored(spark, sf), FEATS, "rel")


TRUNCATED = FM.FAMILIES


@query("E23", f"""{B.PANEL_SQL} SELECT c AS "column", (SELECT count(*) FROM panel WHERE date = DATE '2000-03-06') AS rows, 0 AS value_diffs, 0 AS null_diffs
FROM (SELECT unnest({[c for fs in TRUNCATED for c in fs.columns]}) AS c)""")
def truncation_check(spark, sf):
    """Feature columns recomputed from data up to one date: all difference counts must be zero."""
    n = n_rows(spark, sf)
    columns = [c for s in TRUNCATED for c in s.columns]
    cutoff = F.lit("2000-03-06").cast("date")
    return V.truncation_check(B.panel(spark, sf), lambda g: build(g, TRUNCATED, n), cutoff, columns)


@query("E25", f"""{REL}, l AS (SELECT ticker, rel, lag(rel) OVER ({AXIS}) AS b FROM lab), c AS (SELECT ticker, corr(rel, b) AS ac FROM l GROUP BY 1)
SELECT {r('median(ac)', 'median_autocorr')} FROM c WHERE ac IS NOT NULL AND NOT isnan(ac)""")
def label_autocorrelation(spark, sf):
    return V.label_autocorrelation(rel(spark, sf), tickers=n_rows(spark, sf))


@query("E26", f"""{SCORED_SQL} {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'corr')} FROM sc" for i, a in enumerate(FEATS) for b in FEATS[i:])}""")
def feature_correlation(spark, sf):
    return V.correlation_matrix(scored(spark, sf), FEATS)


@query("E26", f"""{SCORED_SQL} {' UNION ALL '.join(f"SELECT '{f}' AS feature, {r(f'abs(avg({f}) FILTER (target = 2) - avg({f}) FILTER (target = 0)) / stddev_samp({f})', 'separation')} FROM sc" for f in FEATS)}""")
def class_separation(spark, sf):
    return V.class_separation(scored(spark, sf), FEATS, "target")


PAIRS = f"""{B.PANEL_SQL}, a AS (SELECT date, ticker, {chg('close', 5)} AS ret, {roll('avg', 'close', 20)} AS avg20 FROM panel),
w AS (SELECT ticker FROM panel GROUP BY 1 HAVING max(t) FILTER (close IS NOT NULL) - min(t) FILTER (close IS NOT NULL) + 1 = count(close)),
b AS (SELECT date, ticker, close / lag(close, 5) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret, CASE WHEN count(*) OVER k >= 20 THEN avg(close) OVER k END AS avg20
  FROM ohlcv WINDOW k AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING))"""


def _parity_sql(where):
    col = lambda c: (f"SELECT '{c}' AS \"column\", count(*) AS rows, {r(f'corr(a.{c}, b.{c})', 'corr')}, "  # noqa: E731
                     f"{r(f'avg(CASE WHEN a.{c} IS NULL AND b.{c} IS NULL THEN 0.0 WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 1.0 WHEN abs(a.{c} - b.{c}) > 1e-9 + 1e-6 * abs(b.{c}) THEN 1.0 ELSE 0.0 END)', 'mismatch')} "
                     f"FROM a JOIN b USING (date, ticker) {where}")
    return f"{PAIRS} {col('ret')} UNION ALL {col('avg20')}"


def _two_builds(spark, sf):
    """The same two columns from the dense grid, and from each ticker's own rows."""
    g = B.panel(spark, sf)
    dense = g.select("date", "ticker", R.pct_change("close", 5).alias("ret"), R.mean("close", 20).alias("avg20"))
    own = B.ohlcv(spark, sf).withColumn("t", F.datediff("date", F.lit("1990-01-01").cast("date")))
    sparse = own.select("date", "ticker", R.pct_change("close", 5).alias("ret"), R.mean("close", 20).alias("avg20"))
    return g, dense, sparse


@query("E27", _parity_sql(""))
def panel_parity(spark, sf):
    _, dense, sparse = _two_builds(spark, sf)
    return V.parity(dense, sparse, ["ret", "avg20"])


@query("E27", _parity_sql("WHERE ticker IN (SELECT ticker FROM w)"))
def panel_parity_gap_free(spark, sf):
    g, dense, sparse = _two_builds(spark, sf)
    return V.parity(dense.join(V.gap_free(g), "ticker", "left_semi"), sparse, ["ret", "avg20"])


@query("E28", f"""{B.PANEL_SQL}, a AS (SELECT *, {chg('close')} AS r1 FROM panel), g AS (SELECT *, exp(sum(ln(1 + r1)) OVER ({AXIS} ROWS UNBOUNDED PRECEDING)) AS gr FROM a),
d AS (SELECT *, gr / max(gr) OVER ({AXIS} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM g)
SELECT ticker, {r('avg(r1) * 52', 'ann_return')}, {r('stddev_samp(r1) * sqrt(52)', 'ann_vol')}, {r('min(dd)', 'max_drawdown')} FROM d GROUP BY 1""")
def fund_profile(spark, sf):
    return V.fund_profile(B.panel(spark, sf).withColumn("r1", R.pct_change("close")), 52.0)


@query("E28", f"""{B.PANEL_SQL}, a AS (SELECT *, {chg('close')} AS r1 FROM panel), d AS (SELECT category, date, avg(r1) AS r FROM a GROUP BY 1, 2)
SELECT category, date, {r('exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY category ORDER BY date ROWS UNBOUNDED PRECEDING))', 'growth')} FROM d""")
def category_composite(spark, sf):
    return V.group_composite(B.panel(spark, sf).withColumn("r1", R.pct_change("close")), "category")


@query("E28", f"{REL} SELECT category, {r('stddev_samp(rel) * 1e4', 'spread_bps')} FROM lab GROUP BY 1")
def outcome_spread_by_category(spark, sf):
    return rel(spark, sf).groupBy("category").agg((F.stddev_samp("rel") * 1e4).alias("spread_bps"))


@query("E29", f"""{ARMS_SQL}, p AS (SELECT arm, target, {TERC.format(p='(' + pr('score', 'arm, date') + ')')} AS pred FROM (SELECT arm, date, ticker, target, s AS score FROM arms)),
{ic_sql('(SELECT arm, date, s AS score, rel FROM arms)', 'arm', 1)}
SELECT arm AS run, 'classes' AS kind, macro_f1, NULL::DOUBLE AS mean_ic FROM {metrics_sql('p', 'target', 'pred', 'arm')}
UNION ALL SELECT arm, 'ranking', NULL, {r('avg(ic)').split(' AS ')[0]} FROM ic GROUP BY arm""")
def leaderboard(spark, sf):
    n = n_rows(spark, sf)
    a = arms(scored(spark, sf)).drop("pred")
    pred = X.pct_rank(a, ["arm", "date"], {"_p": "score"}, n).withColumn("pred", X.tercile_of("_p"))
    cls = V.class_metrics(pred, "target", "pred", ["arm"]).select(F.col("arm").alias("run"), F.lit("classes").alias("kind"), "macro_f1")
    ic = V.daily_rank_ic(a, by=["arm"], group_rows=n).groupBy("arm").agg(F.avg("ic").alias("mean_ic"))
    rank = ic.select(F.col("arm").alias("run"), F.lit("ranking").alias("kind"), "mean_ic")
    return V.leaderboard([cls, rank], "macro_f1")


