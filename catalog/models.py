"""Training, scoring and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import ar, r, rs
from catalog.evaluation import CARD, corr_sql, metrics_sql
from catalog.registry import query
from catalog.scored import SCORED_SQL, scored, scored_table
from catalog.splits import FOLDS, YEARS
from crosspanel.operators import cross as X
from crosspanel.operators import decisions as D
from crosspanel.operators import evaluate as V
from crosspanel.operators import labels as L
from crosspanel.operators import models as M
from crosspanel.operators import splits as S
from crosspanel.sources import panel as P

FEATS = ["ret_1d", "ret_5d", "ret_20d", "vol_20d"]
H = 5


def training(spark, sf):
    """Feature rows with the three-class target, tail flags and calendar position."""
    n = B.universe_rows(spark, sf)
    df = scored_table(spark, sf).drop("p0", "p1", "p2", "score", "prediction", "confidence")
    df = X.pct_rank(df, X.DATE, {"pct": "rel"}, n)
    return df.withColumns(L.tail_flags("pct", 0.25))


def cal(spark, sf):
    return P.calendar(B.ohlcv(spark, sf))


def halves(spark, sf):
    df = training(spark, sf)
    cut = F.lit("2000-01-01").cast("date")
    return df.filter(F.col("date") < cut), df.filter(F.col("date") >= F.date_add(cut, 35))


# -- projections with an SQL twin -----------------------------------------------------------

STATS = f"""{SCORED_SQL}, tr AS (SELECT * FROM sc WHERE year < 2000), ls AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS x FROM tr" for f in FEATS)}),
st AS MATERIALIZED (SELECT feature, avg(x) AS mean, stddev_samp(x) AS std, median(x) AS median FROM ls GROUP BY 1)"""


@query("M2", f"{STATS} SELECT feature, {rs('mean', 'std', 'median')} FROM st")
def fit_statistics(spark, sf):
    return D.fit_stats(scored(spark, sf).filter("year < 2000"), FEATS)


def _z(f):
    s = f"(SELECT {{}} FROM st WHERE feature = '{f}')"
    return r(f"least(5, greatest(-5, (coalesce({f}, {s.format('median')}) - {s.format('mean')}) / {s.format('std')}))", f)


@query("M2", f"{STATS} SELECT date, ticker, {', '.join(_z(f) for f in FEATS)} FROM sc")
def standardised_rows(spark, sf):
    sc = scored_table(spark, sf)
    stats = D.collect_stats(D.fit_stats(sc.filter("year < 2000"), FEATS))
    return D.apply_stats(sc.select("date", "ticker", *FEATS), stats)


@query("M7", f"{SCORED_SQL} SELECT date, ticker, {rs('p0', 'p1', 'p2', 'score', 'confidence')}, prediction FROM sc")
def score_columns(spark, sf):
    return scored(spark, sf).select("date", "ticker", "p0", "p1", "p2", "score", "confidence", "prediction")


EXT = "(1 / (1 + exp(-(vol_20d * 100 - 3))))"
DIR = "(1 / (1 + exp(-(ret_5d * 50))))"


def gate_columns(df):
    logistic = lambda x: 1 / (1 + F.exp(-x))
    return df.withColumns({"p_ext": logistic(F.col("vol_20d") * 100 - 3), "p_dir": logistic(F.col("ret_5d") * 50)})


@query("M4", f"""{SCORED_SQL}, g AS (SELECT *, {EXT} AS e, {DIR} AS d FROM sc) SELECT date, ticker, {r('e * (2 * d - 1)', 'score')}, {r('e * (1 - d)', 'p0')},
  {r('1 - e', 'p1')}, {r('e * d', 'p2')} FROM g""")
def two_stage_columns(spark, sf):
    df = gate_columns(scored(spark, sf)).withColumns(D.two_stage("p_ext", "p_dir"))
    return df.select("date", "ticker", "score", "p0", "p1", "p2")


WEIGHTS = [i / 10 for i in range(11)]


def zday(x):
    return f"(({x}) - avg({x}) OVER (PARTITION BY date)) / CASE WHEN stddev_samp({x}) OVER (PARTITION BY date) > 0 THEN stddev_samp({x}) OVER (PARTITION BY date) ELSE 1 END"


BLEND = f"""{SCORED_SQL}, zz AS (SELECT date, rel, {zday('score')} AS za, {zday('-ret_5d')} AS zb FROM sc), bw AS (SELECT unnest({WEIGHTS}::DOUBLE[]) AS weight),
bs AS MATERIALIZED (SELECT weight, date, rel, weight * za + (1 - weight) * zb AS s FROM zz, bw), br AS (SELECT weight, date, {ar('s', 'weight, date')} AS a, {ar('rel', 'weight, date')} AS b FROM bs),
bi AS (SELECT weight, date, {corr_sql('a', 'b')} AS ic FROM br GROUP BY 1, 2), bm AS (SELECT weight, avg(ic) AS m FROM bi GROUP BY 1)"""


@query("M8 X7 E7", f"{BLEND} SELECT weight, {r('m', 'mean_ic')} FROM bm")
def blend_weights(spark, sf):
    df = scored(spark, sf).withColumn("other", -F.col("ret_5d"))
    return D.blend_weights(df, "score", "other", "rel", WEIGHTS, B.universe_rows(spark, sf))


@query("M8", f"{BLEND} SELECT {r('arg_max(weight, m)', 'weight')}, {r('max(m)', 'mean_ic')} FROM bm")
def best_blend_weight(spark, sf):
    return blend_weights(spark, sf).agg(F.max_by("weight", "mean_ic").alias("weight"), F.max("mean_ic").alias("mean_ic"))


@query("M9 M17", f"""{SCORED_SQL}, g AS (SELECT date, ticker, (p0 + {EXT} * (1 - {DIR})) / 2 AS a, (p1 + 1 - {EXT}) / 2 AS b, (p2 + {EXT} * {DIR}) / 2 AS c FROM sc)
SELECT date, ticker, {r('c - a', 'score')}, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS prediction FROM g""")
def soft_vote(spark, sf):
    df = gate_columns(scored(spark, sf))
    two = D.two_stage("p_ext", "p_dir")
    df = df.withColumns({f"q{i}": two[f"p{i}"] for i in range(3)})
    df = df.withColumns(D.soft_vote([("p0", "p1", "p2"), ("q0", "q1", "q2")], ("p0", "p1", "p2"))).withColumns(D.score_columns())
    return df.select("date", "ticker", "score", "prediction")


@query("M17", f"""{SCORED_SQL}, g AS (SELECT date, ticker, p0, p1, p2 FROM sc UNION ALL SELECT date, ticker, {EXT} * (1 - {DIR}), 1 - {EXT}, {EXT} * {DIR} FROM sc),
m AS (SELECT date, ticker, avg(p0) AS a, avg(p1) AS b, avg(p2) AS c FROM g GROUP BY 1, 2)
SELECT date, ticker, {r('c - a', 'score')}, {r('greatest(a, b, c)', 'confidence')} FROM m""")
def seed_mean(spark, sf):
    df = gate_columns(scored(spark, sf))
    two = D.two_stage("p_ext", "p_dir")
    runs = F.explode(F.array(F.struct("p0", "p1", "p2"), F.struct(*[two[f"p{i}"].alias(f"p{i}") for i in range(3)])))
    return D.seed_mean(df.select("date", "ticker", runs.alias("r")).select("date", "ticker", "r.*"), ["date", "ticker"]).select(
        "date", "ticker", "score", "confidence")


def cost_sql(cost):
    e = [" + ".join(f"p{k} * {cost[k][c]}" for k in range(3)) for c in range(3)]
    realised = "CASE " + " ".join(f"WHEN target = {k} AND call = {c} THEN {cost[k][c]}" for k in range(3) for c in range(3)) + " END"
    return e, realised


def _bayes(cost):
    e, realised = cost_sql(cost)
    return f"""{SCORED_SQL}, ec AS (SELECT target, round({e[0]}, 12) AS e0, round({e[1]}, 12) AS e1, round({e[2]}, 12) AS e2 FROM sc),
cl AS (SELECT target, CASE WHEN e0 <= e1 AND e0 <= e2 THEN 0 WHEN e1 <= e2 THEN 1 ELSE 2 END AS call FROM ec)
SELECT call, count(*) AS n, {r(f'avg({realised})', 'mean_cost')} FROM cl GROUP BY 1"""


def _bayes_run(cost):
    def run(spark, sf):
        rounded = [F.round(c, 12) for c in D.expected_costs(D.P, cost)]
        df = scored(spark, sf).withColumn("call", D.first_best(rounded, smallest=True))
        df = df.withColumn("cost", D.realised_cost("target", "call", cost))
        return df.groupBy("call").agg(F.count(F.lit(1)).alias("n"), F.avg("cost").alias("mean_cost"))
    return run


for _name, _cost in (("bayes_calls_quadratic", D.COST_QUADRATIC), ("bayes_calls_aggressive", D.COST_AGGRESSIVE)):
    _fn = _bayes_run(_cost)
    _fn.__name__ = _name
    query("M10", _bayes(_cost))(_fn)


_e, _ = cost_sql(D.COST_AGGRESSIVE)


@query("M11 M10 E11", f"""{SCORED_SQL}, ec AS (SELECT *, {_e[1]} - least({_e[0]}, {_e[2]}) AS saving, CASE WHEN {_e[2]} < {_e[0]} THEN 2 ELSE 0 END AS direction FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(saving, 9) DESC, ticker) AS rk, CASE WHEN direction = 2 THEN rel ELSE -rel END AS pay FROM ec)
SELECT {CARD} FROM rk WHERE rk <= greatest(floor(_n * 0.15), 1)""")
def gated_by_saving(spark, sf):
    df = scored(spark, sf).withColumns(D.saving_direction(D.P, D.COST_AGGRESSIVE)).withColumn("saving", F.round("saving", 9))
    return V.scorecard(D.gated_calls(df, "saving", 0.15, B.universe_rows(spark, sf)), [], "direction", "target", "rel")


GRID = [i / 20 for i in range(1, 20)]


@query("M12", f"""{SCORED_SQL}, t AS (SELECT unnest({GRID}::DOUBLE[]) AS threshold), c AS (SELECT threshold, 2.0 * count(*) FILTER (p2 >= threshold AND target = 2) /
  (count(*) FILTER (p2 >= threshold) + count(*) FILTER (target = 2)) AS f1 FROM sc, t WHERE year < 2000 GROUP BY 1)
SELECT threshold, {r('f1')} FROM c ORDER BY c.f1 DESC, threshold LIMIT 1""")
def tuned_threshold(spark, sf):
    df = scored(spark, sf).filter("year < 2000").withColumn("y", (F.col("target") == 2).cast("int"))
    return D.tune_threshold(df, "y", "p2", GRID)


THRESHOLDS = [0.45, 0.48, 0.5, 0.52]


@query("M13", f"""{SCORED_SQL}, e AS (SELECT threshold, target, CASE WHEN confidence < threshold THEN 1 ELSE prediction END AS call FROM sc, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold)),
q AS (SELECT * FROM {metrics_sql('e', 'target', 'call', 'threshold')}) SELECT threshold, n, accuracy, macro_f1, call_share FROM q JOIN
(SELECT threshold, {r('avg(CASE WHEN call <> 1 THEN 1.0 ELSE 0 END)', 'call_share')} FROM e GROUP BY 1) USING (threshold)""")
def abstention_sweep(spark, sf):
    return D.abstention_table(scored(spark, sf), "target", D.P, THRESHOLDS)


@query("M13", f"""{SCORED_SQL}, g AS (SELECT *, {EXT} AS e, {DIR} AS d FROM sc) SELECT date, ticker, CASE WHEN abs(p2 - p0) < 0.05 THEN 1 ELSE prediction END AS by_margin,
  CASE WHEN confidence < 0.4 THEN 1 ELSE prediction END AS by_probability, CASE WHEN e < 0.4 THEN 1 WHEN d >= 0.55 THEN 2 WHEN d <= 0.45 THEN 0 ELSE 1 END AS by_direction FROM g""")
def abstaining_calls(spark, sf):
    df = gate_columns(scored(spark, sf))
    return df.select("date", "ticker", D.abstain_margin(D.P).alias("by_margin"), D.abstain_below(D.P, 0.4).alias("by_probability"),
                     D.direction_cutoffs("p_ext", "p_dir", 0.4, 0.45, 0.55).alias("by_direction"))


@query("M18", f"{SCORED_SQL} SELECT date, ticker, {r('(score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ())', 'unit_score')} FROM sc")
def rescaled_score(spark, sf):
    return D.rescale(scored_table(spark, sf), "score", "unit_score").select("date", "ticker", "unit_score")


# -- fits -------------------------------------------------------------------------------------


@query("M3 M6 M7")
def forest_scores(spark, sf):
    """Scores of a three-class tree ensemble on held-out dates."""
    train, test = halves(spark, sf)
    scored_rows = M.forest(train, FEATS, trees=20, depth=6).score(test)
    return scored_rows.select("date", "ticker", "score", "prediction", "confidence")


@query("M16")
def feature_importance(spark, sf):
    train, _ = halves(spark, sf)
    return M.importance_table(spark, M.forest(train, FEATS, trees=10, depth=5))


def leak_checks(spark, sf):
    """Both checks with a small forest."""
    train, test = halves(spark, sf)
    fit = lambda t, f: M.forest(t, f, trees=5, depth=5)
    return M.shuffled_label_accuracy(train, test, FEATS, fit).unionByName(M.planted_leak_accuracy(train, test, FEATS, fit))


# -- what must hold for any fit, with SQL ---------------------------------------------------------

TEST = f"{SCORED_SQL}, te AS (SELECT date, ticker FROM sc WHERE date >= DATE '2000-01-01' + 35)"


@query("M3 M6 M7", f"{TEST} SELECT date, ticker, 1.0 AS total, true AS score_is_difference, true AS call_is_largest, true AS in_range FROM te")
def forest_score_rules(spark, sf):
    """Held-out rows are scored once each, by probabilities that sum to one."""
    train, test = halves(spark, sf)
    out = M.forest(train, FEATS, trees=10, depth=5).score(test)
    p = [F.col(c) for c in D.P]
    return out.select(
        "date", "ticker", F.round(p[0] + p[1] + p[2], 6).alias("total"), (F.abs(F.col("score") - (p[2] - p[0])) < 1e-9).alias("score_is_difference"),
        (F.greatest(*p) == F.when(F.col("prediction") == 0, p[0]).when(F.col("prediction") == 1, p[1]).otherwise(p[2])).alias("call_is_largest"),
        ((F.least(*p) >= 0) & (F.col("confidence") >= 1 / 3 - 1e-9)).alias("in_range"))


@query("M4", f"{TEST} SELECT date, ticker, true AS score_is_product, true AS in_range FROM te")
def two_stage_score_rules(spark, sf):
    train, test = halves(spark, sf)
    out = M.two_stage(train, FEATS, rounds=4).score(test)
    gate, up = F.col("p_ext"), F.col("p_dir")
    return out.select("date", "ticker", (F.abs(F.col("score") - gate * (2 * up - 1)) < 1e-9).alias("score_is_product"),
                      (gate.between(0, 1) & up.between(0, 1)).alias("in_range"))


@query("M14", f"{TEST} SELECT date, ticker, true AS call_fits FROM te")
def ordinal_call_rules(spark, sf):
    train, test = halves(spark, sf)
    pred = M.ordinal_regression(train, FEATS).transform(test)
    return pred.withColumn("call", M.bucket()).select(
        "date", "ticker", ((F.abs(F.least(F.greatest("prediction", F.lit(0.0)), F.lit(2.0)) - F.col("call"))) <= 0.5).alias("call_fits"))


@query("M1 M5 P3", f"""{SCORED_SQL}{FOLDS[FOLDS.index(", f0 AS"):]}
SELECT fold::BIGINT AS fold, count(*) AS n, 0 AS trained_late FROM sc JOIN folds ON date BETWEEN test_start AND test_end GROUP BY 1""")
def fold_rows(spark, sf):
    """Rows scored in every fold; none of them may have trained the fold's model."""
    df, c = training(spark, sf), cal(spark, sf)
    out = M.walk_forward(df, FEATS, lambda t, f: M.logistic(t, f, max_iter=5), c, YEARS, H)
    cuts = S.folds(c, YEARS, H).select(F.col("fold").alias("f"), "cut")
    late = out.join(cuts, out.fold == cuts.f).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("date") <= F.col("cut"), 1)).alias("trained_late"))
    return late.select(F.col("fold").cast("long").alias("fold"), "n", "trained_late")


@query("M15 M16", f"SELECT {len(FEATS)} AS features, 1.0 AS total, {len(FEATS) - 1} AS without_top, true AS sorted")
def importance_rules(spark, sf):
    train, _ = halves(spark, sf)
    model = M.forest(train, FEATS, trees=10, depth=5)
    table = M.importance_table(spark, model)
    return table.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("share"), 6).alias("total")).withColumns(
        {"without_top": F.lit(len(M.drop_top(FEATS, model, 1))), "sorted": F.lit(M.drop_top(FEATS, model, 1) == [f for f in FEATS if f != model.importance()[0][0]])})


@query("E24 P13", "SELECT 'planted_leak' AS check, true AS stands_out UNION ALL SELECT 'shuffled_label', false")
def leak_verdicts(spark, sf):
    """A planted outcome column lifts the accuracy far above the honest one; a permuted label does not lift it above the majority share."""
    return leak_checks(spark, sf).select("check", (F.col("accuracy") > F.col("reference") + 0.2).alias("stands_out"))
