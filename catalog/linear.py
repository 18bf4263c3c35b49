"""Linear fits by normal equations, beside the same sums and eliminations in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog import boosted as W
from catalog.base import r, rs
from catalog.evaluation import metrics_sql
from catalog.models import FEATS, H, cal, halves, training
from catalog.registry import query
from catalog.scored import SCORED_SQL
from catalog.splits import FOLDS, YEARS
from crosspanel.operators import evaluate as V
from crosspanel.operators import linear as N
from crosspanel.operators import models as M
from crosspanel.operators import splits as S

REG = 1e-3


def solve_sql(m: str) -> str:
    """The solution of a system given as rows with the right side last, by elimination on lists."""
    step = ("lambda a, e: list_transform(a, lambda row, i: CASE WHEN i = e[1][1]::INT THEN list_transform(row, lambda x: x / row[e[1][1]::INT]) "
            "ELSE list_transform(row, lambda x, j: x - row[e[1][1]::INT] * a[e[1][1]::INT][j] / a[e[1][1]::INT][e[1][1]::INT]) END)")
    return f"list_transform(list_reduce(list_concat([{m}], list_transform(range(1, len({m}) + 1), lambda k: [[k::DOUBLE]])), {step}), lambda row: row[len(row)])"


def design_sql(rows: str, features, learns: str = "learns") -> str:
    """zl(g, id, learns, i, z): standardised values of the rows (g, id, learns, features), 0 the intercept; st from the learning rows."""
    return f"""
ll AS MATERIALIZED ({' UNION ALL '.join(f'SELECT g, id, {learns} AS learns, {i + 1} AS i, {c} AS x FROM {rows}' for i, c in enumerate(features))}),
st AS MATERIALIZED (SELECT g, i, avg(x) AS mean, stddev_samp(x) AS sd, median(x) AS med FROM ll WHERE learns GROUP BY g, i),
zl AS MATERIALIZED (SELECT g, id, learns, i, coalesce(least({N.BOUND}, greatest(-{N.BOUND}, (coalesce(x, med) - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END)), 0) AS z FROM ll JOIN st USING (g, i)
  UNION ALL SELECT g, id, {learns}, 0, 1.0 FROM {rows}),
nn AS (SELECT g, count(*) AS n FROM {rows} WHERE {learns} GROUP BY g)"""


def matrix_sql(cells: str, out: str, by: str = "g") -> str:
    return f"""{out} AS MATERIALIZED (SELECT {by}, list(r ORDER BY i) AS m FROM (SELECT {by}, i, list(s ORDER BY j) AS r FROM (SELECT {by}, i, j, sum(s) AS s FROM {cells} GROUP BY {by}, i, j) GROUP BY {by}, i) GROUP BY {by})"""


def ridge_sql(rows: str, width: int) -> str:
    """cf(g, i, v): the coefficients of a ridge regression of y."""
    return f""",
gm AS (SELECT a.g, a.i, b.i AS j, sum(a.z * b.z) AS s FROM zl a JOIN zl b USING (g, id) WHERE a.learns GROUP BY ALL
  UNION ALL SELECT g, i, {width} AS j, sum(z * y) FROM zl JOIN {rows} USING (g, id) WHERE zl.learns GROUP BY g, i
  UNION ALL SELECT g, i, i, {REG} * n FROM nn, (SELECT unnest(range(1, {width})) AS i)),
{matrix_sql('gm', 'mx')},
sv AS MATERIALIZED (SELECT g, {solve_sql('m')} AS b FROM mx),
cf AS MATERIALIZED (SELECT g, unnest(range({width})) AS i, unnest(b) AS v FROM sv)"""


def newton_sql(rows: str, width: int, steps: int, blocks: int = 2) -> str:
    """t{steps}(g, k, i, v): the coefficients after Newton steps from zero, for classes 1 and up against class 0."""
    size = width * blocks
    out = f""",
kk AS (SELECT unnest(range(1, {blocks + 1})) AS k),
t0 AS MATERIALIZED (SELECT g, k, i, 0.0::DOUBLE AS v FROM nn, kk, (SELECT unnest(range({width})) AS i))"""
    for s in range(steps):
        out += f""",
e{s} AS (SELECT g, id, k, exp(sum(z * v)) AS e FROM zl JOIN t{s} USING (g, i) WHERE learns GROUP BY g, id, k),
p{s} AS MATERIALIZED (SELECT g, id, k, e / (1 + sum(e) OVER (PARTITION BY g, id)) AS p FROM e{s}),
w{s} AS MATERIALIZED (SELECT a.g, a.id, a.k, b.k AS l, a.p * (CASE WHEN a.k = b.k THEN 1 ELSE 0 END - b.p) AS w FROM p{s} a JOIN p{s} b USING (g, id)),
c{s} AS (SELECT a.g, ((w.k - 1) * {width} + a.i) AS i, ((w.l - 1) * {width} + b.i) AS j, sum(w.w * a.z * b.z) AS s FROM w{s} w JOIN zl a USING (g, id) JOIN zl b USING (g, id) GROUP BY ALL
  UNION ALL SELECT g, (k - 1) * {width} + i, {size}, sum((p - CASE WHEN y = k THEN 1 ELSE 0 END) * z) FROM p{s} JOIN zl USING (g, id) JOIN (SELECT g, id, y FROM {rows}) USING (g, id) GROUP BY g, k, i
  UNION ALL SELECT g, (k - 1) * {width} + i, (k - 1) * {width} + i, {REG} * n FROM nn, kk, (SELECT unnest(range(1, {width})) AS i)
  UNION ALL SELECT g, (k - 1) * {width} + i, {size}, {REG} * n * v FROM t{s} JOIN nn USING (g) WHERE i > 0),
{matrix_sql(f'c{s}', f'x{s}')},
b{s} AS MATERIALIZED (SELECT g, unnest(range({size})) AS at, unnest(b) AS d FROM (SELECT g, {solve_sql('m')} AS b FROM x{s})),
t{s + 1} AS MATERIALIZED (SELECT t.g, k, i, v - d AS v FROM t{s} t JOIN b{s} b ON b.g = t.g AND b.at = (k - 1) * {width} + i)"""
    return out


def names_sql(features) -> str:
    return f"nm AS (SELECT unnest(range({len(features) + 1})) AS i, unnest({['', *features]}) AS feature)"


# -- all 42 columns ---------------------------------------------------------------------------------

WIDE = f"{W.BINNED}, wr AS MATERIALIZED (SELECT 0 AS g, * FROM al), {design_sql('wr', W.FEATURES)}"
WIDTH = len(W.FEATURES) + 1


@query("M14", f"{WIDE}{ridge_sql('wr', WIDTH)}, {names_sql(W.FEATURES)} SELECT feature, {r('v', 'value', 5)} FROM cf JOIN nm USING (i)", digits=5)
def ordinal_coefficients(spark, sf):
    """Coefficients of the regressed class number on all 42 standardised features."""
    train, _ = W.halves(spark, sf)
    return N.ridge(train, W.FEATURES, reg=REG).table(spark).select("feature", "value")


@query("M1", f"{WIDE}{newton_sql('wr', WIDTH, 2)}, {names_sql(W.FEATURES)} SELECT k AS class, feature, {r('v', 'value', 5)} FROM t2 JOIN nm USING (i)", digits=5)
def newton_coefficients(spark, sf):
    """Coefficients of the logistic model on all 42 features after two Newton steps."""
    train, _ = W.halves(spark, sf)
    return N.logistic(train, W.FEATURES, reg=REG, steps=2).table(spark).select("class", "feature", "value")


# -- the small feature set, on held-out rows and in folds -------------------------------------------

SMALL = f"""{SCORED_SQL}, sr AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY date, ticker) AS id, date, ticker, target AS y, date < DATE '2000-01-01' AS learns, {', '.join(FEATS)} FROM sc
  WHERE date < DATE '2000-01-01' OR date >= DATE '2000-01-01' + 35), {design_sql('sr', FEATS)}"""


@query("M14", f"""{SMALL}{ridge_sql('sr', len(FEATS) + 1)}, pd AS (SELECT id, sum(z * v) AS x FROM zl JOIN cf USING (g, i) WHERE NOT learns GROUP BY id),
cl AS (SELECT y, CASE WHEN x < 0.5 THEN 0 WHEN x < 1.5 THEN 1 ELSE 2 END AS call FROM pd JOIN sr USING (id)),
gr AS (SELECT a AS actual, p AS predicted FROM (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS p)),
c AS (SELECT actual, predicted, count(y) AS n FROM gr LEFT JOIN cl ON y = actual AND call = predicted GROUP BY 1, 2)
SELECT actual, predicted, n, {r('n / nullif(sum(n) OVER (PARTITION BY actual), 0)', 'row_share')}, {r('sum(n) OVER (PARTITION BY predicted) / sum(n) OVER ()', 'predicted_share')} FROM c""")
def ordinal_regression(spark, sf):
    """Confusion counts of regressed class numbers cut at 0.5 and 1.5, on held-out rows."""
    train, test = halves(spark, sf)
    return V.confusion(N.ridge(train, FEATS, reg=REG).predict(test).withColumn("call", M.bucket()), "target", "call")


STEPS = 6
FOLDED = f"""{SCORED_SQL}{FOLDS[FOLDS.index(", f0 AS"):]},
fr AS MATERIALIZED (SELECT fold AS g, row_number() OVER (ORDER BY fold, date, ticker) AS id, date, ticker, target AS y, date <= cut AS learns, {', '.join(FEATS)}
  FROM sc, folds WHERE date <= cut OR date BETWEEN test_start AND test_end), {design_sql('fr', FEATS)}{newton_sql('fr', len(FEATS) + 1, STEPS)},
fe AS (SELECT g, id, k, exp(sum(z * v)) AS e FROM zl JOIN t{STEPS} USING (g, i) WHERE NOT learns GROUP BY g, id, k),
fp AS MATERIALIZED (SELECT g AS fold, id, 1 / (1 + sum(e)) AS p0, max(e) FILTER (k = 1) / (1 + sum(e)) AS p1, max(e) FILTER (k = 2) / (1 + sum(e)) AS p2 FROM fe GROUP BY g, id),
fc AS MATERIALIZED (SELECT fold, date, ticker, y AS target, p0, p1, p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction FROM fp JOIN fr USING (id))"""


def walked(spark, sf):
    """Held-out rows of every fold, scored by the model of the rows before its cut; all folds are fitted together."""
    df, c = training(spark, sf), cal(spark, sf)
    folds = S.folds(c, YEARS, H)
    S.assert_no_overlap(c, folds, H)
    model = N.logistic(N.expanding(df, folds), FEATS, by="fold", reg=REG, steps=STEPS)
    tests = df.withColumn("fold", F.year("date").cast("long")).filter(F.col("fold").isin(YEARS))
    return model.score(tests, by="fold")


@query("M1 M5 P3 M7", f"{FOLDED} SELECT fold, date, ticker, {rs('p0', 'p1', 'p2')}, {r('p2 - p0', 'score')} FROM fc")
def fold_probabilities(spark, sf):
    """Walk-forward class probabilities of a logistic model fitted by Newton steps."""
    return walked(spark, sf).select("fold", "date", "ticker", "p0", "p1", "p2", "score")


APART = f"fx AS MATERIALIZED (SELECT fc.* FROM fc JOIN (SELECT DISTINCT date, t FROM sc) USING (date) WHERE t % {H} = 0)"


@query("M1 M5 P3 P9 E2", f"""{FOLDED}, {APART}, ps AS (SELECT fold::VARCHAR AS fold, n, accuracy, macro_f1 FROM {metrics_sql('fc', 'target', 'prediction', 'fold')}),
pl AS (SELECT 'pooled' AS fold, n, accuracy, macro_f1 FROM {metrics_sql('fc', 'target', 'prediction')}),
px AS (SELECT 'non_overlapping' AS fold, n, accuracy, macro_f1 FROM {metrics_sql('fx', 'target', 'prediction')}) SELECT * FROM ps UNION ALL SELECT * FROM pl UNION ALL SELECT * FROM px""")
def logistic_walk_forward(spark, sf):
    """Per-fold and pooled metrics of purged expanding folds with a multinomial logistic model."""
    return M.fold_report(walked(spark, sf), horizon=H)


@query("M1", f"{FOLDED}, {names_sql(FEATS)} SELECT g AS fold, k AS class, feature, {r('v', 'value')} FROM t{STEPS} JOIN nm USING (i)")
def fold_coefficients(spark, sf):
    """Coefficients of every fold's model."""
    df, c = training(spark, sf), cal(spark, sf)
    model = N.logistic(N.expanding(df, S.folds(c, YEARS, H)), FEATS, by="fold", reg=REG, steps=STEPS)
    return model.table(spark).select(F.col("group").alias("fold"), "class", "feature", "value")
