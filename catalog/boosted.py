"""Three-class boosting on the scale-free set of 42 columns, beside the same rounds written out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import pr, r, rs
from catalog.evaluation import metrics_sql
from catalog.families import staged
from catalog.indicators import V3_BASE, v3_stages
from catalog.registry import query
from catalog.scored import SCORED_SQL, scored_table
from catalog.splits import _h
from crosspanel.operators import boosting as G
from crosspanel.operators import cross as X
from crosspanel.operators import evaluate as V
from crosspanel.operators import labels as L
from crosspanel.operators import models as M
from crosspanel.plans import indicators as I
from crosspanel.session import discard, materialise

FEATURES = [c for c in I.V3_COLUMNS if c not in I.ABSOLUTE_SCALE]
#: Settings of the rounds that are compared with SQL; every row and every feature takes part in them, and quantiles are exact
#: up to half a million rows.
ROUNDS, DEPTH, BINS, RATE, PENALTY, LEAST = 2, 3, 16, 0.3, 1.0, 1.0
SETTINGS = dict(rounds=ROUNDS, depth=DEPTH, bins=BINS, rate=RATE, penalty=PENALTY, least=LEAST, subsample=1.0, colsample=1.0, accuracy=1_000_000)
SPLIT_YEAR = 2000
TAIL = 0.25
#: The outcome itself, planted as a feature by the leak check; the last of the numbered ones.
LEAK = "planted"


def training(spark, sf):
    """(date, ticker, target, rel, tail flags, 42 features rounded to 9 digits), written once."""
    n = B.universe_rows(spark, sf)
    features = I.scale_free(B.panel(spark, sf), n).select("date", "ticker", *[F.round(c, 9).alias(c) for c in FEATURES])
    scores = scored_table(spark, sf)
    labels = X.pct_rank(scores.select("date", "ticker", "target", "rel"), X.DATE, {"pct": "rel"}, n)
    labels = labels.withColumns({**L.tail_flags("pct", TAIL), LEAK: F.round("rel", 9)}).drop("pct")
    # the wide rows are dealt by ticker; the labels come to them
    out = materialise(labels.repartition("ticker").join(features, ["date", "ticker"]), "wide-training", as_dealt=True)
    discard(scores)
    return out


def halves(spark, sf):
    df = training(spark, sf)
    late = F.year("date") >= SPLIT_YEAR
    return df.filter(~late), df.filter(late)


def value(c: str) -> str:
    return f"round({c} / nullif(close, 0), 9)" if c in I.PRICE_UNIT else f"round({c}, 9)"


CUTS = f"list_distinct(quantile_disc(x, {[k / BINS for k in range(1, BINS)]}))"


def bins_sql(tag: str, rows: str) -> str:
    """Cuts from the learning rows of (id, y, w, learns), and the bins of all of them."""
    return f"""
{tag}ct AS MATERIALIZED (SELECT f, {CUTS} AS cuts FROM ls JOIN {rows} r USING (id) WHERE r.learns GROUP BY f),
{tag}bn AS MATERIALIZED (SELECT id, f, CASE WHEN x IS NULL THEN 0 ELSE 1 + len(list_filter(cuts, lambda c: c < x)) END AS bin FROM ls JOIN {tag}ct USING (f))"""


# every row of both halves; quantiles and gradients of the first half alone
BINNED = f"""{staged(v3_stages('date'), V3_BASE, 'g')},
lab AS MATERIALIZED ({SCORED_SQL} SELECT date, ticker, target, rel, {pr('rel', 'date')} AS pct FROM sc),
al AS MATERIALIZED (SELECT row_number() OVER (ORDER BY date, ticker) AS id, date, ticker, target AS y, year(date) < {SPLIT_YEAR} AS learns, round(rel, 9) AS {LEAK},
  CASE WHEN pct >= {1 - TAIL} THEN 1 ELSE 0 END AS y_top, CASE WHEN pct >= {1 - TAIL} OR pct <= {TAIL} THEN 1 ELSE 0 END AS y_ext, {', '.join(f'{value(c)} AS {c}' for c in FEATURES)}
  FROM z JOIN lab USING (date, ticker)),
ls AS MATERIALIZED ({' UNION ALL '.join(f'SELECT id, {i} AS f, {c} AS x FROM al' for i, c in enumerate([*FEATURES, LEAK]))}),
base AS (SELECT id, y, 1.0 AS w, learns FROM al),{bins_sql('', 'base')}"""
HONEST = f"f < {len(FEATURES)}"


def grow_sql(tag: str, rows: str, feats: str = HONEST, classes: int = 3, rounds: int = ROUNDS, depth: int = DEPTH, bins: str = "bn") -> str:
    """Rounds of boosting of the rows (id, y, w, learns): ``{tag}m{i}`` margins after i rounds, ``{tag}s{i}_{level}`` splits, ``{tag}l{i}`` leaves."""
    part = lambda g, h: f"({g}) * ({g}) / ({h} + {PENALTY})"
    out = f""",
{tag}m0 AS MATERIALIZED (SELECT id, y, w, learns, k, 0.0::DOUBLE AS m FROM {rows}, (SELECT unnest(range({classes})) AS k))"""
    for i in range(rounds):
        out += f""",
{tag}p{i} AS (SELECT *, exp(m) / sum(exp(m)) OVER (PARTITION BY id) AS p FROM {tag}m{i}),
{tag}n{i}_0 AS MATERIALIZED (SELECT id, y, w, learns, k, m, w * (p - CASE WHEN y = k THEN 1 ELSE 0 END) AS g, w * greatest(p * (1 - p), 1e-16) AS h, 0 AS node FROM {tag}p{i})"""
        for level in range(depth):
            v = f"{i}_{level}"
            out += f""",
{tag}h{v} AS (SELECT k, node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {tag}n{v} JOIN {bins} USING (id) WHERE learns AND {feats} GROUP BY ALL),
{tag}c{v} AS (SELECT *, sum(g) OVER a AS lg, sum(h) OVER a AS lh, sum(n) OVER a AS ln, sum(g) OVER b AS ag, sum(h) OVER b AS ah, sum(n) OVER b AS an
  FROM {tag}h{v} WINDOW a AS (PARTITION BY k, node, f ORDER BY bin), b AS (PARTITION BY k, node, f)),
{tag}v{v} AS (SELECT *, round({part('lg', 'lh')} + {part('ag - lg', 'ah - lh')} - {part('ag', 'ah')}, 9) AS gain FROM {tag}c{v}),
{tag}s{v} AS MATERIALIZED (SELECT k, node, f, bin AS cut, gain FROM {tag}v{v} WHERE ln < an AND lh >= {LEAST} AND ah - lh >= {LEAST} AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, bin) = 1),
{tag}n{i}_{level + 1} AS MATERIALIZED (SELECT n.id, n.y, n.w, n.learns, n.k, n.m, n.g, n.h, 2 * n.node + CASE WHEN bin > cut THEN 1 ELSE 0 END AS node
  FROM {tag}n{v} n LEFT JOIN {tag}s{v} s ON s.k = n.k AND s.node = n.node LEFT JOIN {bins} b ON b.id = n.id AND b.f = s.f)"""
        out += f""",
{tag}l{i} AS MATERIALIZED (SELECT k, node, -{RATE} * sum(g) / (sum(h) + {PENALTY}) AS leaf FROM {tag}n{i}_{depth} WHERE learns GROUP BY k, node),
{tag}m{i + 1} AS MATERIALIZED (SELECT n.id, n.y, n.w, n.learns, n.k, n.m + coalesce(leaf, 0) AS m FROM {tag}n{i}_{depth} n LEFT JOIN {tag}l{i} l ON l.k = n.k AND l.node = n.node)"""
    return out


def probs_sql(margins: str, out: str, classes: int = 3) -> str:
    """``out``: id, y and a probability for each class of the rows that do not learn."""
    picks = ", ".join(f"max(p) FILTER (k = {k}) AS p{k}" for k in range(classes))
    return f"{out} AS MATERIALIZED (SELECT id, y, {picks} FROM (SELECT id, y, k, exp(m) / sum(exp(m)) OVER (PARTITION BY id) AS p FROM {margins} WHERE NOT learns) GROUP BY id, y)"


def called_sql(margins: str, out: str) -> str:
    """``out``: target and call of the rows that do not learn."""
    return f"{probs_sql(margins, out + 'p')}, {out} AS MATERIALIZED (SELECT y AS target, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS call FROM {out}p)"


GROWN = BINNED + grow_sql("", "base")
LEAVES = " UNION ALL ".join(f'SELECT {i} AS round, k AS class, node AS leaf, leaf AS v FROM l{i}' for i in range(ROUNDS))


@query("M3", f"{GROWN} SELECT round, class, leaf, {r('v', 'value')} FROM ({LEAVES}) WHERE v <> 0")
def boosted_leaves(spark, sf):
    """Leaf values of the first rounds of boosting on all 42 features."""
    train, _ = halves(spark, sf)
    return G.leaf_table(spark, G.fit(train, FEATURES, **SETTINGS)).filter("value <> 0")


SPLITS = " UNION ALL ".join(f"SELECT {i} AS round, k AS class, {2**lv - 1} + node AS node, f, cut FROM s{i}_{lv}" for i in range(ROUNDS) for lv in range(DEPTH))


@query("M3 M16", f"""{GROWN}, sp AS ({SPLITS}), nm AS (SELECT unnest(range({len(FEATURES)})) AS f, unnest({FEATURES}) AS feature)
SELECT round, class, node, feature, {r('CASE WHEN cut > 0 THEN list_sort(cuts)[cut] END', 'up_to')} FROM sp JOIN nm USING (f) JOIN ct USING (f)""")
def boosted_splits(spark, sf):
    """Every split of the first rounds: node, feature, and the value up to which rows go left."""
    train, _ = halves(spark, sf)
    return G.split_table(spark, G.fit(train, FEATURES, **SETTINGS))


PROBS = f"{GROWN}, {probs_sql(f'm{ROUNDS}', 'sr')}"


@query("M3 M6 M7", f"{PROBS} SELECT date, ticker, {rs('p0', 'p1', 'p2')}, {r('p2 - p0', 'score')} FROM sr JOIN al USING (id)")
def boosted_probabilities(spark, sf):
    """Class probabilities of held-out rows."""
    train, test = halves(spark, sf)
    return G.fit(train, FEATURES, **SETTINGS).score(test).select("date", "ticker", "p0", "p1", "p2", "score")


GAINS = "gn AS (" + " UNION ALL ".join(f"SELECT f, gain FROM s{i}_{lv}" for i in range(ROUNDS) for lv in range(DEPTH)) + ")"
NAMES = f"nm AS (SELECT unnest(range({len(FEATURES)})) AS f, unnest({FEATURES}) AS feature)"


@query("M16", f"""{GROWN}, {GAINS}, {NAMES}
SELECT feature, {r('coalesce(sum(gain), 0) / (SELECT sum(gain) FROM gn)', 'share')} FROM nm LEFT JOIN gn USING (f) GROUP BY feature""")
def boosted_gain_shares(spark, sf):
    """Share of all gain for each of the 42 features."""
    train, _ = halves(spark, sf)
    return spark.createDataFrame(G.fit(train, FEATURES, **SETTINGS).importance(), "feature string, share double")


def metrics(df, **named):
    return V.class_metrics(df, "target", "prediction").select(*[F.lit(v).alias(k) for k, v in named.items()], "n", "accuracy", "macro_f1")


def union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _row(called: str, **named) -> str:
    return f"SELECT {', '.join(f'{v} AS {k}' for k, v in named.items())}, n, accuracy, macro_f1 FROM {metrics_sql(called, 'target', 'call')}"


TWO = f"""{BINNED}, ow AS (SELECT count(*) FILTER (y_ext = 0) * 1.0 / count(*) FILTER (y_ext = 1) AS w FROM al WHERE learns),
ge AS MATERIALIZED (SELECT id, y_ext AS y, CASE WHEN y_ext = 1 THEN ow.w ELSE 1.0 END AS w, learns FROM al, ow),
dr AS MATERIALIZED (SELECT id, y_top AS y, 1.0 AS w, learns AND y_ext = 1 AS learns, learns AS early FROM al),{bins_sql('d_', 'dr')}{grow_sql('g_', 'ge', classes=2)}{grow_sql('d_', 'dr', classes=2, bins='d_bn')},
{probs_sql(f'g_m{ROUNDS}', 'gp', 2)}, {probs_sql(f'd_m{ROUNDS}', 'dp', 2)}"""


@query("M4", f"""{TWO} SELECT date, ticker, {r('g.p1', 'p_ext')}, {r('d.p1', 'p_dir')}, {r('g.p1 * (2 * d.p1 - 1)', 'score')} FROM gp g JOIN dp d USING (id) JOIN al USING (id)""")
def two_stage_scores(spark, sf):
    """Scores of a weighted extreme gate times a direction model of the extremes, on held-out rows."""
    train, test = halves(spark, sf)
    return G.two_stage(train, FEATURES, **SETTINGS).score(test).select("date", "ticker", "p_ext", "p_dir", "score")


DEPTHS = [2, 3]
SEARCH = BINNED + "".join(grow_sql(f"q{d}_", "base", depth=d) for d in DEPTHS) + "".join(
    f", {called_sql(f'q{d}_m{n}', f'cl{d}_{n}')}" for d in DEPTHS for n in range(1, ROUNDS + 1))


@query("M15", f"{SEARCH} " + " UNION ALL ".join(_row(f"cl{d}_{n}", rounds=n, depth=d) for d in DEPTHS for n in range(1, ROUNDS + 1)))
def grid_search(spark, sf):
    """Held-out metrics for every number of rounds and depth; a fit of more rounds contains those of fewer."""
    train, test = halves(spark, sf)
    parts = []
    for d in DEPTHS:
        model = G.fit(train, FEATURES, **SETTINGS | {"depth": d})
        parts += [metrics(model.first(n).score(test), rounds=n, depth=d) for n in range(1, ROUNDS + 1)]
    return union(parts)


DROPS = [0, 1, 2]
ABLATED = f"""{GROWN}, {GAINS}, {NAMES}, gr AS MATERIALIZED (SELECT f, row_number() OVER (ORDER BY coalesce(sum(gain), 0) DESC, feature) AS place FROM nm LEFT JOIN gn USING (f) GROUP BY f, feature)""" + "".join(
    grow_sql(f"a{n}_", "base", f"{HONEST} AND f NOT IN (SELECT f FROM gr WHERE place <= {n})") + f", {called_sql(f'a{n}_m{ROUNDS}', f'cl{n}')}" for n in DROPS)


@query("M15 M16", f"{ABLATED} " + " UNION ALL ".join(_row(f"cl{n}", feature_set=f"'without_top_{n}'", n_features=len(FEATURES) - n) for n in DROPS))
def feature_ablation(spark, sf):
    """Held-out metrics of all 42 features, and without the one and the two that bring the most gain."""
    train, test = halves(spark, sf)
    full = G.fit(train, FEATURES, **SETTINGS)
    parts = []
    for n in DROPS:
        kept = M.drop_top(FEATURES, full, n)
        model = full if n == 0 else G.fit(train, kept, **SETTINGS)
        parts.append(metrics(model.score(test), feature_set=f"without_top_{n}", n_features=len(kept)))
    return union(parts)


CHECKED = f"""{BINNED}, pi AS (SELECT id, date, row_number() OVER (PARTITION BY date ORDER BY {_h('', ('ticker', 'date'))}, ticker) AS i FROM al),
pj AS (SELECT date, y, row_number() OVER (PARTITION BY date ORDER BY {_h('shuffle', ('ticker', 'date'))}, ticker) AS i FROM al),
sh AS MATERIALIZED (SELECT al.id, CASE WHEN al.learns THEN pj.y ELSE al.y END AS y, 1.0 AS w, al.learns FROM al JOIN pi ON pi.id = al.id JOIN pj ON pj.date = pi.date AND pj.i = pi.i)""" + (
    grow_sql("h_", "base") + grow_sql("x_", "base", "true") + grow_sql("z_", "sh")
    + "".join(f", {called_sql(f'{t}_m{ROUNDS}', f'cl{t}')}" for t in "hxz"))


@query("E24 P13", f"""{CHECKED}, ac AS (SELECT (SELECT accuracy FROM {metrics_sql('clh', 'target', 'call')}) AS h, (SELECT accuracy FROM {metrics_sql('clx', 'target', 'call')}) AS x,
  (SELECT accuracy FROM {metrics_sql('clz', 'target', 'call')}) AS z, (SELECT max(n) * 1.0 / sum(n) FROM (SELECT count(*) AS n FROM al WHERE NOT learns GROUP BY y)) AS top)
SELECT 'planted_leak' AS "check", x AS accuracy, h AS reference FROM ac UNION ALL SELECT 'shuffled_label', z, {r('top', 'reference')} FROM ac""")
def leak_checks(spark, sf):
    """A permuted label must score like the majority class; a planted outcome column must stand out."""
    train, test = halves(spark, sf)
    fit = lambda t, f: G.fit(t, f, **SETTINGS)
    return M.shuffled_label_accuracy(train, test, FEATURES, fit).unionByName(M.planted_leak_accuracy(train, test, FEATURES, fit, LEAK))
