"""Distributed boosting against a plain version that looks at every split of every node."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import boosting as G


def plain(x, y, w, cuts, classes, rounds, depth, rate, penalty, least):
    """Margins of all rows and leaf values, by loops."""
    bins = np.zeros(x.shape, int)
    for f, c in enumerate(cuts):
        for i, v in enumerate(x[:, f]):
            bins[i, f] = 0 if np.isnan(v) else 1 + sum(e < v for e in c)
    margin, leaves = np.zeros((len(y), classes)), []
    part = lambda g, h: g * g / (h + penalty)
    for _ in range(rounds):
        e = np.exp(margin)
        p = e / e.sum(1, keepdims=True)
        new = margin.copy()
        for k in range(classes):
            g, h = w * (p[:, k] - (y == k)), w * np.maximum(p[:, k] * (1 - p[:, k]), 1e-16)
            nodes = {0: np.arange(len(y))}
            for _ in range(depth):
                below = {}
                for node, rows in nodes.items():
                    best = None
                    for f in range(x.shape[1]):
                        for b in sorted(set(bins[rows, f]))[:-1]:
                            left = rows[bins[rows, f] <= b]
                            lg, lh, ag, ah = g[left].sum(), h[left].sum(), g[rows].sum(), h[rows].sum()
                            value = round(part(lg, lh) + part(ag - lg, ah - lh) - part(ag, ah), 9)
                            if lh >= least and ah - lh >= least and value > 0 and (best is None or value > best[0]):
                                best = (value, f, b)
                    if best is None:
                        below[2 * node] = rows
                    else:
                        on = bins[rows, best[1]] > best[2]
                        below[2 * node], below[2 * node + 1] = rows[~on], rows[on]
                nodes = below
            for node, rows in nodes.items():
                v = -rate * g[rows].sum() / (h[rows].sum() + penalty)
                leaves.append((len(leaves), k, node, v))
                new[rows, k] += v
        margin = new
    return margin, leaves


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5)).round(2)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 4] = 1.0  # a constant
    z = np.nan_to_num(x)
    y = np.where(z[:, 0] + z[:, 1] ** 2 > 1, 2, np.where(z[:, 2] > 0, 1, 0))
    return x, y, rng.uniform(0.5, 2, 600)


def frame(spark, x, y, w):
    pdf = pd.DataFrame(x, columns=list("abcde")).assign(target=y, w=w, n=np.arange(len(y)))
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, e double, target int, w double, n long").repartition(5)


@pytest.mark.parametrize("classes,weight,keep_every", [(3, None, 8), (3, "w", 1), (2, "w", 2)])
def test_fit_equals_a_plain_one(spark, rows, classes, weight, keep_every):
    x, y, w = rows
    y = np.minimum(y, classes - 1)
    df = frame(spark, x, y, w)
    model = G.fit(df, list("abcde"), weight=weight, classes=classes, rounds=3, depth=2, rate=0.4, subsample=1.0, colsample=1.0, bins=6, keep_every=keep_every)
    margin, leaves = plain(x, y, w if weight else np.ones(len(y)), model.cuts, classes, 3, 2, 0.4, 1.0, 1.0)
    want = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
    names = [f"p{k}" for k in range(classes)]
    got = model.probabilities(df, names).orderBy("n").select(*names).toPandas().to_numpy()
    assert np.allclose(got, want, atol=1e-9)
    table = G.leaf_table(spark, model).filter("value <> 0").toPandas()
    assert np.allclose(sorted(table["value"]), sorted(v for *_, v in leaves))
    assert "e" not in [f for f, share in model.importance() if share > 0]


def test_draws_repeat_and_learn(spark, rows):
    x, y, w = rows
    df = frame(spark, x, y, w)
    fit = lambda: G.fit(df, list("abcd"), rounds=8, depth=3, rate=0.5, subsample=0.7, colsample=0.5, keep_every=3)
    one, two = fit(), fit()
    assert all(np.array_equal(a.cut, b.cut) and np.allclose(a.leaf, b.leaf) for r, s in zip(one.trees, two.trees) for a, b in zip(r, s))
    right = one.score(df).filter("prediction = target").count()
    assert right > 450 and len(one.first(2).trees) == 2


def test_odd_tables(spark, rows):
    df = frame(spark, *rows)
    with pytest.raises(G.MissingColumns):
        G.fit(df.limit(50), ["a"], rounds=1, depth=1).score(df.drop("a"))
    nothing = G.fit(df.limit(0), ["a", "b"], rounds=2, depth=2)
    assert {round(v, 6) for r in nothing.score(df.limit(3)).select("p0", "p1", "p2").collect() for v in r} == {round(1 / 3, 6)}
    blank = df.withColumn("a", F.lit(None).cast("double")).withColumn("target", F.when(F.col("n") % 2 == 0, F.col("target")))
    model = G.fit(blank, ["a", "b"], rounds=1, depth=2, bins=4)
    assert model.cuts[0].size == 0 and model.score(blank).count() == 600
    with pytest.raises(ValueError):
        G.fit(df, ["a"], bins=300)


def test_cuts_are_exact_and_no_task_reads_all(spark, monkeypatch):
    monkeypatch.setattr(G, "FEW", 200)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4_000, 5))
    x[:, 1] = np.round(x[:, 1], 1)
    x[:, 2] = 7.0 + x[:, 2] * 1e-12  # differ in their last bits alone
    x[:, 3] = np.where(rng.random(4_000) < 0.5, -0.0, np.where(rng.random(4_000) < 0.5, np.inf, -np.inf))
    x[:, 4] = np.nan
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(7)
    got = G.quantile_cuts(df, names, 16, 100)
    for f in range(5):
        v = np.sort(x[:, f][~np.isnan(x[:, f])]) + 0.0
        want = np.unique([v[max(0, -(-k * len(v) // 16) - 1)] for k in range(1, 16)]) if len(v) else np.zeros(0)
        assert got[f].tolist() == want.tolist()
    cells = G._cells(df.selectExpr("array(f0) AS x"), 1, 0, G.FIRST_BITS, [np.zeros(1, np.int64)])
    assert cells.agg(F.sum("n")).first()[0] == int(np.sum(~np.isnan(x[:, 0]))) and cells.count() < 100
