"""Linear fits by normal equations against NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import linear as N


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 4)) * [1, 10, 0.1, 0] + [0, 5, 0, 3]
    x[rng.random(x.shape) < 0.05] = np.nan
    z = np.nan_to_num(x)
    y = np.where(z[:, 0] + rng.normal(size=900) > 0.5, 2, np.where(z[:, 1] > 5, 1, 0))
    return x, y, rng.uniform(0.2, 3, 900), rng.integers(0, 3, 900)


def frame(spark, rows):
    x, y, w, g = rows
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(target=y, w=w, g=g, n=np.arange(900))
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, target int, w double, g int, n long").repartition(5)


def design(x):
    median, mean, std = np.nanmedian(x, 0), np.nanmean(x, 0), np.nanstd(x, 0, ddof=1)
    z = np.clip((np.where(np.isnan(x), median, x) - mean) / np.where(std > 0, std, 1), -5, 5)
    return np.concatenate([np.ones((len(x), 1)), z], 1)


def plain_ridge(z, y, w, reg):
    p = np.diag([0.0] + [reg * w.sum()] * (z.shape[1] - 1))
    return np.linalg.solve((z * w[:, None]).T @ z + p, (z * w[:, None]).T @ y)


def plain_gradient(theta, z, y, w, reg):
    m = np.concatenate([np.zeros((len(z), 1)), z @ theta.T], 1)
    p = np.exp(m) / np.exp(m).sum(1, keepdims=True)
    grad = np.stack([(w * (p[:, k] - (y == k))) @ z for k in range(1, m.shape[1])])
    grad[:, 1:] += reg * w.sum() * theta[:, 1:]
    return grad


@pytest.mark.parametrize("weight", [None, "w"])
def test_ridge(spark, rows, weight):
    x, y, w, g = rows
    model = N.ridge(frame(spark, rows), list("abcd"), by="g", weight=weight, reg=0.01)
    for k in range(3):
        on = g == k
        want = plain_ridge(design(x[on]), y[on].astype(float), w[on] if weight else np.ones(on.sum()), 0.01)
        assert np.allclose(model.theta[k][0], want, atol=1e-9)
    got = model.predict(frame(spark, rows), by="g").orderBy("n").toPandas()
    assert np.allclose(got["prediction"][g == 1], design(x[g == 1]) @ model.theta[1][0])


@pytest.mark.parametrize("weight,classes", [(None, 3), ("w", 3), ("w", 2)])
def test_logistic_reaches_the_minimum(spark, rows, weight, classes):
    x, y, w, _ = rows
    y = np.minimum(y, classes - 1)
    df = frame(spark, (x, y, w, rows[3]))
    model = N.logistic(df, list("abcd"), weight=weight, classes=classes, reg=0.01)
    z, v = design(x), w if weight else np.ones(900)
    assert np.abs(plain_gradient(model.theta[0], z, y, v, 0.01)).max() < 1e-6
    names = [f"p{k}" for k in range(classes)]
    p = model.probabilities(df, out=names).orderBy("n").select(*names).toPandas().to_numpy()
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.6


def test_separable_classes_stay_finite(spark):
    df = spark.createDataFrame([(float(i), int(i > 50)) for i in range(100)], "a double, target int")
    model = N.logistic(df, ["a"], classes=2, reg=1e-6, steps=40)
    assert np.isfinite(model.theta[0]).all() and model.theta[0][0, 1] > 5


def test_solver(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 12))
    a = a @ a.T + np.eye(12)
    b = rng.normal(size=12)
    df = spark.createDataFrame([(np.concatenate([a, b[:, None]], 1).tolist(),)], "m array<array<double>>")
    assert np.allclose(df.select(N.solve(F.col("m")).alias("b")).first().b, np.linalg.solve(a, b))


def test_odd_rows(spark, rows):
    df = frame(spark, rows).withColumn("target", F.when(F.col("n") > 10, F.col("target"))).withColumn("e", F.lit(None).cast("double"))
    model = N.ridge(df, ["a", "e"], by="g")
    assert all(abs(t[0, 2]) < 1e-9 for t in model.theta.values())
    other = model.predict(df.withColumn("g", F.lit(9)), by="g")
    assert other.filter("prediction IS NOT NULL").count() == 0 and other.count() == 900
    with pytest.raises(N.MissingColumns):
        model.predict(df.drop("a"))


def test_expanding_folds(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-01-10')) AS date")
    folds = spark.sql("SELECT * FROM VALUES (1, DATE '2020-01-03'), (2, DATE '2020-01-07') AS t(fold, cut)")
    assert {r.fold: r["count"] for r in N.expanding(days, folds).groupBy("fold").count().collect()} == {1: 3, 2: 7}


def test_training_rows_are_computed_once_and_medians_are_exact(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = frame(spark, rows)
    model = N.ridge(df.mapInArrow(counted, df.schema), list("abcd"), by="g", reg=0.01)
    assert read.value == 900
    for k in range(3):
        assert np.allclose(model.stats[k][0], np.nanmedian(rows[0][rows[3] == k], 0), rtol=1e-15, atol=0)
