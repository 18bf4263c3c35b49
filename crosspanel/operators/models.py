"""Distributed training and scoring with Spark ML.

A model is a fitted pipeline plus the ordered list of its feature columns.
Training tables are written once (ML passes over them many times); folds come
from the calendar, so every fit is purged by the label's own horizon.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.operators import decisions as D
from crosspanel.operators import evaluate as V
from crosspanel.operators import splits as S
from crosspanel.session import discard, materialise


class MissingColumns(ValueError):
    """The table lacks columns the model was trained on."""


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline and the columns it needs, in order."""

    pipeline: PipelineModel
    features: tuple[str, ...]

    def check(self, df: DataFrame) -> None:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise MissingColumns(f"missing {len(missing)} feature column(s): {missing[:8]}")

    def transform(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return self.pipeline.transform(df)

    def probabilities(self, df: DataFrame, out: Sequence[str] = D.P) -> DataFrame:
        scored = self.transform(df).withColumn("_p", vector_to_array("probability"))
        made = ["_filled", "features", "_raw", "probability", "rawPrediction", "prediction", "_p"]
        named = scored.withColumns({c: F.col("_p")[i] for i, c in enumerate(out)})
        return named.drop(*made, *[f"_i_{f}" for f in self.features])

    def score(self, df: DataFrame) -> DataFrame:
        """Class probabilities with score, prediction and confidence."""
        return self.probabilities(df).withColumns(D.score_columns())

    def importance(self) -> list[tuple[str, float]]:
        values = self.pipeline.stages[-1].featureImportances.toArray()
        return sorted(zip(self.features, map(float, values)), key=lambda x: (-x[1], x[0]))


def _prepare(features: Sequence[str], scale: bool) -> list:
    """Fill missing values with the training median, collect into a vector, maybe standardise."""
    filled = [f"_i_{f}" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=0.0),
        VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "features", handleInvalid="error"),
    ]
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="features"))
    return stages


def _fit(train: DataFrame, features: Sequence[str], learner, scale: bool) -> Fitted:
    return Fitted(Pipeline(stages=[*_prepare(features, scale), learner]).fit(train), tuple(features))


def logistic(train: DataFrame, features: Sequence[str], label: str = "target", max_iter: int = 30, reg: float = 1e-4) -> Fitted:
    """Median fill, standardise, multinomial logistic regression."""
    learner = LogisticRegression(
        featuresCol="features", labelCol=label, family="multinomial", maxIter=max_iter, regParam=reg)
    return _fit(train, features, learner, True)


def forest(
    train: DataFrame, features: Sequence[str], label: str = "target", trees: int = 20, depth: int = 6, seed: int = 0
) -> Fitted:
    """Tree ensemble for three classes."""
    learner = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return _fit(train, features, learner, False)


def boosted(
    train: DataFrame, features: Sequence[str], label: str, weight: str | None = None, rounds: int = 10, depth: int = 4,
    seed: int = 0,
) -> Fitted:
    """Boosted trees for a binary label, with optional row weights."""
    learner = GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    if weight:
        learner = learner.setWeightCol(weight)
    return _fit(train, features, learner, False)


@dataclass(frozen=True)
class TwoStage:
    """An extreme-or-not gate and a direction model trained on extremes only."""

    gate: Fitted
    direction: Fitted

    def score(self, df: DataFrame) -> DataFrame:
        out = self.gate.probabilities(df, ("_p_calm", "p_ext"))
        out = self.direction.probabilities(out, ("_p_down", "p_dir")).drop("_p_calm", "_p_down")
        return out.withColumns(D.two_stage("p_ext", "p_dir"))


def two_stage(train: DataFrame, features: Sequence[str], rounds: int = 10, seed: int = 0) -> TwoStage:
    """``train`` carries y_ext and y_top. Positives of the gate weigh negatives / positives."""
    weight = S.positive_weight(train, "y_ext").scalar()
    weighted = train.withColumn("_w", F.when(F.col("y_ext") == 1, weight).otherwise(1.0))
    gate = boosted(materialise(weighted, "gate"), features, "y_ext", "_w", rounds, seed=seed)
    direction = boosted(train.filter(F.col("y_ext") == 1), features, "y_top", None, rounds, seed=seed)
    return TwoStage(gate, direction)


def ordinal_regression(train: DataFrame, features: Sequence[str], label: str = "target", trees: bool = False) -> Fitted:
    """Regress the class number; bucket the prediction with :func:`bucket`."""
    if trees:
        learner = GBTRegressor(featuresCol="features", labelCol=label, maxIter=10, maxDepth=4, seed=0)
        return _fit(train, features, learner, False)
    return _fit(train, features, LinearRegression(featuresCol="features", labelCol=label, regParam=1e-4), True)


def bucket(x: str = "prediction") -> Column:
    """Class from a regressed class number, cut at 0.5 and 1.5."""
    return F.when(F.col(x) < 0.5, 0).when(F.col(x) < 1.5, 1).otherwise(2)


# -- walk-forward ---------------------------------------------------------------------------

FitFn = Callable[[DataFrame, Sequence[str]], Fitted]


def walk_forward(
    df: DataFrame, features: Sequence[str], fit: FitFn, cal: DataFrame, years: Sequence[int], horizon: int,
    min_train: int = 1,
) -> DataFrame:
    """Out-of-sample scores of purged expanding folds (one fit per test year).

    The driver only loops over the few folds; every fit and every transform is distributed.
    """
    folds = S.folds(cal, years, horizon)
    S.assert_no_overlap(cal, folds, horizon)
    df = materialise(df, "training")
    out = None
    for f in folds.orderBy("fold").collect():  # one row per test year
        train = df.filter(F.col("date") <= F.lit(f["cut"]))
        if train.count() < min_train:
            continue
        test = df.filter(F.col("date").between(F.lit(f["test_start"]), F.lit(f["test_end"])))
        scored = fit(train, features).score(test).withColumn("fold", F.lit(f["fold"]))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no fold has enough training rows")
    return out


def fold_report(scored: DataFrame, label: str = "target", horizon: int | None = None) -> DataFrame:
    """Metrics per fold and pooled; with a horizon also on non-overlapping dates."""
    per = V.class_metrics(scored, label, "prediction", ["fold"]).select(F.col("fold").cast("string").alias("fold"), "n", "accuracy", "macro_f1")
    pooled = V.class_metrics(scored, label, "prediction").select(F.lit("pooled").alias("fold"), "n", "accuracy", "macro_f1")
    out = per.unionByName(pooled)
    if horizon:
        apart = V.class_metrics(S.non_overlapping(scored, horizon), label, "prediction")
        out = out.unionByName(apart.select(F.lit("non_overlapping").alias("fold"), "n", "accuracy", "macro_f1"))
    return out


def grid_search(
    train: DataFrame, valid: DataFrame, features: Sequence[str], make: Callable[..., Fitted], grid: Mapping[str, Sequence],
    label: str = "target",
) -> DataFrame:
    """Validation macro F1 of every combination of settings."""
    out = None
    for values in itertools.product(*grid.values()):
        settings = dict(zip(grid, values))
        scored = make(train, features, **settings).score(valid)
        row = V.class_metrics(scored, label, "prediction").select(
            *[F.lit(v).alias(k) for k, v in settings.items()], "n", "accuracy", "macro_f1")
        out = row if out is None else out.unionByName(row)
    return out


def ablation(
    train: DataFrame, valid: DataFrame, sets: Mapping[str, Sequence[str]], fit: FitFn, label: str = "target"
) -> DataFrame:
    """Validation metrics of several feature subsets."""
    out = None
    for name, features in sets.items():
        row = V.class_metrics(fit(train, features).score(valid), label, "prediction").select(
            F.lit(name).alias("feature_set"), F.lit(len(features)).alias("n_features"), "n", "accuracy", "macro_f1")
        out = row if out is None else out.unionByName(row)
    return out


def drop_top(features: Sequence[str], model: Fitted, n: int) -> list[str]:
    """The features without the model's n most important ones."""
    best = {name for name, _ in model.importance()[:n]}
    return [f for f in features if f not in best]


def importance_table(spark, model: Fitted) -> DataFrame:
    """Importance of every feature with its share of the total."""
    rows = model.importance()
    total = sum(v for _, v in rows) or 1.0
    return spark.createDataFrame([(n, v, v / total) for n, v in rows], "feature string, importance double, share double")


# -- wiring checks ----------------------------------------------------------------------------


def shuffled_label_accuracy(train: DataFrame, test: DataFrame, features: Sequence[str], fit: FitFn, label: str = "target") -> DataFrame:
    """Accuracy after permuting the label within each date, beside the majority share.

    Real signal does not survive the permutation.
    """
    # windows and join are all dealt by date, so the wide rows move once; the copy goes once it is learnt
    permuted = materialise(S.permute_within_date(train, label, "shuffle"), "shuffled", as_dealt=True)
    scored = fit(permuted, features).score(test)
    discard(permuted)
    counts = test.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    majority = counts.agg(F.max("_n") / F.sum("_n")).scalar()
    return V.class_metrics(scored, label, "prediction").select(
        F.lit("shuffled_label").alias("check"), "accuracy", majority.alias("reference"))


def planted_leak_accuracy(
    train: DataFrame, test: DataFrame, features: Sequence[str], fit: FitFn, leak: str = "rel", label: str = "target"
) -> DataFrame:
    """Accuracy with the outcome itself as a feature, beside the honest accuracy: it must jump."""
    honest = V.class_metrics(fit(train, features).score(test), label, "prediction")
    leaky = [*features, "_leak"]
    add = lambda df: df.withColumn("_leak", F.col(leak))
    canary = V.class_metrics(fit(add(train), leaky).score(add(test)), label, "prediction")
    return canary.select(F.lit("planted_leak").alias("check"), "accuracy", honest.select("accuracy").scalar().alias("reference"))
