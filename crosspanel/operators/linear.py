"""Linear fits by their normal equations: ridge regression and multinomial logistic regression by Newton steps.

Several groups (folds, say) are fitted in one pass. The rows are filled, standardised and written once; a pass then adds up products of
features in the tasks and sends one small matrix for each task and group. The systems are solved as arrays in Spark, one row
for each group, so nothing but the coefficients reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.operators import boosting as G
from crosspanel.operators import decisions as D
from crosspanel.operators.models import MissingColumns
from crosspanel.session import discard, materialise

#: Standardised values are clipped to this.
BOUND = 5.0


@dataclass(frozen=True)
class Linear:
    """Coefficients of each group: a row for each class after the first (one row for a regression), the intercept first."""

    features: tuple[str, ...]
    stats: dict[int, np.ndarray]  # group -> median, mean, deviation of each feature
    theta: dict[int, np.ndarray]
    classes: int  # 0: a regression

    def _scored(self, df: DataFrame, by: str | None, out: Sequence[str], fn) -> DataFrame:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise MissingColumns(f"missing {len(missing)} feature column(s): {missing[:8]}")
        shared = df.sparkSession.sparkContext.broadcast(self)  # a few numbers for each group and feature
        kept = [f for f in df.schema.fields if f.name not in out]
        group = F.col(by).cast("long") if by else F.lit(0).cast("long")
        source = df.select(*[F.col(f"`{f.name}`") for f in kept], group.alias("_g"), _raw(self.features).alias("_x"))
        schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in out]])

        def run(batches):
            m, n = shared.value, len(kept)
            for b in batches:
                keys, x = np.array(b.column(n).to_pylist(), object), _matrix(b.column(n + 1), len(m.features))
                values = np.full((b.num_rows, len(out)), np.nan)
                for g, theta in m.theta.items():
                    on = keys == g
                    values[on] = fn(standardised(x[on], m.stats[g]) @ theta.T)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(c, mask=np.isnan(c)) for c in values.T]], schema.names)

        return source.mapInArrow(run, schema)

    def predict(self, df: DataFrame, by: str | None = None, out: str = "prediction") -> DataFrame:
        """The rows with the regressed value; null in groups without a fit."""
        return self._scored(df, by, [out], lambda v: v)

    def probabilities(self, df: DataFrame, by: str | None = None, out: Sequence[str] = D.P) -> DataFrame:
        """The rows with one probability for each class; null in groups without a fit."""
        return self._scored(df, by, list(out), _softmax)

    def score(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Class probabilities with score, prediction and confidence."""
        return self.probabilities(df, by).withColumns(D.score_columns())

    def table(self, spark) -> DataFrame:
        """One row for each coefficient: group, class, feature ('' for the intercept), value."""
        rows = [(g, k + 1 if self.classes else 0, f, float(v)) for g, t in self.theta.items() for k, r in enumerate(t) for f, v in zip(["", *self.features], r)]
        return spark.createDataFrame(rows, "group long, class int, feature string, value double")


def _raw(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _softmax(margin: np.ndarray) -> np.ndarray:
    """Probabilities from the margins against the first class."""
    m = np.concatenate([np.zeros((len(margin), 1)), margin], 1)
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def standardised(x: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """1, then every feature filled with the median, standardised and clipped; 0 where still unknown."""
    median, mean, std = stats
    z = np.clip((np.where(np.isnan(x), median, x) - mean) / np.where(std > 0, std, 1.0), -BOUND, BOUND)
    return np.concatenate([np.ones((len(x), 1)), np.where(np.isnan(z), 0.0, z)], 1)


#: Columns whose medians are sought together.
TOGETHER = 256


def group_stats(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Median, mean and deviation of every feature in every group of rows (g, x); a few numbers each reach the driver.

    Medians are exact and come from counts of leading bits, so no row is moved or sorted for them.
    """
    x = [F.get("x", i) for i in range(width)]
    known = [F.count(F.when(c.isNotNull() & ~F.isnan(c), 1)).alias(f"n{i}") for i, c in enumerate(x)]
    moments = [m.alias(f"{k}{i}") for i, c in enumerate(x) for k, m in (("m", F.avg(c)), ("s", F.stddev_samp(c)))]
    found = {r["g"]: r for r in rows.filter("g IS NOT NULL").groupBy("g").agg(*known, *moments).collect()}
    number = lambda v: np.nan if v is None else v
    out = {g: np.array([[np.nan, number(r[f"m{i}"]), number(r[f"s{i}"])] for i in range(width)]).T for g, r in found.items()}
    groups, step = sorted(found), max(1, TOGETHER // width)
    for at in range(0, len(groups), step):
        part = groups[at : at + step]
        # a column for each group and feature, missing in the rows of other groups
        columns = rows.select(F.array(*[F.when(F.col("g") == g, c) for g in part for c in x]).alias("x"))
        sizes = [found[g][f"n{i}"] for g in part for i in range(width)]
        ranks = [(k, rank) for k, n in enumerate(sizes) if n for rank in {(n + 1) // 2, n // 2 + 1}]
        for k, values in enumerate(G.ranked_values(columns, len(sizes), ranks, sum(sizes))):
            if len(values):
                out[part[k // width]][0, k % width] = values[0] + 0.5 * (values[-1] - values[0])
    return out


def _numbered(train: DataFrame, features: Sequence[str], label: str, weight: str | None, by: str) -> DataFrame:
    """(g, y, w, x): what the fit reads of the rows, written once."""
    return materialise(train.select(
        F.col(by).cast("long").alias("g"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), _raw(features).alias("x")), "fitted")


def _written(raw: DataFrame, width: int, stats) -> DataFrame:
    """(g, y, w, z): the standardised rows with a label, written once."""
    shared = raw.sparkSession.sparkContext.broadcast(stats)
    named = raw.filter("y IS NOT NULL AND g IS NOT NULL")

    def run(batches):
        for b in batches:
            g, x = b.column(0).to_numpy(), _matrix(b.column(3), width)
            z = np.zeros((len(g), width + 1))
            for k in np.unique(g):
                z[g == k] = standardised(x[g == k], shared.value[k])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in z], pa.binary())], ["g", "y", "w", "z"])

    return materialise(named.mapInArrow(run, "g long, y double, w double, z binary"), "standardised")


CELL = "g long, i int, j int, s double"


def _sums(rows: DataFrame, width: int, size: int, fn) -> DataFrame:
    """Sums of the matrices that ``fn(group, y, weight, z)`` makes of blocks of rows: one matrix for each task and group before they meet.

    Such a matrix holds a system of ``size`` rows with its right side, and the loss in one row more.
    """

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            g, y, w = (b.column(c).to_numpy() for c in range(3))
            z = np.frombuffer(b"".join(b.column(3).to_pylist()), "<f8").reshape(-1, width)
            for k in np.unique(g):
                on = g == k
                total[k] = total.get(k, 0) + fn(int(k), y[on], w[on], z[on])
        i, j = (a.ravel().astype(np.int32) for a in np.indices((size + 1, size + 1)))
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k)), pa.array(i), pa.array(j), pa.array(m.ravel())], ["g", "i", "j", "s"])

    return rows.mapInArrow(run, CELL).groupBy("g", "i", "j").agg(F.sum("s").alias("s"))


def solve(m: Column) -> Column:
    """The solution of a positive definite system, given with its right side as a last column, by elimination on arrays."""
    one = lambda value, fn: F.element_at(F.transform(F.array(value), fn), 1)

    def eliminated(a: Column, k: Column) -> Column:
        def step(pivot_row):
            return one(F.transform(pivot_row, lambda x: x / F.element_at(pivot_row, k)), lambda r: F.transform(
                a, lambda row, i: F.when(i == k - 1, r).otherwise(F.zip_with(row, r, lambda x, y: x - F.element_at(row, k) * y))))
        return one(F.element_at(a, k), step)

    done = F.aggregate(F.sequence(F.lit(1), F.size(m)), m, eliminated)
    return F.transform(done, lambda row: F.element_at(row, -1))


def _solutions(cells: DataFrame, size: int) -> dict[int, tuple[np.ndarray, float]]:
    """The solution of each group's system, and its loss; only these reach the driver."""
    rows = cells.groupBy("g", "i", "j").agg(F.sum("s").alias("s")).groupBy("g", "i").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("r"))
    system = F.when(F.col("i") < size, F.struct("i", "r"))
    whole = rows.groupBy("g").agg(F.array_sort(F.collect_list(system)).alias("m"), F.max(F.when(F.col("i") == size, F.col("r")[0]["s"])).alias("loss"))
    m = F.transform("m", lambda row: F.transform(row["r"], lambda c: c["s"]))
    return {r.g: (np.array(r.b), r.loss) for r in whole.select("g", solve(m).alias("b"), "loss").collect()}


def _tagged(train: DataFrame, by: str | None) -> tuple[DataFrame, str]:
    return (train, by) if by else (train.withColumn("_group", F.lit(0).cast("long")), "_group")


def _penalties(spark, counts: dict[int, float], width: int, blocks: int, reg: float, theta=None) -> DataFrame:
    """Ridge terms of every coefficient but the intercepts: on the diagonal, and in the gradient."""
    size = width * blocks
    cells = [(g, i, i, reg * n) for g, n in counts.items() for i in range(size) if i % width]
    if theta is not None:
        cells += [(g, i, size, reg * n * float(theta[g].ravel()[i])) for g, n in counts.items() for i in range(size) if i % width]
    return spark.createDataFrame(cells, CELL)


def ridge(train: DataFrame, features: Sequence[str], label: str = "target", by: str | None = None, weight: str | None = None, reg: float = 1e-3) -> Linear:
    """Least squares on standardised features with the penalty ``reg`` on squared coefficients, in each group of ``by``."""
    train, by = _tagged(train, by)
    raw = _numbered(train, features, label, weight, by)
    stats = group_stats(raw, len(features))
    rows = _written(raw, len(features), stats)
    discard(raw)
    width = len(features) + 1
    counts = {r.g: r.n for r in rows.groupBy("g").agg(F.sum("w").alias("n")).collect()}

    def system(_, y, w, z):
        gram = (z * w[:, None]).T @ np.concatenate([z, y[:, None]], 1)
        return np.concatenate([gram, np.zeros((1, width + 1))])

    found = _solutions(_sums(rows, width, width, system).unionByName(_penalties(train.sparkSession, counts, width, 1, reg)), width)
    discard(rows)
    return Linear(tuple(features), stats, {g: b[None, :] for g, (b, _) in found.items()}, 0)


def logistic(
    train: DataFrame, features: Sequence[str], label: str = "target", by: str | None = None, weight: str | None = None, classes: int = 3, reg: float = 1e-3,
    steps: int = 20, tolerance: float = 1e-9,
) -> Linear:
    """Multinomial logistic regression in each group of ``by``: Newton steps, halved where the loss grows, until no coefficient moves.

    Class 0 is the one others are measured against. The penalty ``reg`` bears on squared coefficients; one pass over the rows for each step.
    """
    train, by = _tagged(train, by)
    spark = train.sparkSession
    raw = _numbered(train, features, label, weight, by)
    stats = group_stats(raw, len(features))
    rows = _written(raw, len(features), stats)
    discard(raw)
    width, blocks = len(features) + 1, classes - 1
    size = width * blocks
    counts = {r.g: r.n for r in rows.groupBy("g").agg(F.sum("w").alias("n")).collect()}
    theta = {g: np.zeros((blocks, width)) for g in counts}
    before, best = {}, {}

    for _ in range(steps):
        shared = spark.sparkContext.broadcast(dict(theta))

        def system(g, y, w, z):
            p = _softmax(z @ shared.value[g].T)
            out = np.zeros((size + 1, size + 1))
            out[size, 0] = -(w * np.log(np.maximum(p[np.arange(len(y)), y.astype(int)], 1e-300))).sum()
            for k in range(blocks):
                at = slice(k * width, (k + 1) * width)
                out[:size][at, size] = ((p[:, k + 1] - (y == k + 1)) * w) @ z
                for m in range(blocks):
                    v = w * p[:, k + 1] * ((k == m) - p[:, m + 1])
                    out[at, m * width : (m + 1) * width] = z.T @ (z * v[:, None])
            return out

        penalty = {g: 0.5 * reg * n * float((theta[g][:, 1:] ** 2).sum()) for g, n in counts.items()}
        found = _solutions(_sums(rows, width, size, system).unionByName(_penalties(spark, counts, width, blocks, reg, theta)), size)
        moved, loss = {g: b for g, (b, _) in found.items()}, {g: v + penalty[g] for g, (_, v) in found.items()}
        worse = {g for g in theta if g in before and loss[g] > before[g] * (1 + 1e-12) + 1e-12}
        change = 0.0
        for g in theta:
            if g in worse:
                step = (best[g] - theta[g]) / 2  # back half of the way
            else:
                before[g], best[g] = loss[g], theta[g]
                step = -moved[g].reshape(blocks, width)
            theta[g] = theta[g] + step
            change = max(change, float(np.abs(step).max()))
        if change < tolerance:
            break
    discard(rows)
    return Linear(tuple(features), stats, theta, classes)


def expanding(df: DataFrame, folds: DataFrame, fold: str = "fold") -> DataFrame:
    """The training rows of every fold: each row once for each fold whose cut it does not pass. Folds are few."""
    few = [(r[fold], r["cut"]) for r in folds.collect()]
    tags = F.filter(F.array(*[F.struct(F.lit(int(y)).cast("long").alias("y"), F.lit(c).alias("c")) for y, c in few]), lambda t: t["c"] >= F.col("date"))
    return df.withColumn(fold, F.explode(F.transform(tags, lambda t: t["y"])))
