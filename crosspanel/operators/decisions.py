"""From class probabilities to scores, calls and costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.expr import clip, pearson, safe_div
from crosspanel.operators import cross as X
from crosspanel.operators import evaluate as V

P = ("p0", "p1", "p2")

# fixed values: cost of calling column class when row class is true
COST_QUADRATIC = ((0, 1, 4), (1, 0, 1), (4, 1, 0))
COST_AGGRESSIVE = ((0, 2, 6), (1, 0, 1), (6, 2, 0))


def first_best(columns: Sequence, smallest: bool = False) -> Column:
    """Index of the largest (or smallest) of several columns, the first on a tie."""
    a = F.array(*columns)
    pick = F.array_min(a) if smallest else F.array_max(a)
    return (F.array_position(a, pick) - 1).cast("int")


def score_columns(p: Sequence[str] = P) -> dict[str, Column]:
    """score = P(over) - P(under), prediction = most likely class, confidence = its probability."""
    return {
        "score": F.col(p[2]) - F.col(p[0]),
        "prediction": first_best([F.col(c) for c in p]),
        "confidence": F.greatest(*[F.col(c) for c in p]),
    }


def two_stage(p_ext: str, p_dir: str) -> dict[str, Column]:
    """Score and three-class probabilities from an extreme gate and a direction model."""
    e, d = F.col(p_ext), F.col(p_dir)
    return {"score": e * (2 * d - 1), "p0": e * (1 - d), "p1": 1 - e, "p2": e * d}


def expected_costs(p: Sequence[str], cost) -> list[Column]:
    return [
        sum((F.col(p[k]) * float(cost[k][c]) for k in range(1, len(p))), F.col(p[0]) * float(cost[0][c]))
        for c in range(len(cost[0]))
    ]


def bayes_call(p: Sequence[str], cost) -> Column:
    """Class with the lowest expected cost."""
    return first_best(expected_costs(p, cost), smallest=True)


def realised_cost(y, call, cost) -> Column:
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in cost])
    y, call = (F.col(c) if isinstance(c, str) else c for c in (y, call))
    return F.element_at(F.element_at(rows, y.cast("int") + 1), call.cast("int") + 1)


def gated_calls(df: DataFrame, conviction: str, k: float, group_rows: int | None = None) -> DataFrame:
    """Each day's most convinced share k (at least one row)."""
    n = F.greatest(F.floor(F.col(X.GROUP_SIZE) * k), F.lit(1))
    return X.top_n(df, X.DATE, conviction, n, group_rows=group_rows)


def conviction_direction(df: DataFrame, s: str, group_rows: int | None = None) -> DataFrame:
    """Distance from the day's median score as conviction, its side as direction."""
    df = X.group_median(df, X.DATE, {"_med": s}, group_rows)
    return df.withColumns({
        "conviction": F.abs(F.col(s) - F.col("_med")),
        "direction": F.when(F.col(s) >= F.col("_med"), 2).otherwise(0)}).drop("_med")


def saving_direction(p: Sequence[str], cost) -> dict[str, Column]:
    """How much cheaper the better tail call is than calling neutral, and which tail."""
    under, neutral, over = expected_costs(p, cost)
    return {"saving": neutral - F.least(under, over), "direction": F.when(over < under, 2).otherwise(0)}


def abstain_below(p: Sequence[str], threshold: float) -> Column:
    """Most likely class, neutral when it is not likely enough."""
    return F.when(F.greatest(*[F.col(c) for c in p]) < threshold, 1).otherwise(first_best([F.col(c) for c in p]))


def abstain_margin(p: Sequence[str], margin: float = 0.05) -> Column:
    """Most likely class, neutral when the two tails are too close."""
    return F.when(F.abs(F.col(p[2]) - F.col(p[0])) < margin, 1).otherwise(first_best([F.col(c) for c in p]))


def direction_cutoffs(p_ext: str, p_dir: str, gate: float, lo: float, hi: float) -> Column:
    """Neutral unless the gate opens and the direction is clear."""
    d = F.col(p_dir)
    return F.when(F.col(p_ext) < gate, 1).when(d >= hi, 2).when(d <= lo, 0).otherwise(1)


def abstention_table(df: DataFrame, y: str, p: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Class metrics and share of calls for a list of probability thresholds."""
    # a handful of thresholds: every row is evaluated under each
    df = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    best = first_best([F.col(c) for c in p])
    call = F.when(F.greatest(*[F.col(c) for c in p]) < F.col("threshold"), 1).otherwise(best)
    df = df.withColumn("_call", call)
    share = df.groupBy("threshold").agg(F.avg((F.col("_call") != 1).cast("double")).alias("call_share"))
    return V.class_metrics(df, y, "_call", ["threshold"]).select("threshold", "n", "accuracy", "macro_f1").join(share, "threshold")


def tune_threshold(df: DataFrame, y: str, p: str, grid: Sequence[float]) -> DataFrame:
    """F1 of calling positive at or above each threshold; one row, the best (lowest on a tie)."""
    items = []
    for g in grid:
        called, pos = F.col(p) >= float(g), F.col(y) == 1
        tp = F.count(F.when(called & pos, 1)).cast("double")
        f1 = F.coalesce(safe_div(2 * tp, F.count(F.when(called, 1)) + F.count(F.when(pos, 1))), F.lit(0.0))
        items.append(F.struct(f1.alias("f1"), F.lit(-float(g)).alias("neg"), F.lit(float(g)).alias("threshold")))
    best = df.agg(F.array_max(F.array(*items)).alias("b"))
    return best.select("b.threshold", "b.f1")


def blend_weights(
    df: DataFrame, a: str, b: str, rel: str, weights: Sequence[float], group_rows: int | None = None
) -> DataFrame:
    """Mean daily rank IC of w * z(a) + (1 - w) * z(b) for every weight."""
    z = X.zscore(df, X.DATE, {"_za": a, "_zb": b}, flat="one", group_rows=group_rows)
    # which rows are known, and the ranks of the outcome, do not depend on the weight
    z = z.select("date", rel, "_za", "_zb").dropna()
    z = X.average_rank(z, X.DATE, {"_rr": rel}, group_rows)
    z = z.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    z = z.withColumn("_s", F.col("weight") * F.col("_za") + (1 - F.col("weight")) * F.col("_zb"))
    ranked = X.average_rank(z.select("weight", "date", "_s", "_rr"), ["weight", "date"], {"_rs": "_s"}, group_rows)
    ic = ranked.groupBy("weight", "date").agg(pearson("_rs", "_rr").alias("ic"))
    return ic.groupBy("weight").agg(F.avg("ic").alias("mean_ic"))


def blend(df: DataFrame, a: str, b: str, weight: float, out: str = "score", group_rows=None) -> DataFrame:
    z = X.zscore(df, X.DATE, {"_za": a, "_zb": b}, flat="one", group_rows=group_rows)
    return z.withColumn(out, weight * F.col("_za") + (1 - weight) * F.col("_zb")).drop("_za", "_zb")


def soft_vote(models: Sequence[Sequence[str]], out: Sequence[str] = P) -> dict[str, Column]:
    """Mean of several models' class probabilities."""
    n = len(models)
    return {
        o: sum((F.col(m[i]) for m in models[1:]), F.col(models[0][i])) / n for i, o in enumerate(out)
    }


def seed_mean(df: DataFrame, keys: Sequence[str], p: Sequence[str] = P) -> DataFrame:
    """Mean probabilities over repeated runs, then score and prediction."""
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in p])
    return out.withColumns(score_columns(p))


def rescale(df: DataFrame, x: str, out: str) -> DataFrame:
    """x mapped to [0, 1] by the table's minimum and maximum."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    return df.withColumn(out, safe_div(F.col(x) - lo, hi - lo))


def fit_stats(train: DataFrame, features: Sequence[str], rows: int | None = None) -> DataFrame:
    """Median, mean and deviation per feature, from training rows only (one row per feature)."""
    long = train.unpivot([], list(features), "feature", "x")
    moments = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    medians = X.quantiles(long, ["feature"], "x", {"median": 0.5}, rows)
    return moments.join(medians, "feature")


def apply_stats(df: DataFrame, stats: Mapping[str, tuple[float, float, float]], bound: float = 5.0) -> DataFrame:
    """Fill with the median, standardise, clip, and put 0 where still unknown.

    ``stats`` maps feature -> (median, mean, std); a zero deviation counts as one.
    """
    added = {}
    for f, (median, mean, std) in stats.items():
        filled = F.coalesce(F.col(f), F.lit(median)) if median is not None else F.col(f)
        if mean is None:
            added[f] = F.lit(0.0)
            continue
        z = (filled - mean) / (std if std else 1.0)
        added[f] = F.coalesce(clip(z, -bound, bound), F.lit(0.0))
    return df.withColumns(added)


def collect_stats(stats: DataFrame) -> dict[str, tuple[float, float, float]]:
    """The fitted numbers as a dictionary: one entry per feature name."""
    return {r["feature"]: (r["median"], r["mean"], r["std"]) for r in stats.collect()}
