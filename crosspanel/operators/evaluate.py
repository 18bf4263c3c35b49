"""Classification, ranking and leakage statistics of a scored panel.

Counts and moments are plain aggregates. Anything that needs an order over a
whole table (curves, deciles, quantile bins) goes through the cross-sectional
primitives, which split large groups by value range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.expr import pearson, safe_div
from crosspanel.operators import cross as X
from crosspanel.operators import rolling as R
from crosspanel.session import materialise

CLASSES = (0, 1, 2)


# -- confusion counts -------------------------------------------------------------------


def _cells(y: str, p: str, classes: Sequence[int]) -> list[Column]:
    return [
        F.count(F.when((F.col(y) == a) & (F.col(p) == b), 1)).alias(f"_{a}_{b}") for a in classes for b in classes
    ]


def _grouped(df: DataFrame, by: Sequence[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion(df: DataFrame, y: str, p: str, by: Sequence[str] = (), classes: Sequence[int] = CLASSES) -> DataFrame:
    """Every (actual, predicted) cell with count, row share and the predicted class's share."""
    wide = _grouped(df, by, _cells(y, p, classes))
    total = sum((F.col(f"_{a}_{b}") for a in classes for b in classes), F.lit(0))
    items = []
    for a in classes:
        row = sum((F.col(f"_{a}_{c}") for c in classes), F.lit(0))
        for b in classes:
            column = sum((F.col(f"_{c}_{b}") for c in classes), F.lit(0))
            items.append(F.struct(
                F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"_{a}_{b}").alias("n"),
                safe_div(F.col(f"_{a}_{b}").cast("double"), row).alias("row_share"),
                safe_div(column.cast("double"), total).alias("predicted_share")))
    return wide.select(*by, F.explode(F.array(*items)).alias("c")).select(*by, "c.*")


def class_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), classes: Sequence[int] = CLASSES) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy and per-class precision / recall / F1."""
    wide = _grouped(df, by, _cells(y, p, classes))
    cell = lambda a, b: F.col(f"_{a}_{b}").cast("double")
    total = sum((cell(a, b) for a in classes for b in classes), F.lit(0.0))
    hits = sum((cell(a, a) for a in classes), F.lit(0.0))
    per: dict[str, Column] = {}
    f1s, recalls = [], []
    for k in classes:
        actual = sum((cell(k, b) for b in classes), F.lit(0.0))
        called = sum((cell(a, k) for a in classes), F.lit(0.0))
        zero = F.lit(0.0)
        per[f"precision_{k}"] = F.coalesce(safe_div(cell(k, k), called), zero)
        per[f"recall_{k}"] = F.coalesce(safe_div(cell(k, k), actual), zero)
        per[f"f1_{k}"] = F.coalesce(safe_div(2 * cell(k, k), actual + called), zero)
        f1s.append(per[f"f1_{k}"])
        recalls.append(per[f"recall_{k}"])
    n = len(classes)
    return wide.select(
        *by, total.cast("long").alias("n"), safe_div(hits, total).alias("accuracy"),
        (sum(f1s[1:], f1s[0]) / n).alias("macro_f1"), (sum(recalls[1:], recalls[0]) / n).alias("balanced_accuracy"),
        *[c.alias(name) for name, c in per.items()],
    )


# -- curves -----------------------------------------------------------------------------


def _curve_steps(df: DataFrame, y: str, s: str, by: Sequence[str] = ()) -> DataFrame:
    known = df.filter(F.col(y).isNotNull() & F.col(s).isNotNull())
    return X.ladder(known, by, s, {"pos": F.col(y).cast("long")})


def roc_curve(df: DataFrame, y: str, s: str) -> DataFrame:
    """One point per distinct score: rates of rows scored at or above it."""
    st = _curve_steps(df, y, s)
    pos = F.col("pos_all") - F.col("pos_le") + F.col("pos")
    called = F.col("n_all") - F.col("n_le") + F.col("n")
    return st.select(
        F.col(s).alias("threshold"),
        safe_div(pos.cast("double"), "pos_all").alias("tpr"),
        safe_div((called - pos).cast("double"), F.col("n_all") - F.col("pos_all")).alias("fpr"),
    )


def rank_quality(df: DataFrame, y: str, s: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC with ties averaged and average precision, in one pass over the distinct scores."""
    st = _curve_steps(df, y, s, by)
    d = lambda c: F.col(c).cast("double")
    neg = d("n") - d("pos")
    above = d("pos_all") - d("pos_le")
    precision = (above + d("pos")) / (d("n_all") - d("n_le") + d("n"))
    out = _grouped(st, by, [
        F.max("n_all").alias("n"),
        F.sum(neg * (above + d("pos") / 2)).alias("_area"),
        F.max(d("pos_all") * (d("n_all") - d("pos_all"))).alias("_pairs"),
        F.sum(d("pos") * precision).alias("_ap"),
        F.max(d("pos_all")).alias("_pos"),
    ])
    return out.select(
        *by, "n", safe_div("_area", "_pairs").alias("auc"), safe_div("_ap", "_pos").alias("average_precision")
    )


# -- daily views ------------------------------------------------------------------------


def forced_terciles(df: DataFrame, s: str, out: str = "pred", first: bool = False, group_rows=None) -> DataFrame:
    """Classes by forcing each day's scores into thirds, by average or by first rank."""
    if first:
        return X.quantile_tile(df, X.DATE, s, out, 3, group_rows=group_rows)
    return X.pct_rank(df, X.DATE, {"_pct": s}, group_rows).withColumn(out, X.tercile_of("_pct")).drop("_pct")


def daily_rank_ic(
    df: DataFrame, s: str = "score", rel: str = "rel", by: Sequence[str] = (), min_rows: int = 1, group_rows=None
) -> DataFrame:
    """Spearman correlation of score and outcome per date."""
    keys = [*by, "date"]
    known = df.filter(F.col(s).isNotNull() & F.col(rel).isNotNull()).select(*keys, s, rel)
    ranked = X.average_rank(known, keys, {"_rs": s, "_rr": rel}, group_rows)
    ic = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_rs", "_rr").alias("ic"))
    return ic.filter((F.col("n") >= min_rows) & F.col("ic").isNotNull())


def ic_summary(ic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, ratio, t and share of positive days of an IC series."""
    sd, n = F.stddev_samp("ic"), F.count("ic")
    return _grouped(ic, by, [
        n.alias("days"), F.avg("ic").alias("mean_ic"), sd.alias("std_ic"),
        safe_div(F.avg("ic"), sd).alias("ir"), safe_div(F.avg("ic"), sd / F.sqrt(n)).alias("t"),
        F.avg((F.col("ic") > 0).cast("double")).alias("share_positive"),
    ])


def ic_rolling(ic: DataFrame, k: int) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(-(k - 1), 0)
    return ic.withColumn(f"ic_{k}", F.when(F.count("ic").over(w) >= k, F.avg("ic").over(w)))


def newey_west(series: DataFrame, lag: int, x: str = "ic", by: Sequence[str] = ()) -> DataFrame:
    """Mean of a dated series with a t-value robust to ``lag`` rows of overlap.

    The series has one row per date (and key); lagged products are window lags
    over it, weighted by the Bartlett kernel. Also the plain t and the lag-1
    autocorrelation.
    """
    keys = list(by)
    held = series.filter(F.col(x).isNotNull()).select(*keys, "date", F.col(x).alias("_x"))
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("date")
    held = held.withColumn("_e", F.col("_x") - F.avg("_x").over(whole))
    held = held.withColumns({f"_e{l}": F.lag("_e", l).over(ordered) for l in range(1, lag + 1)})
    held = held.withColumn("_before", F.lag("_x").over(ordered))
    n = F.count("_x").cast("double")
    spread = F.sum(F.col("_e") * F.col("_e")) / n
    for l in range(1, lag + 1):
        weight = 2 * (1 - l / (lag + 1))
        spread = spread + weight * F.coalesce(F.sum(F.col("_e") * F.col(f"_e{l}")), F.lit(0.0)) / n
    out = _grouped(held, keys, [
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.sqrt(F.when(spread > 0, spread) / n).alias("se"),
        safe_div(F.avg("_x"), F.stddev_samp("_x") / F.sqrt(n)).alias("t_iid"),
        pearson("_x", "_before").alias("autocorr1"),
        F.avg((F.col("_x") > 0).cast("double")).alias("share_positive"),
    ])
    return out.withColumn("t", safe_div("mean", "se"))


def precision_at_top(df: DataFrame, s: str, hit: str, rel: str, k: float, group_rows=None) -> DataFrame:
    """Hit rate and mean outcome of each day's best k share, averaged over days."""
    n = F.greatest(F.floor(F.col(X.GROUP_SIZE) * k), F.lit(1))
    picks = X.top_n(df, X.DATE, s, n, group_rows=group_rows)
    days = picks.groupBy("date").agg(F.avg(F.col(hit).cast("double")).alias("_p"), F.avg(rel).alias("_r"))
    return days.agg(F.count(F.lit(1)).alias("days"), F.avg("_p").alias("precision"), F.avg("_r").alias("mean_rel"))


def direction_quality(df: DataFrame, s: str, y: str, pred: str, rel: str, tail: float, group_rows=None) -> DataFrame:
    """Direction accuracy on the true tails, and how often tails are called the opposite."""
    df = X.pct_rank(df, X.DATE, {"_pct": rel}, group_rows)
    df = X.group_median(df, X.DATE, {"_med": s}, group_rows)
    call = F.when(F.col(s) >= F.col("_med"), 2).otherwise(0)
    tails = (F.col("_pct") >= 1 - tail) | (F.col("_pct") <= tail)
    count = lambda c: F.count(F.when(c, 1)).cast("double")
    return df.agg(
        safe_div(count(tails & (call == F.col(y))), count(tails)).alias("direction_accuracy"),
        safe_div(count((F.col(y) == 0) & (F.col(pred) == 2)), count(F.col(y) == 0)).alias("under_to_over"),
        safe_div(count((F.col(y) == 2) & (F.col(pred) == 0)), count(F.col(y) == 2)).alias("over_to_under"),
    )


def scorecard(calls: DataFrame, by: Sequence[str], direction: str, y: str, rel: str) -> DataFrame:
    """Outcome of directional calls: win rate, signed payoff, win/loss ratio, break-even rate, Sharpe."""
    pay = F.when(F.col(direction) == 2, F.col(rel)).otherwise(-F.col(rel))
    ratio = safe_div(F.avg(F.when(pay > 0, pay)), -F.avg(F.when(pay < 0, pay)))
    return _grouped(calls, by, [
        F.count(F.lit(1)).alias("n_calls"),
        F.avg((F.col(direction) == F.col(y)).cast("double")).alias("win_rate"),
        F.avg(pay).alias("mean_payoff"), ratio.alias("win_loss_ratio"),
        safe_div(F.lit(1.0), 1 + ratio).alias("breakeven_rate"),
        safe_div(F.avg(pay), F.stddev_pop(pay)).alias("sharpe"),
    ])


def selectivity_sweep(df: DataFrame, conviction: str, direction: str, y: str, rel: str, ks: Sequence[float], group_rows=None):
    """Scorecards of each day's most convinced k share, for several k at once."""
    ranked = X.ordinal(df, X.DATE, conviction, "_ord", True, group_rows=group_rows, size="_n")
    inside = [
        F.when(F.col("_ord") <= F.greatest(F.floor(F.col("_n") * float(k)), F.lit(1)), F.lit(float(k))) for k in ks
    ]
    hit = ranked.withColumn("k", F.explode(F.array_compact(F.array(*inside))))
    return scorecard(hit, ["k"], direction, y, rel)


def split_sweep(df: DataFrame, s: str, rel: str, tails: Sequence[float], cost: float, horizon: int, group_rows=None):
    """Label and call the same tail share t per day, for several t: F1s, hit rate, money."""
    df = X.pct_rank(df, X.DATE, {"_py": rel, "_ps": s}, group_rows)
    cut = lambda p, t: F.when(F.col(p) <= F.col(t), 0).when(F.col(p) >= 1 - F.col(t), 2).otherwise(1)
    df = df.select("date", rel, "_py", "_ps", F.explode(F.array(*[F.lit(float(t)) for t in tails])).alias("tail"))
    df = df.withColumns({"_y": cut("_py", "tail"), "_p": cut("_ps", "tail")})
    quality = class_metrics(df, "_y", "_p", ["tail"]).select(
        "tail", "macro_f1", F.col("f1_0").alias("f1_under"), F.col("f1_1").alias("f1_neutral"),
        F.col("f1_2").alias("f1_over"), F.col("precision_2").alias("prec_over"), F.col("precision_0").alias("prec_under"))
    gross = F.when(F.col("_p") == 2, F.col(rel)).otherwise(-F.col(rel))
    calls = df.filter(F.col("_p") != 1).withColumn("_g", gross)
    days = calls.groupBy("tail", "date").agg(
        F.avg("_g").alias("_day"), F.count(F.lit(1)).alias("_n"), F.sum("_g").alias("_sum"),
        F.sum((F.col("_g") > 0).cast("long")).alias("_hits"))
    year = 252 / horizon
    money = days.groupBy("tail").agg(
        F.avg("_n").alias("calls_per_day"), (F.sum("_hits") / F.sum("_n")).alias("hit_rate"),
        (F.sum("_sum") / F.sum("_n")).alias("gross_per_call"), (F.sum("_sum") / F.sum("_n") - cost).alias("net_per_call"),
        (F.avg("_day") * year).alias("ann_gross"), ((F.avg("_day") - cost) * year).alias("ann_net"),
        (safe_div(F.avg("_day") - cost, F.stddev_samp("_day")) * year**0.5).alias("sharpe_net"))
    return quality.join(money, "tail")


# -- deciles and bins ---------------------------------------------------------------------


def _long_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    keyed = df.withColumn("_k", F.concat_ws("|", "date", "ticker"))
    return keyed.unpivot(["_k", *keep], list(features), "feature", "_x").filter(F.col("_x").isNotNull())


def feature_deciles(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), keep=("rel",), rows=None) -> DataFrame:
    """Long rows (feature, decile 1..10, kept columns) with equal-count deciles per feature (and key)."""
    held = df.filter(F.col("rel").isNotNull()).select(*dict.fromkeys(["date", "ticker", *by, *keep, *features]))
    # measuring the groups and placing their rows both read it
    long = _long_features(materialise(held, "held") if rows is None else held, features, [*by, *keep])
    out = X.quantile_tile(long, [*by, "feature"], "_x", "decile", 10, tie="_k", group_rows=rows)
    return out.withColumn("decile", F.col("decile") + 1)


def decile_table(df: DataFrame, features: Sequence[str], rows=None) -> DataFrame:
    """Mean outcome in basis points by feature decile, with the top minus bottom spread."""
    table = feature_deciles(df, features, rows=rows).groupBy("feature", "decile").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("rel") * 1e4).alias("mean_bps"))
    ends = table.groupBy("feature").agg(
        (F.max(F.when(F.col("decile") == 10, F.col("mean_bps"))) - F.max(F.when(F.col("decile") == 1, F.col("mean_bps")))).alias("spread_bps"))
    return table.join(ends, "feature")


def decile_stability(df: DataFrame, features: Sequence[str], min_rows: int = 100, rows=None) -> DataFrame:
    """Per year and feature: outcome of the bottom, middle and top deciles, t of the top one."""
    held = feature_deciles(df.withColumn("year", F.year("date")), features, ["year"], rows=rows)
    bps = F.col("rel") * 1e4
    top = F.when(F.col("decile") == 10, bps)
    out = held.groupBy("year", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("decile") == 1, bps)).alias("d1_bps"),
        F.avg(F.when(F.col("decile").between(2, 9), bps)).alias("mid_bps"), F.avg(top).alias("d10_bps"),
        safe_div(F.avg(top), F.stddev_samp(top) / F.sqrt(F.count(top))).alias("d10_t"))
    enough = F.col("n") >= min_rows
    return out.select("year", "feature", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("d1_bps", "mid_bps", "d10_bps", "d10_t")])


def class_rate_by_decile(df: DataFrame, features: Sequence[str], target: str, cls: int = 2, rows=None) -> DataFrame:
    held = feature_deciles(df, features, keep=(target,), rows=rows)
    return held.groupBy("feature", "decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(target) == cls).cast("double")).alias("class_rate"))


def calibration(df: DataFrame, s: str, outcome: str, bins: int = 20, rows=None) -> DataFrame:
    """Quantile bins of the score: mean score, mean outcome, standard error and 95 % band."""
    held = df.filter(F.col(s).isNotNull() & F.col(outcome).isNotNull())
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = X.quantiles(held, [], s, probs, rows).select(
        F.slice(F.array_distinct(F.array(*probs)), 2, bins + 1).alias("e"))
    tagged = held.withColumn("_e", edges.scalar()).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(s))))
    se = safe_div(F.stddev_samp(outcome), F.sqrt(F.count(F.lit(1))))
    out = tagged.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("score_mean"), F.avg(outcome).alias("outcome_mean"), se.alias("se"))
    return out.withColumns({
        "low": F.col("outcome_mean") - 1.96 * F.col("se"), "high": F.col("outcome_mean") + 1.96 * F.col("se")})


def tails_spread(df: DataFrame, s: str, outcome: str, share: float, top: int, rows=None, group_rows=None) -> DataFrame:
    """Mean outcome of the best and worst share of all rows, and of each day's best ``top``."""
    keyed = df.withColumn("_k", F.concat_ws("|", "date", "ticker"))
    ranked = X.ordinal(keyed, [], s, "_ord", True, "_k", rows, size="_n")
    ranked = X.ordinal(ranked, X.DATE, s, "_day", True, group_rows=group_rows)
    k = F.floor(F.col("_n") * share)
    best, worst = F.col("_ord") <= k, F.col("_ord") > F.col("_n") - k
    day = ranked.agg(
        F.avg(F.when(best, F.col(outcome))).alias("top_mean"), F.avg(F.when(worst, F.col(outcome))).alias("bottom_mean"),
        F.avg(F.when(F.col("_day") <= top, F.col(outcome))).alias("daily_top_mean"), F.avg(outcome).alias("all_mean"))
    return day.select("*", (F.col("top_mean") - F.col("bottom_mean")).alias("spread"),
                      safe_div("top_mean", F.abs("bottom_mean")).alias("ratio"))


def top_quantiles(df: DataFrame, s: str, outcome: str, target: str, qs: Sequence[float], rows=None) -> DataFrame:
    """Rows scored at or above the (1 - q) quantile: count, mean outcome, precision, for several q."""
    cuts = X.quantiles(df, [], s, {f"c{i}": 1 - q for i, q in enumerate(qs)}, rows)
    cut = [cuts.select(f"c{i}").scalar() for i in range(len(qs))]
    items = []
    for q, c in zip(qs, cut):
        pick = F.col(s) >= c
        items.append(F.struct(
            F.lit(float(q)).alias("q"), F.count(F.when(pick, 1)).alias("n"),
            F.avg(F.when(pick, F.col(outcome))).alias("mean_outcome"),
            F.avg(F.when(pick, (F.col(target) == 2).cast("double"))).alias("precision")))
    return df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("x")).select("x.*")


# -- baselines and diagnostics --------------------------------------------------------------


def category_mode_baseline(train: DataFrame, test: DataFrame, target: str, default: int, classes=(0, 1)) -> DataFrame:
    """Accuracy and macro F1 of two naive predictors: a constant, and the category's most common class."""
    counts = train.groupBy("category", target).agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy("category").agg(F.max_by(target, F.struct("_n", -F.col(target))).alias("_mode"))
    both = test.join(mode, "category", "left").withColumns(
        {"constant": F.lit(default), "category_mode": F.coalesce("_mode", F.lit(default))})
    parts = [
        class_metrics(both, target, p, classes=classes).select(F.lit(p).alias("baseline"), "n", "accuracy", "macro_f1")
        for p in ("constant", "category_mode")
    ]
    return parts[0].unionByName(parts[1])


def boundary_errors(df: DataFrame, rel: str, actual: str, predicted: str, rows=None) -> DataFrame:
    """Are Extreme / Neutral mix-ups near the label cuts, or deep in the tails?"""
    known = df.filter(F.col(rel).isNotNull())
    cuts = X.quantiles(known, [], rel, {"lo": 0.15, "hi": 0.85, "p05": 0.05, "p95": 0.95}, rows)
    lo, hi, p05, p95 = (cuts.select(c).scalar() for c in ("lo", "hi", "p05", "p95"))
    x = F.col(rel)
    half = (hi - lo) / 2
    kind = F.concat_ws(">", actual, predicted)
    near = F.when(
        F.col(actual) == "Neutral", (F.abs(x - lo) < half) | (F.abs(x - hi) < half)
    ).otherwise(((x >= p05) & (x < lo)) | ((x <= p95) & (x > hi)))
    deep = (F.col(actual) == "Extreme") & ((x < p05) | (x > p95))
    tagged = known.select(kind.alias("kind"), F.abs(x).alias("_a"), near.alias("_near"), deep.alias("_deep"))
    counts = tagged.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_near"), 1)).alias("near"),
        F.count(F.when(F.col("_deep"), 1)).alias("deep"))
    return counts.join(X.quantiles(tagged, ["kind"], "_a", {"median_abs": 0.5}, rows), "kind")


def forward_correlation(df: DataFrame, features: Sequence[str], rel: str) -> DataFrame:
    """Absolute correlation of every feature with the forward outcome, in one aggregate."""
    items = [F.struct(F.lit(f).alias("feature"), F.abs(pearson(f, rel)).alias("abs_corr")) for f in features]
    return df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def truncation_check(
    source: DataFrame, compute: Callable[[DataFrame], DataFrame], cutoff, columns: Sequence[str], rtol: float = 1e-9
) -> DataFrame:
    """Recompute from rows up to a date and compare that date's row with the full run.

    Counts differing values and differing NULL patterns per column; all zero
    means no column looks ahead.
    """
    at = F.col("date") == cutoff
    keys = ["date", "ticker"]
    full = compute(source).filter(at).select(*keys, *columns)
    cut = compute(source.filter(F.col("date") <= cutoff)).filter(at).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    both = full.join(cut, keys, "full_outer")
    items = []
    for c in columns:
        a, b = F.col(c), F.col(f"_{c}")
        items.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"),
            F.count(F.when(F.abs(a - b) > rtol * F.greatest(F.abs(a), F.abs(b), F.lit(1e-300)), 1)).alias("value_diffs"),
            F.count(F.when(a.isNull() != b.isNull(), 1)).alias("null_diffs")))
    return both.agg(F.array(*items).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def label_autocorrelation(df: DataFrame, rel: str = "rel", tickers: int | None = None) -> DataFrame:
    """Median over tickers of the lag-1 autocorrelation of the outcome."""
    lagged = df.select("ticker", "t", F.col(rel).alias("_x"), R.lag(rel).alias("_b"))
    per = lagged.groupBy("ticker").agg(pearson("_x", "_b").alias("ac")).filter(F.col("ac").isNotNull())
    return X.quantiles(per, [], "ac", {"median_autocorr": 0.5}, tickers)


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations of all feature pairs in one aggregate."""
    items = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(a, b).alias("corr"))
        for i, a in enumerate(features) for b in features[i:]
    ]
    return df.agg(F.array(*items).alias("x")).select(F.explode("x").alias("y")).select("y.*")


def class_separation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Distance of the class 2 and class 0 means in units of the feature's deviation."""
    items = []
    for f in features:
        hi, lo = F.avg(F.when(F.col(target) == 2, F.col(f))), F.avg(F.when(F.col(target) == 0, F.col(f)))
        items.append(F.struct(F.lit(f).alias("feature"), safe_div(F.abs(hi - lo), F.stddev_samp(f)).alias("separation")))
    return df.agg(F.array(*items).alias("x")).select(F.explode("x").alias("y")).select("y.*")


def parity(a: DataFrame, b: DataFrame, columns: Sequence[str], rtol: float = 1e-6, atol: float = 1e-9) -> DataFrame:
    """Compare two panels on common keys: correlation and share of cells outside tolerance."""
    keys = ["date", "ticker"]
    both = a.select(*keys, *columns).join(b.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]), keys)
    items = []
    for c in columns:
        x, y = F.col(c), F.col(f"_{c}")
        off = F.when(x.isNull() & y.isNull(), 0.0).when(x.isNull() | y.isNull(), 1.0).otherwise(
            (F.abs(x - y) > atol + rtol * F.abs(y)).cast("double"))
        items.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), pearson(x, y).alias("corr"), F.avg(off).alias("mismatch")))
    return both.agg(F.array(*items).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def gap_free(grid: DataFrame) -> DataFrame:
    """Tickers without a missing price between their first and last one."""
    live = F.when(F.col("close").isNotNull(), F.col("t"))
    span = grid.groupBy("ticker").agg((F.max(live) - F.min(live) + 1).alias("_s"), F.count("close").alias("_n"))
    return span.filter(F.col("_s") == F.col("_n")).select("ticker")


def fund_profile(grid: DataFrame, per_year: float) -> DataFrame:
    """Annualised return and volatility and the deepest drawdown per ticker. ``grid`` carries r1."""
    df = grid.withColumn("_g", R.growth("r1"))
    df = df.withColumn("_dd", F.col("_g") / R.cummax("_g") - 1)
    return df.groupBy("ticker").agg(
        (F.avg("r1") * per_year).alias("ann_return"), (F.stddev_samp("r1") * per_year**0.5).alias("ann_vol"),
        F.min("_dd").alias("max_drawdown"))


def group_composite(grid: DataFrame, group: str) -> DataFrame:
    """Growth of one unit in an equal-weight composite per group and date. ``grid`` carries r1."""
    day = grid.groupBy(group, "date").agg(F.avg("r1").alias("_r"))
    w = Window.partitionBy(group).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return day.select(group, "date", F.exp(F.sum(F.log1p(F.coalesce("_r", F.lit(0.0)))).over(w)).alias("growth"))


def leaderboard(results: Sequence[DataFrame], by: str) -> DataFrame:
    """Result records of several runs, best first, unknown values last."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.orderBy(F.col(by).desc_nulls_last())


def outcome_by_prediction(df: DataFrame, by: Sequence[str], pred: str, outcome: str, rows=None) -> DataFrame:
    """Outcome of each predicted class: count, mean and median; universe mean; long minus short."""
    stats = df.groupBy(*by, pred).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"))
    stats = stats.join(X.quantiles(df, [*by, pred], outcome, {"median": 0.5}, rows), [*by, pred])
    whole = df.groupBy(*by).agg(
        F.avg(outcome).alias("universe_mean"),
        (F.avg(F.when(F.col(pred) == 2, F.col(outcome))) - F.avg(F.when(F.col(pred) == 0, F.col(outcome)))).alias("long_short"))
    return stats.join(whole, list(by))
