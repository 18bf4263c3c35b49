"""Histogram gradient boosting for several classes, on tables of any length.

Features become bins once, by exact quantiles; a missing value has bin 0 and so goes to the lower side of every split. Each round grows one
tree per class, all classes together, level by level: tasks add the gradients of their rows into one histogram of (class, node, feature, bin), the
histograms meet in a grouped sum, and splits are found as rows of that small table. Nothing is moved but histograms, whose size is
bounded by classes x nodes x features x bins whatever the number of rows.

The binned rows lie in the shared folder. Their margins are written anew every few rounds; in between, tasks replay the last few trees, so
a lost executor costs its tasks and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.operators import decisions as D
from crosspanel.operators import splits as S
from crosspanel.operators.models import MissingColumns
from crosspanel.session import discard, materialise

#: Quantile bins of a feature, and the accuracy asked of the quantiles (errors in rank of at most rows / ACCURACY; they have none).
BINS = 64
ACCURACY = 10_000
#: Rounds whose trees are replayed before the margins are written anew.
KEEP_EVERY = 8


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in heap order: a row goes right where its bin of ``feature`` exceeds ``cut``.

    A node without a split has the cut 255, which no bin exceeds, so its rows stay on the left below it.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            at = 2 * at + 1 + (bins[rows, self.feature[at]] > self.cut[at])
        return at

    def value(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.leaf[self.node(bins, depth) - (2**depth - 1)]


@dataclass(frozen=True)
class Boosted:
    """Fitted trees, ``trees[round][class]``, with the cuts of every feature."""

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    trees: tuple[tuple[Tree, ...], ...]
    depth: int
    classes: int
    gains: tuple[float, ...]

    def check(self, df: DataFrame) -> None:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise MissingColumns(f"missing {len(missing)} feature column(s): {missing[:8]}")

    def probabilities(self, df: DataFrame, out: Sequence[str] = D.P) -> DataFrame:
        """The rows with one probability for each class."""
        self.check(df)
        shared = df.sparkSession.sparkContext.broadcast(self)  # its size depends on rounds, depth and features alone
        kept = [f for f in df.schema.fields if f.name not in out]
        source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.array(*[F.col(f"`{f}`").cast("double") for f in self.features]).alias("_x"))
        schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in out]])

        def run(batches):
            m = shared.value
            for b in batches:
                bins = binned(_matrix(b.column(len(kept)), len(m.features)), m.cuts)
                margin = np.zeros((b.num_rows, m.classes))
                for round_trees in m.trees:
                    for k, tree in enumerate(round_trees):
                        margin[:, k] += tree.value(bins, m.depth)
                p = softmax(margin)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *[pa.array(p[:, k]) for k in range(m.classes)]], schema.names)

        return source.mapInArrow(run, schema)

    def score(self, df: DataFrame) -> DataFrame:
        """Class probabilities with score, prediction and confidence."""
        return self.probabilities(df).withColumns(D.score_columns())

    def importance(self) -> list[tuple[str, float]]:
        """Share of all gain that splits on a feature have brought."""
        total = sum(self.gains) or 1.0
        return sorted(((f, g / total) for f, g in zip(self.features, self.gains)), key=lambda x: (-x[1], x[0]))

    def first(self, rounds: int) -> Boosted:
        """The model after its first rounds."""
        return replace(self, trees=self.trees[:rounds])


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of ``width`` doubles as a matrix; missing values become NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers: 0 for a missing value, else 1 + the number of cuts below the value."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(c, x[:, f], "left"))
    return out


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; -0.0 counts as 0.0."""
    v = (x + 0.0).view(np.int64)
    return v ^ ((v >> 63) & np.int64(2**63 - 1))


def _doubles(v: np.ndarray) -> np.ndarray:
    return (v ^ ((v >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _cells(rows: DataFrame, width: int, known: int, bits: int, wanted: Sequence[np.ndarray]) -> DataFrame:
    """(feature, prefix, cell, n): the rows whose first ``known`` bits are a wanted prefix, counted by their next ``bits`` as well.

    A task counts in arrays and sends a row for each cell that has any. With all remaining bits, a cell is a value, and every batch sends its own.
    """
    shared = rows.sparkSession.sparkContext.broadcast(wanted)
    drop, span, last = 64 - known - bits, 1 << bits, known + bits == 64

    def batch_of(f, prefix, cell, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), f, np.int32)), pa.array(prefix), pa.array(cell), pa.array(n)], ["feature", "prefix", "cell", "n"])

    def run(batches):
        total = [np.zeros(0 if last else len(p) * span, np.int64) for p in shared.value]
        for b in batches:
            x = _matrix(b.column(0), width)
            for f, prefixes in enumerate(shared.value):
                v = x[:, f][~np.isnan(x[:, f])]
                if len(v) == 0 or len(prefixes) == 0:
                    continue
                cell = _ordered(v) >> drop
                own = cell >> bits if known else np.zeros(len(cell), np.int64)
                at = np.minimum(np.searchsorted(prefixes, own), len(prefixes) - 1)
                there = prefixes[at] == own
                if last:
                    cell, n = np.unique(cell[there], return_counts=True)
                    if len(cell):
                        yield batch_of(f, cell >> bits, cell, n)
                else:
                    total[f] += np.bincount(at[there] * span + (cell[there] & (span - 1)), minlength=len(total[f]))
        for f, counts in enumerate(total):
            k = np.flatnonzero(counts)
            if len(k):
                prefix, low = shared.value[f][k // span], k % span
                yield batch_of(f, prefix, (prefix << bits | low) if known else np.where(low >= span // 2, low - span, low), counts[k])

    return rows.mapInArrow(run, "feature int, prefix long, cell long, n long").groupBy("feature", "prefix", "cell").agg(F.sum("n").alias("n"))


#: Leading bits that the first pass counts by (sign and exponent), and every further one.
FIRST_BITS, MORE_BITS = 12, 8
#: Rows in the cells of all ranks from which their values themselves are counted.
FEW = 2_000_000


def ranked_values(rows: DataFrame, width: int, ranks: Sequence[tuple[int, int]], size: int) -> list[np.ndarray]:
    """The different values of the wanted (feature, rank from 1) of each of the ``width`` features of ``rows`` (an array x), in order.

    A few passes count rows by ever more leading bits, in those cells alone that hold a wanted rank, until few of all ``size`` values are left there.
    What tasks send depends on features and ranks, not on rows, and no sketch is merged in one task.
    """
    spark = rows.sparkSession
    ranks, known, rest = [(f, 0, rank) for f, rank in ranks], 0, size
    while known < 64 and ranks:
        bits = FIRST_BITS if known == 0 else 64 - known if rest <= FEW or known + MORE_BITS >= 64 else MORE_BITS
        wanted = [np.unique(np.array([p for g, p, _ in ranks if g == f], np.int64)) for f in range(width)]
        before = Window.partitionBy("feature", "prefix").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = _cells(rows, width, known, bits, wanted).withColumn("upto", F.sum("n").over(before))
        asked = F.broadcast(spark.createDataFrame(sorted(set(ranks)), "feature int, prefix long, rank long"))
        found = cells.join(asked, ["feature", "prefix"]).filter("rank <= upto AND rank > upto - n").select("feature", "cell", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n")
        found = found.collect()  # one row for each feature and rank
        ranks, rest = [(r.feature, r.cell, r.rank) for r in found], sum({(r.feature, r.cell): r.n for r in found}.values())
        known += bits
    return [np.unique(_doubles(np.array([v for g, v, _ in ranks if g == f], np.int64))) for f in range(width)]


def quantile_cuts(train: DataFrame, features: Sequence[str], bins: int = BINS, accuracy: int = ACCURACY) -> tuple[np.ndarray, ...]:
    """Up to ``bins`` - 1 cuts for each feature: the values of rank k x rows / ``bins``, rounded up; equal ones count once.

    Cuts are exact, whatever ``accuracy`` asks for.
    """
    x = [F.col(f"`{f}`").cast("double") for f in features]
    rows = train.select(F.array(*x).alias("x"))
    sizes = train.agg(*[F.count(F.when(c.isNotNull() & ~F.isnan(c), 1)).alias(f"n{i}") for i, c in enumerate(x)]).first()
    ranks = [(f, max(1, -(-k * n // bins))) for f, n in enumerate(sizes) if n for k in range(1, bins)]
    return tuple(ranked_values(rows, len(features), ranks, sum(sizes)))


def _mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """Fractions from 0 to 1 that depend on key and salt (a 64-bit finaliser)."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / 2**53


ROWS = "key long, y int, w double, bins binary, margin binary"


def _blocks(batches, width: int, classes: int):
    """(key, y, weight, bins, margins) of each batch of the binned table."""
    for b in batches:
        if b.num_rows:
            bins = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, width)
            margin = np.frombuffer(b"".join(b.column(4).to_pylist()), "<f8").reshape(-1, classes)
            yield b, b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), bins, margin


def _replayed(margin: np.ndarray, bins: np.ndarray, recent, depth: int) -> np.ndarray:
    out = margin.copy()
    for round_trees in recent:
        for k, tree in enumerate(round_trees):
            out[:, k] += tree.value(bins, depth)
    return out


def binned_rows(train: DataFrame, features: Sequence[str], cuts, label: str, weight: str | None, classes: int) -> DataFrame:
    """The training rows as bins, with margins of zero; rows without a label are left out."""
    shared = train.sparkSession.sparkContext.broadcast(cuts)
    named = [F.col(f"`{f}`").cast("double") for f in features]
    source = train.filter(F.col(label).isNotNull()).select(
        F.xxhash64(*train.columns).alias("key"), F.col(label).cast("int").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.array(*named).alias("x"))
    zeros = np.zeros(classes, "<f8").tobytes()

    def run(batches):
        for b in batches:
            bins = binned(_matrix(b.column(3), len(shared.value)), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([zeros] * b.num_rows, pa.binary())],
                                             ["key", "y", "w", "bins", "margin"])

    return source.mapInArrow(run, ROWS)


HISTOGRAM = "k int, node int, feature int, bin int, g double, h double, n long"


def histograms(rows: DataFrame, recent, growing, level: int, used: np.ndarray, width: int, classes: int, depth: int, bins: int, subsample: float, salt: int) -> DataFrame:
    """Gradient sums of every (class, node of this level, feature, bin), one partial sum for each task before they meet."""
    shared = rows.sparkSession.sparkContext.broadcast((recent, growing))
    nodes, top = 2**level, bins + 1

    def run(batches):
        recent, growing = shared.value
        total = np.zeros((3, classes, nodes * len(used) * top))
        offset = np.arange(len(used)) * top
        for _, key, y, w, codes, margin in _blocks(batches, width, classes):
            if subsample < 1.0:
                on = _mixed(key, salt) < subsample
                y, w, codes, margin = y[on], w[on], codes[on], margin[on]
            p = softmax(_replayed(margin, codes, recent, depth))
            cell = codes[:, used].astype(np.int64) + offset
            for k in range(classes):
                g = w * (p[:, k] - (y == k))
                h = w * np.maximum(p[:, k] * (1 - p[:, k]), 1e-16)
                node = growing[k].node(codes, level) - (nodes - 1)
                flat = (cell + (node * (len(used) * top))[:, None]).ravel()
                for i, v in enumerate((g, h)):
                    total[i, k] += np.bincount(flat, np.repeat(v, len(used)), nodes * len(used) * top)
                total[2, k] += np.bincount(flat, minlength=nodes * len(used) * top)
        k, at = np.nonzero(total[2])
        if len(k):
            node, rest = np.divmod(at, len(used) * top)
            feature, b = np.divmod(rest, top)
            whole = [k, node, used[feature], b]
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in whole], pa.array(total[0, k, at]), pa.array(total[1, k, at]), pa.array(total[2, k, at].astype(np.int64))],
                                             ["k", "node", "feature", "bin", "g", "h", "n"])

    return rows.mapInArrow(run, HISTOGRAM).groupBy("k", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def gain(left_g: Column, left_h: Column, all_g: Column, all_h: Column, penalty: float) -> Column:
    part = lambda g, h: g * g / (h + penalty)
    return part(left_g, left_h) + part(all_g - left_g, all_h - left_h) - part(all_g, all_h)


def best_splits(cells: DataFrame, penalty: float, least: float) -> DataFrame:
    """The best split of every (class, node): feature, bin, gain, and the sums on the left and in all.

    Gains are compared after rounding to 9 digits; ties go to the first feature and the lowest bin. Splits that leave less than ``least`` of
    the second derivative on a side, or gain nothing, do not count: their feature is null.
    """
    group = Window.partitionBy("k", "node", "feature")
    along = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"{side}_{c}": F.sum(c).over(w) for side, w in (("left", along), ("all", group)) for c in ("g", "h", "n")}
    c = cells.withColumns(sums)
    value = F.round(gain(F.col("left_g"), F.col("left_h"), F.col("all_g"), F.col("all_h"), penalty), 9)
    fits = (F.col("left_n") < F.col("all_n")) & (F.col("left_h") >= least) & (F.col("all_h") - F.col("left_h") >= least) & (value > 0)
    c = c.withColumn("gain", F.when(fits, value).otherwise(F.lit(-1.0)))
    best = F.max_by(F.struct("feature", "bin", "gain", "left_g", "left_h", "left_n", "all_g", "all_h", "all_n"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return c.groupBy("k", "node").agg(best.alias("b")).select("k", "node", "b.*")


def fit(
    train: DataFrame, features: Sequence[str], label: str = "target", weight: str | None = None, classes: int = 3, rounds: int = 400, depth: int = 6,
    rate: float = 0.05, subsample: float = 0.8, colsample: float = 0.8, penalty: float = 1.0, least: float = 1.0, bins: int = BINS, accuracy: int = ACCURACY,
    seed: int = 0, keep_every: int = KEEP_EVERY,
) -> Boosted:
    """Boosted trees with a softmax loss; labels are 0 to ``classes`` - 1.

    Rows and features are drawn for each round by hashes, so a fit can be repeated. Only cuts and the best split of every node reach the driver.
    """
    if not 2 <= bins <= 254:
        raise ValueError("bins must lie between 2 and 254")
    features = tuple(features)
    width = len(features)
    cuts = quantile_cuts(train, features, bins, accuracy)
    rows = materialise(binned_rows(train, features, cuts, label, weight, classes), "binned")
    inner, leaves = 2**depth - 1, 2**depth
    trees: list[tuple[Tree, ...]] = []
    gains = np.zeros(width)
    written = 0
    for r in range(rounds):
        recent = tuple(trees[written:])
        rng = np.random.default_rng((seed, r))
        used = np.sort(rng.choice(width, max(1, round(width * colsample)), replace=False)) if colsample < 1 else np.arange(width)
        grown = [Tree(np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(leaves)) for _ in range(classes)]
        sums: list[dict[int, tuple[float, float]]] = [{} for _ in range(classes)]  # of the nodes of the next level
        for level in range(depth):
            cells = histograms(rows, recent, grown, level, used, width, classes, depth, bins, subsample, seed * 1_000_003 + r)
            at, below = 2**level - 1, [{} for _ in range(classes)]
            for s in best_splits(cells, penalty, least).collect():  # one row for each class and node
                split = s.gain > 0
                if split:
                    grown[s.k].feature[at + s.node], grown[s.k].cut[at + s.node] = s.feature, s.bin
                    gains[s.feature] += s.gain
                below[s.k][2 * s.node] = (s.left_g, s.left_h) if split else (s.all_g, s.all_h)
                if split:
                    below[s.k][2 * s.node + 1] = (s.all_g - s.left_g, s.all_h - s.left_h)
            sums = below
        for k in range(classes):
            for leaf, (g, h) in sums[k].items():
                grown[k].leaf[leaf] = -rate * g / (h + penalty)
        trees.append(tuple(grown))
        if len(trees) - written >= keep_every and r + 1 < rounds:
            old, rows = rows, materialise(_advanced(rows, tuple(trees[written:]), width, classes, depth), "binned")
            discard(old)
            written = len(trees)
    discard(rows)
    return Boosted(features, cuts, tuple(trees), depth, classes, tuple(gains.tolist()))


@dataclass(frozen=True)
class TwoStage:
    """An extreme-or-not gate and a direction model trained on extremes only."""

    gate: Boosted
    direction: Boosted

    def score(self, df: DataFrame) -> DataFrame:
        out = self.gate.probabilities(df, ("_p_calm", "p_ext"))
        out = self.direction.probabilities(out, ("_p_down", "p_dir")).drop("_p_calm", "_p_down")
        return out.withColumns(D.two_stage("p_ext", "p_dir"))


def two_stage(train: DataFrame, features: Sequence[str], extreme: str = "y_ext", top: str = "y_top", **settings) -> TwoStage:
    """Both models with the same settings. A positive of the gate weighs as much as negatives come to one positive."""
    weight = S.positive_weight(train, extreme).first()["weight"]
    weighted = train.withColumn("_w", F.when(F.col(extreme) == 1, F.lit(weight)).otherwise(F.lit(1.0)))
    gate = fit(weighted, features, extreme, "_w", 2, **settings)
    return TwoStage(gate, fit(train.filter(F.col(extreme) == 1), features, top, None, 2, **settings))


def _advanced(rows: DataFrame, recent, width: int, classes: int, depth: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(recent)

    def run(batches):
        for b, _, _, _, codes, margin in _blocks(batches, width, classes):
            new = _replayed(margin, codes, shared.value, depth)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([m.tobytes() for m in new.astype("<f8")], pa.binary())], ["key", "y", "w", "bins", "margin"])

    return rows.mapInArrow(run, ROWS)


def leaf_table(spark, model: Boosted) -> DataFrame:
    """Every leaf value, one row each: round, class, leaf."""
    rows = [(r, k, leaf, float(v)) for r, trees in enumerate(model.trees) for k, t in enumerate(trees) for leaf, v in enumerate(t.leaf)]
    return spark.createDataFrame(rows, "round int, class int, leaf int, value double")


def split_table(spark, model: Boosted) -> DataFrame:
    """Every split: round, class, node (heap order), feature, and the value up to which rows go left (null: only missing values do)."""
    rows = []
    for r, trees in enumerate(model.trees):
        for k, t in enumerate(trees):
            for node, (f, c) in enumerate(zip(t.feature.tolist(), t.cut.tolist())):
                if c < 255:
                    rows.append((r, k, node, model.features[f], float(model.cuts[f][c - 1]) if 0 < c <= len(model.cuts[f]) else None))
    return spark.createDataFrame(rows, "round int, class int, node int, feature string, up_to double")
