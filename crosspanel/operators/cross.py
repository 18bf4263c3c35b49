"""Cross-sectional functions: every group is one date, or one (date, category).

Each operator has two plans and picks one by the size of the largest group, which callers pass in when they know it (on a
dense grid it is the number of tickers) and which is measured otherwise:

* groups up to ``WINDOW_ROWS`` run as windows, so that all cross-sectional columns of a step share a single exchange by date; ranks of
  several columns, for which windows would sort whole rows once for each, may take one Arrow pass over whole groups there instead;
* larger groups never meet in one task. Aggregates are combined map-side and joined back; ranks go through :func:`ladder`, which
  counts distinct values first and splits every group into value ranges. The input is written once with a row number, the
  ranking works on a narrow table of its own (row number, keys, value, tie) and comes back by row number, so nothing
  upstream runs twice and no helper column can clash with one of the input.

Both give the same rows and columns: NULL is a group key like any other, a NULL value is not ranked, a NULL tie comes first.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.functions.expr import col, safe_div
from crosspanel.operators.recurrence import _blocks
from crosspanel.session import materialise

WINDOW_ROWS = 1_000_000
SPLITS = 256

#: Cells of a group that an Arrow pass may hold at once, the columns from which on it pays, and the types it ranks without loss.
ARROW_CELLS = 100_000_000
ARROW_COLUMNS = 4
ARROW_TYPES = {"double", "float", "int", "smallint", "tinyint"}

#: The column that a ``top_n`` limit may read; reserved.
GROUP_SIZE = "_group_size"

DATE = ["date"]
PEERS = ["date", "category"]


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group; one small job over the key columns alone."""
    if not keys:
        return df.count()
    sizes = df.groupBy(*keys).count()
    return sizes.agg(F.max("count")).first()[0] or 0


def fits_window(df: DataFrame, keys: Sequence[str], group_rows: int | None) -> bool:
    return (largest_group(df, keys) if group_rows is None else group_rows) <= WINDOW_ROWS


# -- the split plan ---------------------------------------------------------------

ROW = "_row"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The input written once, with a row number; the steps of a split plan all read this table."""
    row = fresh(df, ROW)
    return materialise(df.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _named(keys: Sequence[str]) -> list[str]:
    return [f"k{i}" for i in range(len(keys))] or ["k0"]


def narrow(df: DataFrame, keys: Sequence[str], **columns) -> DataFrame:
    """Keys as k0, k1, ... (one constant key if there are none) beside the named columns."""
    group = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("k0")]
    return df.select(*group, *[col(c).alias(name) for name, c in columns.items()])


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the result has the columns of the left side, then the others of the right."""
    other = {k: f"r_{i}_{k}" for i, k in enumerate(on)}
    renamed = right.withColumnsRenamed(other)
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[o]) for k, o in other.items()])
    return left.join(renamed, same, how).drop(*other.values())


def with_results(result: DataFrame, df: DataFrame, added: Mapping[str, str]) -> DataFrame:
    """The columns of ``df`` and the results (out -> column of ``result``), placed like ``df.withColumns`` would."""
    own = [F.col(added[c]).alias(c) if c in added else F.col(c) for c in df.columns]
    return result.select(*own, *[F.col(p).alias(out) for out, p in added.items() if out not in df.columns])


def _with_group_rows(rows: DataFrame, groups: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with the columns of their group; the one row there is without keys comes in as scalar subqueries."""
    if keys:
        return join_null_safe(rows, groups, keys, "left")
    return rows.withColumns({c: groups.select(c).scalar() for c in columns})


def private(df: DataFrame, outs: Sequence[str]) -> dict[str, str]:
    """out -> a column name that the table does not have."""
    stem = fresh(df, "_result")
    while any(c.startswith(stem) for c in df.columns):
        stem += "_"
    return {out: f"{stem}{i}" for i, out in enumerate(outs)}


def value_edges(df: DataFrame, x: str, splits: int = SPLITS) -> list[float]:
    """At most ``splits - 1`` increasing cut values. They only steer balance:
    any edges give the same final result, so a sketch is good enough."""
    probs = [i / splits for i in range(1, splits)]
    found = df.agg(F.percentile_approx(F.col(x).cast("double"), probs, 10_000)).first()[0] or []
    return sorted(set(found))


def value_range(df: DataFrame, x: str, edges: Sequence[float], out: str) -> DataFrame:
    """Tag rows with the value range they fall in. Ranges ascend with x; values of any ordered type keep their type."""
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    place = "_place"
    tagged = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol=place, outputCol=out, handleInvalid="keep"
    ).transform(df.withColumn(place, F.col(x).cast("double")))
    return tagged.drop(place)


def _steps(rows: DataFrame, group: Sequence[str], quantities: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Distinct (group, v) of rows (group, v, quantities) with sums, running sums (``_le``) and group sums (``_all``).

    Equal values collapse in the map-side combine, then the distinct values are split by value range: the running totals
    need one window inside a range and one over the at most ``SPLITS`` range totals of a group.
    """
    steps = value_range(rows.groupBy(*group, "v").agg(*[F.sum(q).alias(q) for q in quantities]), "v", edges, "part")
    totals = steps.groupBy(*group, "part").agg(*[F.sum(q).alias(q) for q in quantities])
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        *group, "part",
        *[F.coalesce(F.sum(q).over(before), F.lit(0)).alias(f"{q}_before") for q in quantities],
        *[F.sum(q).over(whole).alias(f"{q}_all") for q in quantities],
    )
    inside = Window.partitionBy(*group, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(steps, offsets, [*group, "part"])
    out = out.withColumns({f"{q}_le": F.sum(q).over(inside) + F.col(f"{q}_before") for q in quantities})
    return out.drop("part", *[f"{q}_before" for q in quantities])


def ladder(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    sums: Mapping[str, Column] | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Distinct values of x per group with running totals up to and including each.

    ``sums`` maps an output name to the per-row quantity to add up; ``n`` (row
    count) is always there. For every name the result carries the value's own
    total (``n``), the running total (``n_le``) and the group total (``n_all``).
    """
    quantities = {"n": F.lit(1), **(sums or {})}
    internal = {name: f"q{i}" for i, name in enumerate(quantities)}
    group = _named(keys)
    rows = df.filter(F.col(x).isNotNull())
    rows = narrow(rows, keys, v=x, **{internal[n]: q for n, q in quantities.items()})
    if edges is None:
        rows = materialise(rows, "ladder")
        edges = value_edges(rows, "v")
    steps = _steps(rows, group, list(internal.values()), edges)
    back = [F.col(g).alias(k) for g, k in zip(group, keys)]
    return steps.select(*back, F.col("v").alias(x), *[F.col(q + end).alias(n + end) for end in ("", "_le", "_all") for n, q in internal.items()])


# -- ranks --------------------------------------------------------------------------


def pct_rank_over(x, keys: Sequence[str]) -> Column:
    """Average-tie rank / number of non-missing values, as a window expression."""
    c = col(x)
    ordered = Window.partitionBy(*keys).orderBy(c)
    up_to = F.count(c).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.count(c).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    n = F.count(c).over(Window.partitionBy(*keys))
    return F.when(c.isNotNull(), (up_to - (ties - 1) / F.lit(2.0)) / n)


def average_rank_over(x, keys: Sequence[str]) -> Column:
    c = col(x)
    ordered = Window.partitionBy(*keys).orderBy(c)
    up_to = F.count(c).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.count(c).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(c.isNotNull(), up_to - (ties - 1) / F.lit(2.0))


def ranks_in_groups(group: np.ndarray, x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (ties averaged) of the known values inside each group (0, 1, 2, ...), and every row's count of them in its group."""
    at = np.flatnonzero(known)
    at = at[np.lexsort((x[at], group[at]))]
    g, v = group[at], x[at]
    tied = (g[1:] == g[:-1]) & ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
    first = np.flatnonzero(np.concatenate([np.ones(min(len(v), 1), bool), ~tied]))
    size = np.diff(np.append(first, len(v)))
    n = np.bincount(g, minlength=int(group.max(initial=-1)) + 1)
    rank = np.full(len(x), np.nan)
    rank[at] = np.repeat(first + (size + 1) / 2, size) - (np.cumsum(n) - n)[g]
    return rank, n[group]


def _arrow_ranks(df, keys, columns, carry):
    """Percentile ranks of several columns in one pass over whole groups, which are sorted by their keys alone."""
    row = fresh(df, ROW)
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*[fields[c] for c in carry], *[T.StructField(out, T.DoubleType()) for out in columns]])
    keep, plan = list(carry), dict(columns)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, row):
            group = np.cumsum(table.column(row).to_numpy() == 1) - 1
            result = table.select(keep)
            for out, x in plan.items():
                known = table.column(x).is_valid().to_numpy()
                rank, n = ranks_in_groups(group, table.column(x).to_numpy().astype("float64"), known)
                result = result.append_column(out, pa.array(rank / np.maximum(n, 1), pa.float64(), mask=~known))
            yield from result.to_batches()

    wanted = list(dict.fromkeys([*keep, *plan.values()]))
    start = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return df.withColumn(row, start).select(*wanted, row).mapInArrow(ranked, schema)


def _arrow_fits(df, keys, columns, group_rows) -> bool:
    """Whether the groups, of a size the caller knows, may be ranked in Arrow."""
    types = dict(df.dtypes)
    named = all(isinstance(x, str) and types.get(x) in ARROW_TYPES for x in columns.values())
    return bool(keys) and len(columns) >= ARROW_COLUMNS and named and not set(columns) & set(types) and group_rows * len(types) <= ARROW_CELLS


def _ranks(df, keys, columns, group_rows, window_form, ladder_form, carry=None):
    if fits_window(df, keys, group_rows):
        if carry is not None and group_rows is not None and _arrow_fits(df, keys, columns, group_rows):
            return _arrow_ranks(df, keys, columns, carry)
        return df.withColumns({out: window_form(x, keys) for out, x in columns.items()})
    rows, row = numbered(df)
    group = _named(keys)
    # columns of one type are ranked together: (row, column, value), one ladder, one way back
    kinds: dict[str, list[tuple[str, str]]] = {}
    for out, x in columns.items():
        kinds.setdefault(rows.select(col(x)).schema.fields[0].dataType.simpleString(), []).append((out, x))
    result, added = rows, private(rows, list(columns))
    for pairs in kinds.values():
        stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), col(x).alias("v")) for i, (_, x) in enumerate(pairs)]))
        long = narrow(rows, keys, row=row, s=stacked).select(*group, "row", "s.c", "s.v").filter("v IS NOT NULL")
        steps = _steps(long.withColumn("n", F.lit(1)), [*group, "c"], ["n"], value_edges(long, "v"))
        ranked = join_null_safe(long, steps.select(*group, "c", "v", ladder_form(steps).alias("rank")), [*group, "c", "v"])
        back = ranked.groupBy("row").agg(*[F.max(F.when(F.col("c") == i, F.col("rank"))).alias(f"o{i}") for i in range(len(pairs))])
        outs = [F.col(f"o{i}").alias(added[out]) for i, (out, _) in enumerate(pairs)]
        key = fresh(result, "_back")
        result = result.join(back.select(F.col("row").alias(key), *outs), F.col(row) == F.col(key), "left").drop(key)
    return with_results(result, df, added)


def pct_rank(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], group_rows: int | None = None, carry: Sequence[str] | None = None
) -> DataFrame:
    """Add percentile ranks (average ties / count of non-missing), NULL where x is.

    A caller that names the columns it reads later (``carry``) lets several columns be ranked in one Arrow pass, which drops the others.
    """
    return _ranks(
        df, keys, columns, group_rows, pct_rank_over,
        lambda s: (s["n_le"] - (s["n"] - 1) / F.lit(2.0)) / s["n_all"], carry,
    )


def average_rank(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], group_rows: int | None = None
) -> DataFrame:
    """Add 1-based ranks with ties averaged."""
    return _ranks(
        df, keys, columns, group_rows, average_rank_over,
        lambda s: s["n_le"] - (s["n"] - 1) / F.lit(2.0),
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    out: str,
    descending: bool = False,
    tie: str = "ticker",
    group_rows: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """1..n by x with ties broken by ``tie`` (missing x is not numbered).

    ``size`` optionally names a column for n, the group's non-missing count.
    """
    c = F.col(x)
    if fits_window(df, keys, group_rows):
        order = Window.partitionBy(*keys).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)
        added = {out: F.when(c.isNotNull(), F.row_number().over(order)).cast("long")}
        if size:
            added[size] = F.count(c).over(Window.partitionBy(*keys))
        return df.withColumns(added)
    return _split_ordinal(df, keys, x, out, descending, tie, size)


def _split_ordinal(df, keys, x, out, descending, tie, size):
    """Ordinal for groups too large for one task: one sort of all rows by ranges of (keys, x, tie), written with a running number
    in each range; what a range has of a group, counted over the ranges before, turns it into a place. No row is joined back."""
    rows = materialise(df, "rows")
    at = fresh(df, "_at")
    c = F.col(x)
    ordered = rows.orderBy(*keys, c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)
    # consecutive inside a range, whose number stands above the lower 33 bits
    placed = materialise(ordered.withColumn(at, F.monotonically_increasing_id()), "ordered")
    part = fresh(placed, "_part")
    placed = placed.withColumn(part, F.shiftright(at, 33))
    added = private(placed, [out, "skip", *([size] if size else [])])
    pieces = narrow(placed, keys, part=part, at=at, v=x)
    group = _named(keys)
    pieces = pieces.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"), F.count("v").alias("known"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    back = [F.col(g).alias(k) for g, k in zip(group, keys)]
    pieces = pieces.select(
        *back, F.col("part").alias(part), (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first") + 1).alias(added["skip"]),
        *([F.sum("known").over(Window.partitionBy(*group)).alias(added[size])] if size else []))
    result = join_null_safe(placed, pieces, [*keys, part], "left")
    result = result.withColumn(added[out], F.when(c.isNotNull(), F.col(at) + F.col(added["skip"])).cast("long"))
    return with_results(result, df, {name: added[name] for name in added if name != "skip"})


def tile(rank: Column, n: Column, q: int) -> Column:
    """Equal-count bin 0..q-1 of a 1-based ordinal, in exact integer arithmetic."""
    bins = F.lit(0)
    for k in range(1, q):
        place, cut = q * (rank - 1), k * (n - 1)
        bins = bins + F.when(place >= cut if q == 3 else place > cut, 1).otherwise(0)
    return F.when(rank.isNotNull(), bins)


def quantile_tile(
    df: DataFrame, keys, x: str, out: str, q: int, tie="ticker", descending=False, group_rows=None
) -> DataFrame:
    """First-come equal-count tiles of x per group (3 = terciles, 10 = deciles)."""
    place, size = fresh(df, "_ord"), fresh(df, "_count")
    ranked = ordinal(df, keys, x, place, descending, tie, group_rows, size=size)
    return ranked.withColumn(out, tile(F.col(place), F.col(size), q)).drop(place, size)


def tercile_of(pct) -> Column:
    """0 / 1 / 2 from a percentile rank cut at one and two thirds."""
    p = col(pct)
    return F.when(p.isNotNull(), F.when(p <= 1 / 3, 0).when(p <= 2 / 3, 1).otherwise(2))


# -- aggregates broadcast back to the members -------------------------------------------


def group_stats(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], group_rows: int | None = None
) -> DataFrame:
    """Add group aggregates to every member row.

    ``stats`` maps a new column to an aggregate expression. Large groups use a
    map-side combined aggregate joined back on the keys.
    """
    keys = list(keys)
    if fits_window(df, keys, group_rows):
        w = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(w) for name, agg in stats.items()})
    rows, added = materialise(df, "rows"), private(df, list(stats))
    totals = rows.groupBy(*keys).agg(*[agg.alias(added[name]) for name, agg in stats.items()])
    return with_results(_with_group_rows(rows, totals, keys, list(added.values())), df, added)


def loo_mean(x, total: str | Column, n: str | Column, null_self: bool = True) -> Column:
    """Mean of the other members from the group total and count.

    With ``null_self`` a member without a value gets NULL; otherwise it gets the
    full mean of the others that have one.
    """
    c, total, n = col(x), col(total), col(n)
    if null_self:
        return safe_div(total - c, n - 1)
    return safe_div(total - F.coalesce(c, F.lit(0.0)), n - c.isNotNull().cast("int"))


def add_loo(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    null_self: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """Add leave-one-out group means: out -> x."""
    names = {out: (fresh(df, f"_{out}_s"), fresh(df, f"_{out}_n")) for out in columns}
    stats: dict[str, Column] = {}
    for out, x in columns.items():
        stats[names[out][0]], stats[names[out][1]] = F.sum(x), F.count(x)
    df = group_stats(df, keys, stats, group_rows)
    return df.withColumns({out: loo_mean(x, *names[out], null_self) for out, x in columns.items()}).drop(*stats)


def zscore(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], flat: str = "null",
    bound: float | None = None, group_rows: int | None = None,
) -> DataFrame:
    """(x - mean) / sample std per group.

    ``flat`` says what a zero deviation means: "null" gives NULL, "one" divides by 1.
    """
    names = {out: (fresh(df, f"_{out}_m"), fresh(df, f"_{out}_d")) for out in columns}
    stats: dict[str, Column] = {}
    for out, x in columns.items():
        stats[names[out][0]], stats[names[out][1]] = F.avg(x), F.stddev_samp(x)
    df = group_stats(df, keys, stats, group_rows)
    added = {}
    for out, x in columns.items():
        mean, sd = F.col(names[out][0]), F.col(names[out][1])
        if flat == "one":
            sd = F.when(sd > 0, sd).otherwise(F.lit(1.0))
        z = safe_div(F.col(x) - mean, sd)
        if bound is not None:
            z = F.when(z.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), z)))
        added[out] = z
    return df.withColumns(added).drop(*stats)


# -- quantiles ------------------------------------------------------------------------


def quantiles(
    df: DataFrame, keys: Sequence[str], x: str, probs: Mapping[str, float], group_rows: int | None = None
) -> DataFrame:
    """One row per group with exact linear-interpolated quantiles."""
    keys = list(keys)
    if fits_window(df, keys, group_rows):
        # one buffer of distinct values for all probabilities
        found = fresh(df, "_found")
        exact = df.groupBy(*keys).agg(F.percentile(x, list(probs.values())).alias(found))
        return exact.select(*keys, *[F.get(F.col(found), i).alias(name) for i, name in enumerate(probs)])
    steps = narrow(ladder(df, keys, x), keys, v=x, n_le="n_le", n_all="n_all")
    group = _named(keys)
    value, picks = F.col("v").cast("double"), []
    for i, p in enumerate(probs.values()):
        pos = F.lit(float(p)) * (F.col("n_all") - 1)
        lo = F.floor(pos)
        picks += [
            F.min(F.when(F.col("n_le") > lo, value)).alias(f"lo{i}"),
            F.min(F.when(F.col("n_le") > F.ceil(pos), value)).alias(f"hi{i}"),
            F.max(pos - lo).alias(f"f{i}"),
        ]
    found = steps.groupBy(*group).agg(*picks) if keys else steps.agg(*picks)
    # groups without any value have a row as well
    if keys:
        found = join_null_safe(narrow(df, keys).distinct(), found, group, "left")
    between = [(F.col(f"lo{i}") + F.col(f"f{i}") * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(n) for i, n in enumerate(probs)]
    return found.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], *between)


def group_median(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], group_rows: int | None = None
) -> DataFrame:
    """Add the exact group median of x to every member row."""
    keys = list(keys)
    if fits_window(df, keys, group_rows):
        w = Window.partitionBy(*keys)
        return df.withColumns({out: F.median(x).over(w) for out, x in columns.items()})
    rows, added = materialise(df, "rows"), private(df, list(columns))
    result = rows
    for out, x in columns.items():
        medians = quantiles(rows, keys, x, {added[out]: 0.5}, group_rows)
        result = _with_group_rows(result, medians, keys, [added[out]])
    return with_results(result, df, added)


def top_n(
    df: DataFrame, keys: Sequence[str], x: str, n: Column | int, descending: bool = True,
    tie: str = "ticker", group_rows: int | None = None,
) -> DataFrame:
    """The first n rows of every group; ``n`` may depend on ``GROUP_SIZE``, the group's count of values."""
    limit = F.lit(n) if isinstance(n, int) else n
    place = fresh(df, "_ord")
    ranked = ordinal(df, keys, x, place, descending, tie, group_rows, size=GROUP_SIZE)
    return ranked.filter(F.col(place) <= limit).drop(place, GROUP_SIZE)
