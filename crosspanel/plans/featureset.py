"""A feature set as data, so that several sets share one pass over the panel.

Phases of a build, each phase one layout of the data:

    trail    ticker windows on the raw grid          (exchange by ticker)
             and then ranks among a ticker's own
             last rows                               (same partitioning)
    peers    leave-one-out means, group statistics,
             percentile ranks per date               (exchange by date)
    trail2   ticker windows on peer columns          (exchange by ticker, only if used)
    ranks2   percentile ranks of those               (exchange by date, only if used)
    final    row-wise expressions and the output columns

The ranks among own rows are a pass in Arrow, which the optimizer cannot prune, so
helper columns that no later phase reads are left behind there.

Many columns of many tickers would fill the disk at each of these exchanges. There
(``_apart``) no wide row moves: group sums become a small table, the columns to be
ranked go by date once beside the raw ones, ranks are written with those, and what
trails is computed from the raw columns wherever it is read.

Sets built together merge phase by phase: a column two sets need is computed
once, and of two outputs with one name the first set's is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.operators import cross as X
from crosspanel.operators import recurrence as E
from crosspanel.session import materialise

Stage = dict[str, Column]

#: Columns of the grid that operators read without being told.
AXES = ["date", "t", "ticker", "category"]

#: Rows of a group and columns of a build from which wide rows stay where they are.
APART_ROWS, APART_COLUMNS = 5_000, 32
#: Groups up to which every task gets a copy of their sums.
COPIED_GROUPS = 100_000


@dataclass
class FeatureSet:
    name: str
    columns: Sequence[str]
    trail: Callable[[], list[Stage]]
    own_ranks: Mapping[str, tuple[str, int]] = field(default_factory=dict)
    loo: Mapping[str, str] = field(default_factory=dict)
    stats: Callable[[], Stage] = dict
    ranks: Mapping[str, str] = field(default_factory=dict)
    trail2: Callable[[], list[Stage]] = list
    ranks2: Mapping[str, str] = field(default_factory=dict)
    final: Callable[[], Stage] = dict


def _merge(stage_lists: Sequence[list[Stage]]) -> list[Stage]:
    """Stage i of every set together; a name already made is not made again."""
    depth = max((len(s) for s in stage_lists), default=0)
    made: set[str] = set()
    out: list[Stage] = []
    for i in range(depth):
        stage: Stage = {}
        for stages in stage_lists:
            if i < len(stages):
                for name, expr in stages[i].items():
                    if name not in made:
                        made.add(name)
                        stage[name] = expr
        out.append(stage)
    return out


def _union(maps: Sequence[Mapping]) -> dict:
    out: dict = {}
    for m in maps:
        for k, v in m.items():
            out.setdefault(k, v)
    return out


def _read(stages: Iterable[Stage]) -> set[str]:
    """Every word of the expressions, the names of the columns they read among them."""
    return {word for stage in stages for expr in stage.values() for word in re.findall(r"\w+", str(expr))}


def _apart(grid, trail, own, loo, stats, ranks, trail2, final, names, group_rows) -> DataFrame:
    """The build in which only raw columns, inputs of ranks and ranks are ever exchanged."""

    def trailing(df):
        for stage in trail:
            df = df.withColumns(stage)
        return df

    start = trailing(grid)
    sums = {out: (X.fresh(start, f"_{out}_s"), X.fresh(start, f"_{out}_n")) for out in loo}
    wanted = {sums[out][i]: agg(x) for out, x in loo.items() for i, agg in enumerate((F.sum, F.count))} | stats
    added = X.private(start, list(wanted))
    groups = None
    if wanted:
        groups = materialise(start.groupBy(*X.PEERS).agg(*[agg.alias(added[name]) for name, agg in wanted.items()]), "groups")
        if groups.count() <= COPIED_GROUPS:
            groups = F.broadcast(groups)

    def peers(df):
        """Trailing columns, those of the peers, and what trails of these: all of it in the layout by ticker."""
        df = trailing(df)
        if groups is not None:
            df = X.with_results(X.join_null_safe(df, groups, X.PEERS, "left"), df, added)
            df = df.withColumns({out: X.loo_mean(x, *sums[out], False) for out, x in loo.items()})
        for stage in trail2:
            df = df.withColumns(stage)
        return df

    if ranks:
        inputs = [x for x in dict.fromkeys(ranks.values()) if x not in grid.columns]
        ranked = X.pct_rank(peers(grid).select(*grid.columns, *inputs), X.PEERS, ranks, group_rows, grid.columns)
        grid = materialise(ranked.select(*grid.columns, *ranks), "ranks")
    df = peers(grid)
    if own:
        later = {*names, *AXES, *_read([final])}
        df = E.own_rank(df, own, [c for c in df.columns if c in later])
    return df.withColumns(final).select("date", "ticker", *names)


def _in_order(grid, trail, own, loo, stats, ranks, ranks2, trail2) -> bool:
    """Whether no phase reads what ``_apart`` makes later than the phases do, and none makes a column again."""
    first = [*grid.columns, *(name for stage in trail for name in stage)]
    made = [*own, *loo, *stats, *ranks, *ranks2, *(name for stage in trail2 for name in stage)]
    read = {*loo.values(), *ranks.values(), *_read([stats])}
    return (
        len({*first, *made}) == len({*first}) + len(made)
        and not read & {*made}
        and not ({*_read(trail2), *ranks2.values()} & {*own, *ranks, *ranks2})
    )


def build(grid: DataFrame, sets: Sequence[FeatureSet], group_rows: int | None = None) -> DataFrame:
    """(date, ticker, features...) for one or more feature sets in one pass."""
    trail = _merge([s.trail() for s in sets])
    df = grid
    own = _union([s.own_ranks for s in sets])
    loo = _union([s.loo for s in sets])
    stats = _union([s.stats() for s in sets])
    ranks = _union([s.ranks for s in sets])
    trail2 = _merge([s.trail2() for s in sets])
    ranks2 = _union([s.ranks2 for s in sets])
    final = _union([s.final() for s in sets])
    names = list(dict.fromkeys(c for s in sets for c in s.columns))
    large = group_rows is not None and group_rows >= APART_ROWS and len(names) >= APART_COLUMNS
    if large and _in_order(grid, trail, own, loo, stats, ranks, ranks2, trail2):
        return _apart(grid, trail, own, loo, stats, ranks | ranks2, trail2, final, names, group_rows)
    for stage in trail:
        df = df.withColumns(stage)
    if own:  # after the last window by ticker: what follows is dealt by date anyway
        later = {*names, *AXES, *loo.values(), *ranks.values(), *ranks2.values(), *_read([stats, *trail2, final])}
        df = E.own_rank(df, own, [c for c in df.columns if c in later])
    if loo:
        df = X.add_loo(df, X.PEERS, loo, False, group_rows)
    if stats:
        df = X.group_stats(df, X.PEERS, stats, group_rows)
    if ranks:
        later = {*names, *AXES, *ranks2.values(), *_read([*trail2, final])}
        df = X.pct_rank(df, X.PEERS, ranks, group_rows, [c for c in df.columns if c in later])
    for stage in trail2:
        df = df.withColumns(stage)
    if ranks2:
        later = {*names, *AXES, *_read([final])}
        df = X.pct_rank(df, X.PEERS, ranks2, group_rows, [c for c in df.columns if c in later])
    if final:
        df = df.withColumns(final)
    return df.select("date", "ticker", *names)
