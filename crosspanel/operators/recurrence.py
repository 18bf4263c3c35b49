"""Passes over whole tickers: recurrences, and order statistics of sliding windows.

No window aggregate expresses an exponentially weighted mean with gaps or, without a copy of the window on every row, the
rank of a value among the rows before it. The rows
are clustered and ordered by a ticker window, and Arrow batches of whole tickers
are walked calendar row by calendar row, all tickers and series of a block at
once. Only numbers the recurrences read are converted; carried columns stay in
Arrow. A ticker has at most a calendar of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.operators.rolling import axis

BLOCK_ROWS = 200_000

# input name -> matrix (calendar row, ticker); result: output name -> matrix
BlockFn = Callable[[Mapping[str, np.ndarray]], Mapping[str, np.ndarray]]


def span(n: float) -> float:
    return 2.0 / (n + 1.0)


def smooth_many(series: Sequence[tuple[np.ndarray, float, int]]) -> list[np.ndarray]:
    """Exponentially weighted means of several matrices: (values, alpha, min_periods) each.

    The first value starts the recursion; at a gap the last mean repeats while
    its weight decays. Fewer than ``min_periods`` values so far give NaN.
    """
    x = np.concatenate([m for m, _, _ in series], axis=1)
    widths = [m.shape[1] for m, _, _ in series]
    alpha = np.repeat([a for _, a, _ in series], widths)
    known = ~np.isnan(x)
    mean = np.full(x.shape[1], np.nan)
    weight = np.ones(x.shape[1])
    out = np.empty_like(x)
    for i in range(x.shape[0]):
        weight = weight * (1.0 - alpha)
        here = known[i]
        fresh = (weight * mean + alpha * x[i]) / (weight + alpha)
        mean = np.where(here, np.where(np.isnan(mean), x[i], fresh), mean)
        weight = np.where(here, 1.0, weight)
        out[i] = mean
    parts = np.split(out, np.cumsum(widths)[:-1], axis=1)
    for part, (m, _, least) in zip(parts, series):
        if least > 1:
            part[np.cumsum(~np.isnan(m), axis=0) < least] = np.nan
    return parts


def smooth(x: np.ndarray, alpha: float, min_periods: int = 0) -> np.ndarray:
    return smooth_many([(x, alpha, min_periods)])[0]


def rolled(x: np.ndarray, k: int, stat: str) -> np.ndarray:
    """Rolling statistic down the rows of a matrix (whole windows only)."""
    return getattr(pd.DataFrame(x).rolling(k), stat)().to_numpy()


def _blocks(batches: Iterator[pa.RecordBatch], row: str = "_row") -> Iterator[pa.Table]:
    """Join batches into tables of whole tickers; ``row`` = 1 starts a ticker."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(table.column(row).to_numpy() == 1)
            if len(starts) and starts[-1] > 0:
                yield table.slice(0, starts[-1])
                table = table.slice(starts[-1])
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def per_ticker(
    df: DataFrame, carry: Sequence[str], inputs: Sequence[str], outputs: Sequence[str], fn: BlockFn
) -> DataFrame:
    """Add double columns that ``fn`` computes from whole tickers in calendar order.

    The result holds ``carry`` and ``outputs``; NaN and infinities come back as
    NULL. The row number both orders the rows and pins a ticker to one
    partition, so an upstream ticker window costs no further exchange.
    """
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*[fields[c] for c in carry], *[T.StructField(o, T.DoubleType()) for o in outputs]])
    wanted = list(dict.fromkeys([*carry, *inputs]))
    keep, outs, reads = list(carry), list(outputs), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            row = table.column("_row").to_numpy() - 1
            ticker = np.cumsum(row == 0) - 1
            shape = (int(row.max()) + 1, int(ticker.max()) + 1)
            matrices = {}
            for c in reads:
                m = np.full(shape, np.nan)
                m[row, ticker] = table.column(c).to_numpy(zero_copy_only=False).astype("float64")
                matrices[c] = m
            with np.errstate(divide="ignore", invalid="ignore"):
                made = fn(matrices)
            result = table.select(keep)
            for o in outs:
                v = made[o][row, ticker]
                result = result.append_column(o, pa.array(v, pa.float64(), mask=~np.isfinite(v)))
            yield from result.to_batches()

    ordered = df.select(*wanted).withColumn("_row", F.row_number().over(axis()))
    return ordered.mapInArrow(run, schema)


def ewm(df: DataFrame, columns: Mapping[str, tuple[str, float]], carry: Sequence[str] | None = None) -> DataFrame:
    """Add exponentially weighted means: out -> (x, alpha)."""
    plan = {out: (x, float(alpha)) for out, (x, alpha) in columns.items()}

    def fn(m):
        return dict(zip(plan, smooth_many([(m[x], a, 0) for x, a in plan.values()])))

    return per_ticker(df, carry or df.columns, [x for x, _ in plan.values()], list(plan), fn)


#: Numbers of the windows compared at a time.
COMPARED = 4_000_000


def rank_of_last(x: np.ndarray, k: int) -> np.ndarray:
    """Average-tie percentile rank of every value among the k rows that end with it, down the rows of a matrix (whole windows only)."""
    out = np.full(x.shape, np.nan)
    if len(x) < k or not x.shape[1]:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(x, k, axis=0)
    step = max(1, COMPARED // (x.shape[1] * k))
    for at in range(0, len(windows), step):
        w = windows[at : at + step]
        last = w[..., -1:]
        out[at + k - 1 : at + k - 1 + len(w)] = ((w < last).sum(-1) + ((w == last).sum(-1) + 1) / 2) / k
    known = np.concatenate([np.zeros((1, x.shape[1]), int), np.cumsum(~np.isnan(x), axis=0)])
    out[k - 1 :][known[k:] - known[:-k] < k] = np.nan
    return out


def own_rank(df: DataFrame, columns: Mapping[str, tuple[str, int]], carry: Sequence[str] | None = None) -> DataFrame:
    """Add percentile ranks of columns among their own last rows: out -> (x, rows). No window is ever a column."""
    plan = dict(columns)

    def fn(m):
        return {out: rank_of_last(m[x], k) for out, (x, k) in plan.items()}

    return per_ticker(df, carry or df.columns, list(dict.fromkeys(x for x, _ in plan.values())), list(plan), fn)


def fisher(price: np.ndarray, k: int) -> np.ndarray:
    """Fisher transform of a price's place in its own k-row range.

    Rows without a full range leave the state as it is and give no value.
    """
    low, high = rolled(price, k, "min"), rolled(price, k, "max")
    place = (price - low) / np.maximum(high - low, 0.001) - 0.5
    value, level = np.zeros(price.shape[1]), np.zeros(price.shape[1])
    out = np.full(price.shape, np.nan)
    for i in range(price.shape[0]):
        here = ~np.isnan(place[i])
        value = np.where(here, np.clip(0.66 * place[i] + 0.67 * value, -0.999, 0.999), value)
        level = np.where(here, 0.5 * (np.log((1 + value) / (1 - value)) + level), level)
        out[i] = np.where(here, level, np.nan)
    return out
