from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crosspanel.session import drop_tables, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", "tests", partitions=4)
    yield s
    drop_tables(s)
    s.stop()


@pytest.fixture(scope="session")
def wide():
    """400 business days x 12 tickers in two categories, with some gaps."""
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2022-01-03", periods=400)
    names = [f"T{i:02d}" for i in range(12)]
    close = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.01, (400, 12)), axis=0)), days, names)
    close = close.mask(rng.random(close.shape) < 0.01)
    close.iloc[:30, 3] = np.nan
    return close


@pytest.fixture(scope="session")
def grid(spark, wide):
    """The wide frame as a dense Spark grid: date, t, ticker, category, OHLCV."""
    rng = np.random.default_rng(8)
    long = wide.stack(future_stack=True).rename("close").reset_index()
    long.columns = ["date", "ticker", "close"]
    long["t"] = long["date"].map({d: i for i, d in enumerate(wide.index)})
    long["category"] = np.where(long["ticker"] < "T06", "A", "B")
    band = 1 + rng.uniform(0.001, 0.02, len(long))
    long["high"], long["low"] = long["close"] * band, long["close"] / band
    long["open"] = (long["high"] + long["low"]) / 2
    long["volume"] = np.where(long["close"].isna(), np.nan, rng.lognormal(8, 1, len(long)))
    long["date"] = long["date"].dt.date
    df = spark.createDataFrame(long.astype(object).where(long.notna(), None), (
        "date date, ticker string, close double, t int, category string, high double, low double, open double, volume double"))
    df = df.repartition(4, "ticker").cache()
    df.count()
    return df


def pivot(df, column, wide):
    pdf = df.select("date", "ticker", column).toPandas()
    out = pdf.pivot(index="date", columns="ticker", values=column).astype("float64")
    out.index = pd.to_datetime(out.index)
    out.columns.name = None
    return out.reindex(index=wide.index, columns=wide.columns)
