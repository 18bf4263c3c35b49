"""Wide files written by pandas, and the way back."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from crosspanel.sources import wide as W


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    days = pd.date_range("2024-01-01", periods=6, name="Date")
    names = [f"T{i}" for i in range(9)] + ["BRK.B", "A`x", "it's"]
    columns = pd.MultiIndex.from_product([["Open", "High", "Low", "Close", "Volume"], names])
    df = pd.DataFrame(rng.uniform(1, 9, (6, len(columns))), days, columns)
    df = df.mask(rng.random(df.shape) < 0.2)
    df.iloc[2, 3] = np.inf
    df.loc[:, (slice(None), "T3")] = np.nan  # a ticker without any cell
    return df.drop(columns=[("Low", "T1")])


def plain(frame, keep):
    rows = {}
    for day, cells in frame.iterrows():
        for t in sorted({c[1] for c in frame.columns}):
            v = tuple(None if (f, t) not in cells or not np.isfinite(cells[f, t]) else cells[f, t] for f in ("Open", "High", "Low", "Close", "Volume"))
            if keep or any(x is not None for x in v):
                rows[day.date(), t] = v
    return rows


@pytest.mark.parametrize("group,keep", [(2, True), (5, False), (200, False)])
def test_files_of_pandas(spark, frame, tmp_path, group, keep):
    path = str(tmp_path / "wide.parquet")
    flat = frame.copy()
    flat.columns = [str(c) for c in frame.columns]
    flat.reset_index().to_parquet(path)
    got = {(r.date, r.ticker): (r.open, r.high, r.low, r.close, r.volume) for r in W.read_wide(spark, path, group=group, keep_missing=keep).collect()}
    assert got == plain(frame, keep)


def test_a_group_reads_its_own_columns(spark, frame, tmp_path):
    path = str(tmp_path / "wide.parquet")
    flat = frame.copy()
    flat.columns = [str(c) for c in frame.columns]
    flat.reset_index().to_parquet(path)
    text = W.read_wide(spark, path, ["close"], group=6)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 and "('Open'" not in text


def test_round_trip(spark, frame, tmp_path):
    long = W.from_wide(spark.createDataFrame(frame.set_axis([str(c) for c in frame.columns], axis=1).reset_index()))
    W.write_wide(long, str(tmp_path / "out"))
    back = W.read_wide(spark, str(tmp_path / "out"), group=4)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, long.collect()))


def test_names():
    date, found = W.column_map(["Date", "Close|A", "B|volume", "Adj Close|A", "note"])
    assert date == "Date" and found == {"A": {"close": "Close|A"}, "B": {"volume": "B|volume"}}
    assert W.column_map(["('Date', '')", "('Close', 'A')"])[0] == "('Date', '')"
    with pytest.raises(W.WideError):
        W.column_map(["Close|A"])
    with pytest.raises(W.WideError):
        W.column_map(["date", "close"])


def test_repeated_cells_are_refused(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 1.0), ("2024-01-01", "a", 2.0), ("2024-01-01", "b", 2.0)], "date string, ticker string, close double").selectExpr("cast(date AS date) AS date", "ticker", "close")
    with pytest.raises(Exception, match="several rows"):
        W.to_wide(df, ["close"]).collect()


def test_strips_side_by_side(spark, frame, tmp_path):
    long = W.from_wide(spark.createDataFrame(frame.set_axis([str(c) for c in frame.columns], axis=1).reset_index()))
    path = str(tmp_path / "strips")
    W.write_wide(long, path, columns=100)
    assert W.strips(spark, path) == [path]
    W.write_wide(long, path, columns=20)
    found = W.strips(spark, path)
    assert len(found) == 3 and all(len(spark.read.parquet(p).columns) <= 21 for p in found)
    for keep in (False, True):
        back = W.read_wide(spark, path, group=3, keep_missing=keep)
        kept = [r for r in back.collect() if keep or r.close is not None or r.volume is not None or r.open is not None or r.high is not None or r.low is not None]
        tickers = {r.ticker for r in long.collect()}
        assert len(kept) == (6 * len(tickers) if keep else long.count())
    assert sorted(map(repr, W.read_wide(spark, path, group=3).collect())) == sorted(map(repr, long.collect()))


def test_number_of_scans_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "SCANS", 4)
    rows = spark.range(100).selectExpr("date'2024-01-01' AS date", "concat('T', id) AS ticker", "cast(id AS double) AS close")
    W.write_wide(rows, str(tmp_path / "out"), ["close"])
    back = W.read_wide(spark, str(tmp_path / "out"), ["close"], group=2)
    assert back._jdf.queryExecution().executedPlan().toString().count("FileScan") == 4
    assert sorted(r.close for r in back.collect()) == [float(i) for i in range(100)]


def test_plan_of_strips_does_not_grow_with_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_CELLS", 40)
    rows = spark.range(600).selectExpr("date_add(date'2024-01-01', cast(id % 6 AS int)) AS date", "concat('T.', id div 6) AS ticker", "cast(id AS double) AS close", "if(id % 4 = 0, null, cast(id AS int)) AS volume")
    path = str(tmp_path / "out")
    W.write_wide(rows, path, ["close", "volume"], columns=20)
    assert len(W.strips(spark, path)) == 10
    back = W.read_wide(spark, path, ["close", "volume"], group=2)
    text = back._jdf.queryExecution().toString()
    assert text.count("FileScan") == 1 and "('Close'" not in text
    got = {(r.date, r.ticker): (r.close, r.volume) for r in back.collect()}
    assert got == {(r.date, r.ticker): (r.close, r.volume) for r in rows.collect()}
    assert {r.volume for r in W.read_wide(spark, path, ["volume"]).collect()} == {float(i) for i in range(600) if i % 4}
