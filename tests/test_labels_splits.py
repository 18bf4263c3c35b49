from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import cross as X
from crosspanel.operators import labels as L
from crosspanel.operators import quality as Q
from crosspanel.operators import splits as S
from crosspanel.sources import panel as P


@pytest.fixture(scope="module")
def cal(grid):
    return P.calendar(grid)


def test_label_contract(grid, wide):
    lab = L.peer_tercile(grid, 5, 3, 12).toPandas()
    last = set(d.date() for d in wide.index[-5:])
    assert lab.loc[lab["date"].isin(last), "target"].isna().all()
    share = lab["target"].value_counts(normalize=True)
    assert share.max() < 0.45
    day = lab[(lab["date"] == wide.index[200].date()) & (lab["category"] == "A")].dropna(subset=["target"]).sort_values("rel")
    assert day["target"].is_monotonic_increasing
    assert set(lab["horizon"]) == {5}


def test_thin_category_has_no_label(grid):
    thin = grid.filter(F.col("ticker").isin("T00", "T01", "T06", "T07", "T08"))
    lab = L.peer_tercile(thin, 5, 3, 12)
    assert lab.filter((F.col("category") == "A") & F.col("target").isNotNull()).count() == 0
    assert lab.filter((F.col("category") == "B") & F.col("target").isNotNull()).count() > 0


@pytest.mark.parametrize("h,skip", [(5, 0), (10, 0), (12, 5)])
def test_horizon_is_recovered(grid, h, skip):
    stored = grid.withColumn("fwd_ret", L.forward_return(h, skip))
    got = L.measure_horizon(stored, range(1, 14), (0, 1, 5)).first()
    assert (got["horizon"], got["skip"]) == (h, skip) and got["corr"] > 0.999


def test_purge_is_exactly_the_horizon(cal, wide):
    cut = S.purge_cutoff(cal, "2023-01-01", 5).first()["cut"]
    first = wide.index[wide.index >= "2023-01-01"][0]
    assert wide.index.get_loc(pd.Timestamp(cut)) == wide.index.get_loc(first) - 5


def test_overlap_is_refused(cal, spark):
    good = S.folds(cal, [2023], 5)
    S.assert_no_overlap(cal, good, 5)
    with pytest.raises(S.OverlapError):
        S.assert_no_overlap(cal, good, 6)


def test_holdout_parts_keep_their_distance(cal, wide):
    got = S.holdout(cal, 2023, 5).toPandas()
    at = {d.date(): i for i, d in enumerate(wide.index)}
    ends = {r: [at[d] for d in got.loc[got["role"] == r, "date"]] for r in ("fit", "val", "test")}
    assert min(ends["val"]) - max(ends["fit"]) >= 5
    assert min(ends["test"]) - max(ends["val"]) == 5


def test_business_days(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(14)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (1, 4, 5, 12):
        got = [r[0] for r in df.select(Q.business_days_before("d", n)).collect()]
        assert got == [(pd.Timestamp(d) - pd.offsets.BDay(n)).date() for d in days]


def test_sample_is_stable_and_exact(grid):
    a = S.capped_sample(grid.select("date", "ticker"), 100, seed="x", rows=0)
    b = S.capped_sample(grid.select("date", "ticker").repartition(7), 100, seed="x", rows=X.WINDOW_ROWS + 1)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(a) == key(b) and a.count() == 100


def test_permutation_keeps_each_day(grid):
    got = S.permute_within_date(grid.select("date", "ticker", "close"), "close", "s", 12)
    days = lambda df: df.groupBy("date").agg(F.sum("close").alias("s"), F.count("close").alias("n"))
    diff = days(got).join(days(grid).withColumnsRenamed({"s": "s2", "n": "n2"}), "date")
    assert diff.filter((F.abs(F.col("s") - F.col("s2")) > 1e-6) | (F.col("n") != F.col("n2"))).count() == 0
    moved = got.join(grid.select("date", "ticker", F.col("close").alias("c")), ["date", "ticker"])
    assert moved.filter(F.col("close") != F.col("c")).count() > 1000
