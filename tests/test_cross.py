"""Cross-sectional primitives: both plans (window, split) against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crosspanel.operators import cross as X

WINDOW, SPLIT = 0, X.WINDOW_ROWS + 1


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({
        "date": rng.choice(["d1", "d2", "d3"], n, p=[0.6, 0.3, 0.1]),
        "ticker": [f"t{i:05d}" for i in rng.permutation(n)],
        "x": np.round(rng.normal(0, 1, n), 1),
        "y": rng.integers(0, 2, n).astype(float),
    })
    pdf.loc[rng.random(n) < 0.34, "x"] = 0.0  # a third of the rows share one value
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "date string, ticker string, x double, y double")
    return pdf.sort_values("ticker").reset_index(drop=True), df.repartition(5)


def fetch(df, *cols):
    return df.select("ticker", *cols).toPandas().sort_values("ticker").reset_index(drop=True)


@pytest.mark.parametrize("size", [WINDOW, SPLIT])
def test_pct_rank_matches_pandas(rows, size):
    pdf, df = rows
    got = fetch(X.pct_rank(df, ["date"], {"r": "x"}, size), "r")["r"].astype(float)
    want = pdf.groupby("date")["x"].rank(pct=True)
    np.testing.assert_allclose(got, want, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("size", [WINDOW, SPLIT])
def test_global_average_rank(rows, size):
    pdf, df = rows
    got = fetch(X.average_rank(df, [], {"r": "x"}, size), "r")["r"].astype(float)
    np.testing.assert_allclose(got, pdf["x"].rank(), rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("size", [WINDOW, SPLIT])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [["date"], []])
def test_ordinal_numbers_every_row_once(rows, size, descending, keys):
    pdf, df = rows
    got = fetch(X.ordinal(df, keys, "x", "o", descending, group_rows=size, size="n"), "o", "n")
    known = pdf.dropna(subset=["x"]).sort_values(["x", "ticker"], ascending=[not descending, True])
    place = known.groupby(keys).cumcount() + 1 if keys else pd.Series(np.arange(1, len(known) + 1), known.index)
    want = place.reindex(pdf.index).astype(float)
    np.testing.assert_array_equal(got["o"].astype(float), want)
    sizes = pdf.groupby(keys)["x"].transform("count") if keys else pd.Series(pdf["x"].count(), pdf.index)
    np.testing.assert_array_equal(got["n"].astype(float), sizes.astype(float))


@pytest.mark.parametrize("size", [WINDOW, SPLIT])
def test_quantiles_are_exact(rows, size):
    pdf, df = rows
    got = X.quantiles(df, ["date"], "x", {"a": 0.15, "m": 0.5, "b": 0.85}, size).toPandas().set_index("date").sort_index()
    want = pdf.groupby("date")["x"].quantile([0.15, 0.5, 0.85]).unstack()
    np.testing.assert_allclose(got[["a", "m", "b"]], want, rtol=1e-12)


@pytest.mark.parametrize("size", [WINDOW, SPLIT])
def test_group_statistics_and_leave_one_out(rows, size):
    pdf, df = rows
    df = X.add_loo(df, ["date"], {"loo": "x"}, False, size)
    df = X.add_loo(df, ["date"], {"own": "x"}, True, size)
    df = X.group_stats(df, ["date"], {"m": F.avg("x"), "n": F.count("x")}, size)
    got = fetch(df, "loo", "own", "m", "n")
    g = pdf.groupby("date")["x"]
    s, n = g.transform("sum"), g.transform("count")
    loo = (s - pdf["x"].fillna(0)) / (n - pdf["x"].notna())
    np.testing.assert_allclose(got["loo"].astype(float), loo, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(got["own"].astype(float), loo.where(pdf["x"].notna()), rtol=1e-9, atol=1e-12, equal_nan=True)
    np.testing.assert_allclose(got["m"].astype(float), g.transform("mean"), rtol=1e-9, atol=1e-12)


def test_ladder_running_totals(rows):
    pdf, df = rows
    got = X.ladder(df, [], "x", {"pos": F.col("y").cast("long")}, edges=[-1.0, 0.0, 0.5]).toPandas().sort_values("x")
    want = pdf.dropna(subset=["x"]).groupby("x").agg(n=("y", "size"), pos=("y", "sum"))
    np.testing.assert_array_equal(got["n_le"], want["n"].cumsum())
    np.testing.assert_array_equal(got["pos_le"], want["pos"].cumsum())
    assert set(got["n_all"]) == {int(want["n"].sum())}


@pytest.mark.parametrize("n", [3, 4, 5, 7, 8, 10, 11, 20])
def test_first_rank_terciles(spark, n):
    df = spark.createDataFrame([("d", f"t{i:02d}", float(i // 2)) for i in range(n)], "date string, ticker string, x double")
    got = fetch(X.quantile_tile(df, ["date"], "x", "tile", 3, group_rows=0), "tile")["tile"].tolist()
    want = pd.qcut(pd.Series([i // 2 for i in range(n)]).rank(method="first"), 3, labels=False).tolist()
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float)), min_size=1, max_size=25))
def test_rank_property(spark, values):
    df = spark.createDataFrame([("d", f"t{i:02d}", v) for i, v in enumerate(values)], "date string, ticker string, x double")
    got = [fetch(X.pct_rank(df, ["date"], {"r": "x"}, s), "r")["r"].astype(float).to_numpy() for s in (WINDOW, SPLIT)]
    want = pd.Series(values, dtype=float).rank(pct=True)
    for g in got:
        np.testing.assert_allclose(g, want, equal_nan=True)


AWKWARD = "date string, category string, ticker string, x {kind}, _size int, _x int, _ord int, _row int, r double"


@pytest.fixture(params=["double", "bigint", "decimal(20,4)"])
def awkward(spark, request):
    """NULL keys, NULL values, NULL ties, ties, numbers beyond the precision of a double, and columns named like helpers."""
    rng = np.random.default_rng(4)
    small = [None, -3, 0, 0, 1, 2]
    big = small if request.param == "double" else [*small, 2**53, 2**53 + 1, 2**53 + 2]
    rows = []
    for i in range(160):
        v = big[rng.integers(len(big))]
        rows.append([None if i % 11 == 0 else f"d{i % 2}", None if i % 7 == 0 else "AB"[i % 3 > 0], None if i % 40 == 13 else f"t{i:03d}", v, i % 5, -i, 7, 8, 0.5])
    # a NULL tie may stand once for each value and group, or numbering is free
    seen = set()
    for r in rows:
        if r[2] is None and (key := (r[0], r[1], r[3])) in seen:
            r[2] = "t999"
        elif r[2] is None:
            seen.add(key)
    text = spark.createDataFrame([(a, b, c, None if v is None else str(v), *rest) for a, b, c, v, *rest in rows], AWKWARD.format(kind="string"))
    return text.withColumn("x", F.col("x").cast(request.param)).repartition(4)


CALLS = {
    "pct_rank": lambda df, k, g: X.pct_rank(df, k, {"r": "x", "r2": "x", "r3": "_size"}, g),
    "average_rank": lambda df, k, g: X.average_rank(df, k, {"a": "x"}, g),
    "ordinal": lambda df, k, g: X.ordinal(df, k, "x", "_ord", True, group_rows=g, size="n"),
    "ordinal_up": lambda df, k, g: X.ordinal(df, k, "x", "o", False, group_rows=g),
    "tile": lambda df, k, g: X.quantile_tile(df, k, "x", "tile", 3, group_rows=g),
    "group_stats": lambda df, k, g: X.group_stats(df, k, {"m": F.avg("x"), "_size": F.count("x")}, g),
    "loo": lambda df, k, g: X.add_loo(df, k, {"loo": "x"}, group_rows=g),
    "zscore": lambda df, k, g: X.zscore(df, k, {"z": "x"}, group_rows=g),
    "median": lambda df, k, g: X.group_median(df, k, {"med": "x", "r": "_size"}, g),
    "quantiles": lambda df, k, g: X.quantiles(df, k, "x", {"a": 0.15, "b": 0.5, "c": 0.9}, g),
    "top_n": lambda df, k, g: X.top_n(df, k, "x", F.greatest(F.floor(F.col(X.GROUP_SIZE) * 0.3), F.lit(1)), group_rows=g),
}


@pytest.mark.parametrize("call", CALLS)
@pytest.mark.parametrize("keys", [["date", "category"], []])
def test_both_plans_give_the_same_rows_and_schema(awkward, call, keys):
    small, large = (CALLS[call](awkward, keys, g) for g in (WINDOW, SPLIT))
    assert [(f.name, f.dataType) for f in small.schema] == [(f.name, f.dataType) for f in large.schema]
    tidy = lambda df: sorted((tuple(f"{v:.10g}" if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    assert tidy(small) == tidy(large)


def test_split_ordinal_joins_no_rows_back(spark, monkeypatch):
    monkeypatch.setattr(X, "WINDOW_ROWS", 0)
    rows = [(g, None if i % 7 == 0 else float(i % 5), f"t{i * 37 % 100:03d}") for g in ("a", None) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, x double, t string")
    split = X.ordinal(df, ["g"], "x", "place", True, "t", size="n")
    # one join, with the few places at which ranges of rows begin
    assert split._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    want = {}
    for g in ("a", None):
        known = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1], r[2]))
        want |= {r: (i, len(known)) for i, r in enumerate(known, 1)} | {r: (None, len(known)) for r in rows if r[0] == g and r[1] is None}
    assert {(r.g, r.x, r.t): (r.place, r.n) for r in split.collect()} == want


def test_deciles_compute_their_input_once(spark):
    from crosspanel.operators import evaluate as V

    df = spark.range(40).selectExpr("date_add(DATE '2024-01-01', int(id)) AS date", "'a' AS ticker", "double(id) AS rel", "double(-id) AS f")
    held = V.feature_deciles(df, ["f"])
    assert "Range (" not in held._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.rel, r.decile) for r in held.collect())[0] == (0.0, 10)


def test_ranks_of_groups_in_arrow(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"date": rng.integers(0, 6, 500), "category": rng.integers(0, 3, 500), "id": np.arange(500)})
    columns = {f"r{i}": f"x{i}" for i in range(4)}
    for x in columns.values():
        pdf[x] = rng.integers(0, 20, 500).astype(float)
    rows = [(None if r.category == 2 else int(r.category), int(r.date), int(r.id), *[None if getattr(r, x) < 3 else getattr(r, x) for x in columns.values()])
            for r in pdf.itertuples()]
    df = spark.createDataFrame([*rows, (1, 99, 500, None, None, None, None)], "category int, date int, id long, x0 double, x1 double, x2 double, x3 double")
    got = X.pct_rank(df, X.PEERS, columns, 500, carry=["id"])
    assert got.columns == ["id", *columns]
    assert "MapInArrow ranked(" in got._jdf.queryExecution().optimizedPlan().toString()
    want = X.pct_rank(df, X.PEERS, columns, 500).select("id", *columns)
    assert sorted(got.collect()) == sorted(want.collect())
