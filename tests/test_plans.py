"""The shape of physical plans, and rules the source keeps."""

from __future__ import annotations

import glob
import math
import os
import pathlib
import re
import time
import types

from pyspark.sql import functions as F

from crosspanel.operators import cross as X
from crosspanel.operators import models as M
from crosspanel.operators import rolling as R
from crosspanel.plans import families as FM
from crosspanel.plans import featureset as FS
from crosspanel.plans import indicators as I
from crosspanel.plans.featureset import build
from crosspanel.session import discard, materialise, options, scratch_path

ROOT = pathlib.Path(__file__).resolve().parents[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (hash|range|Single)", plan(df)))


def test_ticker_windows_share_one_exchange(grid):
    g = materialise(grid)
    df = g.withColumn("r1", R.pct_change("close")).withColumns({"a": R.mean("r1", 20), "b": R.std("r1", 60), "c": R.ffill("close")})
    assert exchanges(df) == 1


def test_date_columns_share_one_exchange(grid):
    g = materialise(grid)
    df = X.pct_rank(g, X.DATE, {"a": "close", "b": "volume"}, 12)
    df = X.group_stats(df, X.DATE, {"m": F.avg("close")}, 12)
    df = X.pct_rank(df, X.PEERS, {"c": "close"}, 12)
    assert exchanges(df) == 1


def test_main_set_plans_three_exchanges(grid):
    assert exchanges(I.v3(materialise(grid), 12)) == 3


def test_families_in_one_pass_plan_four_exchanges(grid):
    # ticker, date, ticker (peer residuals), date (their ranks)
    assert exchanges(build(materialise(grid), FM.FAMILIES, 12)) <= 4


def test_scan_reads_only_the_needed_columns(grid):
    text = plan(materialise(grid).select("ticker", "t", R.pct_change("close")))
    assert "ReadSchema: struct<ticker:string,close:double,t:int>" in text.replace(" ", " ")


def test_large_groups_do_not_meet_in_a_window(grid):
    big = X.WINDOW_ROWS + 1
    text = plan(X.group_stats(materialise(grid), X.DATE, {"m": F.avg("close")}, big))
    assert "Window" not in text


def test_source_rules():
    for path in [*ROOT.glob("crosspanel/**/*.py"), *ROOT.glob("catalog/*.py")]:
        code = path.read_text()
        for word in ("localCheckpoint", "crossJoin", ".rdd", "toPandas("):
            assert word not in code, (path, word)


def test_registry_is_complete():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and entry.FLAGSHIP in queries
    assert len(queries) > 200 and len(queries) - len(sql) < 20


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_package_is_shipped_once(spark):
    from crosspanel.session import ship_package, tune

    tune(spark)
    before = len(spark.sparkContext.listFiles)
    ship_package(spark)
    assert len(spark.sparkContext.listFiles) == before
    assert any(f.endswith("crosspanel.zip") for f in spark.sparkContext.listFiles)


def test_own_ranks_carry_only_what_is_read_later(grid):
    df = build(materialise(grid), FM.FAMILIES, 12)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    carried = {c.split("#")[0] for c in re.search(r"MapInArrow run\(([^)]*)\)", text).group(1).split(", ")}
    assert {"date", "ticker", "vol_20d", "r1", "dd_60d"} <= carried
    assert not {"hl", "hi_252", "lo_252", "open", "volume"} & carried


def test_a_written_table_leaves_no_shuffle_files(grid):
    disk = grid.sparkSession.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {str(f) for f in map(str, _listed(disk.getAllFiles())) if "shuffle_" in f}
    before = shuffled()
    written = materialise(grid.groupBy("t").agg(F.max("close").alias("top")), "top")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and written.count() == grid.select("t").distinct().count()


def _listed(found):
    return [found.apply(i) for i in range(found.size())]


def test_options_hold_inside_the_block_alone(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    with options(spark, {key: "false"}):
        assert spark.conf.get(key) == "false"
    assert spark.conf.get(key) == "true"


def test_shuffled_labels_move_the_wide_rows_once_and_leave_no_copy(grid, monkeypatch):
    seen = {}

    class Model:
        def score(self, df):
            return df.withColumn("prediction", F.lit(0))

    def kept(df, name, as_dealt=False):
        with options(df.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": str(not as_dealt).lower()}):
            seen["exchanges"] = exchanges(df.select("*"))
        return materialise(df, name)

    monkeypatch.setattr(M, "materialise", kept)
    train = materialise(grid.withColumn("target", F.col("t") % 3), "train")
    out = M.shuffled_label_accuracy(train, train, ["close"], lambda t, f: seen.update(rows=t.count()) or Model()).first()
    assert seen == {"exchanges": 2, "rows": train.count()} and 0 < out.accuracy <= out.reference
    assert not glob.glob(os.path.dirname(scratch_path(grid.sparkSession, "any")) + "/shuffled-*")
    discard(train)


def test_many_columns_of_many_tickers_stay_where_they_are(grid, monkeypatch):
    g = materialise(grid.withColumn("category", F.when(F.col("ticker") != "T03", F.col("category"))))  # one ticker without a category
    few = {(r.date, r.ticker): r for r in build(g, FM.FAMILIES, 12).collect()}
    monkeypatch.setattr(FS, "APART_ROWS", 12)
    widths = []

    def spied(df, keys, columns, group_rows, carry):
        widths.append(len(df.columns))
        return X.pct_rank(df, keys, columns, group_rows, carry)

    monkeypatch.setattr(FS, "X", types.SimpleNamespace(**{**vars(X), "pct_rank": spied}))
    apart = build(g, FM.FAMILIES, 12)
    assert exchanges(apart) == 1 and apart.columns == build(materialise(g), FM.FAMILIES, 11).columns and widths[0] < 32
    many = apart.collect()
    assert len(many) == len(few) == grid.count()
    for r in many:
        for c, a, b in zip(apart.columns, r, few[r.date, r.ticker]):
            assert a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)), (c, a, b)
    monkeypatch.setattr(FS, "COPIED_GROUPS", 0)
    assert build(g, FM.FAMILIES, 12).agg(F.count("beta_catrank"), F.count("cat_n")).first() == apart.agg(F.count("beta_catrank"), F.count("cat_n")).first()
