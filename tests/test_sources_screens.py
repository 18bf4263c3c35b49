from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import cross as X
from crosspanel.operators import models as M
from crosspanel.operators import peers as G
from crosspanel.operators import rolling as R
from crosspanel.operators import screen as S
from crosspanel.sources import news as N
from crosspanel.sources import panel as P
from crosspanel.sources import uploads as U
from crosspanel.streaming import incremental as I
from crosspanel.streaming import scores as SS

GOOD = [("2024-01-02", "aa", "2", "1", "1.5", "10"), ("2024-01-03", "aa", "2", "1", "x", "10")]
COLS = "Date string, Symbol string, High string, Low string, `Adj Close` string, Volume string"


def test_upload_aliases_and_coercion(spark):
    out = U.parse_upload(spark.createDataFrame(GOOD, COLS)).orderBy("date").collect()
    assert [r["ticker"] for r in out] == ["AA", "AA"]
    assert [r["close"] for r in out] == [1.5, None]


@pytest.mark.parametrize("rows,cols,word", [
    ([("2024-01-02", "a", "1")], "date string, ticker string, high string", "missing"),
    ([("nope", *GOOD[0][1:]), GOOD[1]], COLS, "date"),
    ([GOOD[0], GOOD[0], GOOD[1]], COLS, "more than once"),
    ([GOOD[0]], COLS, "two dates"),
])
def test_upload_rejections(spark, rows, cols, word):
    with pytest.raises(U.UploadError, match=word):
        U.parse_upload(spark.createDataFrame(rows, cols))


def test_articles_skip_bad_lines(spark):
    lines = ['{"id": "1", "title": "a", "description": "b", "published_utc": "2024-05-01T21:00:00Z"}', '{"id": "2", "ti',
             '{"title": "no id"}', '{"id": "3", "headline": "h", "summary": "s", "datetime": 1714600000}']
    out = N.parse_articles(spark.createDataFrame([(x,) for x in lines], "value string"), "w").orderBy("id").collect()
    assert [(r["id"], r["text"], str(r["published"])) for r in out] == [("1", "a b", "2024-05-01"), ("3", "h s", "2024-05-01")]


def test_dedupe_keeps_first_and_last(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 5, "z")], "id string, o int, v string")
    first = {r["id"]: r["v"] for r in N.dedupe(df, ["id"], ["o"]).collect()}
    last = {r["id"]: r["v"] for r in N.dedupe(df, ["id"], ["o"], "last").collect()}
    assert first == {"k": "a", "j": "z"} and last == {"k": "b", "j": "z"}


def test_refresh_equals_full_recompute(grid):
    def compute(df):
        return df.select("date", "ticker", R.mean("close", 20).alias("m"))

    full = compute(grid)
    held = full.filter(F.col("date") < F.lit("2023-03-01").cast("date"))
    out = held.unionByName(I.refresh(grid, held, compute, 20))
    key = lambda df: sorted((r["date"], r["ticker"], r["m"] and round(r["m"], 9)) for r in df.collect())
    assert key(out) == key(full)


def test_ingest_resumes(spark, tmp_path):
    work = spark.createDataFrame([("a",), ("b",), ("c",), ("empty",)], "ticker string")
    status, data = str(tmp_path / "s"), str(tmp_path / "d")
    source = spark.createDataFrame([(t, n) for t in "abc" for n in range(3)], "ticker string, n int")
    load = lambda todo: source.join(todo, "ticker", "left_semi")
    I.ingest(work.limit(0), status, data, load)
    I.land(work.filter("ticker IN ('a', 'b')"), data, load)  # a run that dies before its status
    I.ingest(work.filter("ticker IN ('b', 'c')"), status, data, load)
    I.ingest(work, status, data, load)
    I.ingest(work, status, data, lambda todo: 1 / 0)  # nothing is left to load
    assert sorted((r["ticker"], r["n"]) for r in spark.read.parquet(data).collect()) == [(t, n) for t in "abc" for n in range(3)]
    assert sorted(tuple(r) for r in spark.read.parquet(status).collect()) == [("a", 3), ("b", 3), ("c", 3), ("empty", 0)]


def test_ingest_repeats_what_died_halfway(spark, tmp_path):
    work = spark.createDataFrame([("a",), ("b",)], "ticker string")
    status, data = str(tmp_path / "s"), str(tmp_path / "d")

    def dies(todo):
        return todo.withColumn("n", F.when(F.col("ticker") == "b", F.raise_error(F.lit("lost"))).otherwise(F.lit(1)))

    with pytest.raises(Exception, match="lost"):
        I.ingest(work, status, data, dies)
    I.ingest(work, status, data, lambda todo: todo.withColumn("n", F.lit(1)))
    assert sorted(r["ticker"] for r in spark.read.parquet(data).collect()) == ["a", "b"]


def test_stream_resumes_and_corrects_late_windows(spark, tmp_path):
    source, target, point = (str(tmp_path / n) for n in "stc")
    rows = lambda *r: spark.createDataFrame(r, "k string, at string, v double").select("k", F.to_timestamp("at").alias("ts"), "v")
    go = lambda: SS.run(spark, source, rows(("a", "2024-01-01", 1.0)).schema, target, point, "ts", ["k"], "v")
    rows(("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 02:00:00", 2.0), ("b", "2024-01-02 01:00:00", 5.0)).coalesce(1).write.mode("append").parquet(source)
    go()
    go()  # nothing new
    rows(("a", "2024-01-01 03:00:00", 4.0), ("a", "2024-01-03 00:00:00", None)).coalesce(1).write.mode("append").parquet(source)
    go()
    got = {(r.k, r.window_start.day): (r.n, r.total, r.low, r.high, r.latest) for r in SS.table(spark, target, ["k"]).collect()}
    assert got == {("a", 1): (3, 7.0, 1.0, 4.0, 4.0), ("b", 2): (1, 5.0, 5.0, 5.0, 5.0), ("a", 3): (0, None, None, None, None)}


def test_pairs_reach_every_member(spark):
    rows = [("2024-01-01", f"t{k}", "big" if k > 2 else "pair" if k else "alone", float(k)) for k in range(40)] + [("2024-01-01", "none", "big", None)]
    df = spark.createDataFrame(rows, "date string, ticker string, category string, rel double")
    for group_rows in (100, X.WINDOW_ROWS + 1):
        pairs = G.sample_pairs(df, "rel", 3, group_rows).collect()
        members = {r.ticker for r in pairs}
        assert members == {f"t{k}" for k in range(1, 40)}
        assert len({(r.ticker, r.other) for r in pairs}) == len(pairs) == 37 * 3 + 2
        assert all(r.ticker != r.other and r.rel == float(r.ticker[1:]) and r.other_rel == float(r.other[1:]) for r in pairs)


def test_keyset_pages_equal_offsets(spark):
    rows = [(f"t{k:02d}", None if k % 5 == 0 else float(k % 4)) for k in range(23)]
    df = spark.createDataFrame(rows, "ticker string, score double").repartition(3)
    for asc in (True, False):
        starts = {r.page: (r.value, r.ticker) for r in S.page_starts(df, "score", asc, 5).collect()}
        assert set(starts) == {2, 3, 4, 5}
        after = None
        for p in range(5):
            want = [r["ticker"] for r in S.sort_page(df, "score", asc, p * 5, 5).collect()]
            page = S.page_after(df, "score", asc, after, 5).collect()
            assert [r.ticker for r in page] == want
            assert p == 0 or starts[p + 1] == after
            after = (page[-1].score, page[-1].ticker)
    assert S.page_starts(df.limit(0), "score", True).count() == 0
    with pytest.raises(S.UnknownSort):
        S.page_after(df, "secret", True)


@pytest.mark.parametrize("q", ["gold", "g", "go", "GOLD", "gold sh", "xgoldx", "nothing", " ", "spdr gold shares"])
def test_index_finds_what_a_scan_finds(spark, q, tmp_path):
    df = spark.createDataFrame(UNIVERSE, "ticker string, name string, category string")
    S.write_search_index(df, str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    assert S.search_indexed(df, index, q).collect() == S.search(df, q).collect()


def test_index_is_written_by_the_tasks_of_its_searched_rows(spark, tmp_path):
    rows = [(f"T{k}", f"Fund {k} of gold", "Metals") for k in range(200)]
    df = spark.createDataFrame(rows, "ticker string, name string, category string").coalesce(1)
    S.write_search_index(df, str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    files = index.select("ticker", S.F.input_file_name().alias("file")).distinct().collect()
    assert len(files) == 200 and len({r.file for r in files}) == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, S.search_index(df).collect()))


def test_panel_round_trip(grid, spark, tmp_path):
    P.write_panel(grid.select("date", "ticker", "close"), str(tmp_path / "p"))
    back = P.read_ohlcv(spark, str(tmp_path / "p"))
    assert back.count() == grid.count()
    assert dict(spark.read.parquet(str(tmp_path / "p")).dtypes)["close"] == "float"


UNIVERSE = [("GOLD", "Miner Fund", "Mining"), ("GLD", "SPDR Gold Shares", "Commodity"), ("GSB", "Goldman Bond", "Bonds"),
            ("XGOLDX", "Other", "Other"), ("MAR", "Marigold Trust", "Other"), ("COM", "Broad", "Gold Commodities"), ("ZZZ", "None", "None")]


def test_search_buckets(spark):
    meta = spark.createDataFrame(UNIVERSE, "ticker string, name string, category string")
    out = [(r["ticker"], r["bucket"]) for r in S.search(meta, " gold ").collect()]
    assert out == [("GOLD", 0), ("GLD", 2), ("GSB", 3), ("XGOLDX", 4), ("MAR", 5), ("COM", 6)]


def test_search_text_is_literal(spark):
    meta = spark.createDataFrame([("A", "a.c (x)", "c"), ("B", "abc x", "c")], "ticker string, name string, category string")
    assert [r["ticker"] for r in S.search(meta, "a.c").collect()] == ["A"]
    assert [r["ticker"] for r in S.search(meta, "(x)").collect()] == ["A"]
    assert S.search(meta, "  ").count() == 0


def test_pages_neither_drop_nor_repeat(spark):
    df = spark.createDataFrame([(f"t{i}", float(i % 3) if i % 4 else None) for i in range(23)], "ticker string, score double")
    for asc in (True, False):
        pages = [r["ticker"] for p in range(5) for r in S.sort_page(df, "score", asc, p * 5, 5).collect()]
        assert len(pages) == 23 and len(set(pages)) == 23
        assert {pages[-1], pages[-2]} <= {f"t{i}" for i in range(0, 23, 4)}
    with pytest.raises(S.UnknownSort):
        S.sort_page(df, "secret", True)


def test_model_contract(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), i % 3) for i in range(90)], "a double, b double, target int")
    model = M.logistic(df, ["a", "b"], max_iter=5)
    out = model.score(df)
    assert out.filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count() == 0
    with pytest.raises(M.MissingColumns):
        model.score(df.drop("b"))
