"""Sources, sinks and shape changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import r, rs
from catalog.registry import query
from crosspanel.operators import rolling as R
from crosspanel.session import materialise, scratch_path
from crosspanel.sources import news as N
from crosspanel.sources import panel as P
from crosspanel.sources import uploads as U
from crosspanel.sources import wide as W
from crosspanel.streaming import incremental as I


scratch = scratch_path


@query("S1", f"""{B.OHLCV_SQL}
SELECT date, ticker, field, {r('value')} FROM ohlcv UNPIVOT (value FOR field IN (open, high, low, close, volume))""")
def ohlcv_long_fields(spark, sf):
    return B.ohlcv(spark, sf).unpivot(["date", "ticker"], P.FIELDS, "field", "value")


WIDE_GRID = f"{B.OHLCV_SQL}, g AS (SELECT date, ticker FROM (SELECT DISTINCT date FROM ohlcv) CROSS JOIN (SELECT DISTINCT ticker FROM ohlcv))"


def wide_file(spark, sf):
    path = scratch(spark, "wide")
    W.write_wide(B.ohlcv(spark, sf), path)
    return path


@query("S1 S4", f"{WIDE_GRID} SELECT date, ticker, {rs(*P.FIELDS)} FROM g LEFT JOIN ohlcv USING (date, ticker)")
def wide_round_trip(spark, sf):
    """All prices to a wide file, a column for each field and ticker, and back; missing cells stay as rows."""
    return W.read_wide(spark, wide_file(spark, sf), keep_missing=True, group=7)


@query("S1", f"{B.OHLCV_SQL} SELECT date, ticker, {rs('close', 'volume')} FROM ohlcv")
def wide_file_rows(spark, sf):
    """Two fields of a wide file as long rows, without the missing cells."""
    return W.read_wide(spark, wide_file(spark, sf), ["close", "volume"])


@query("S14", f"{B.OHLCV_SQL} SELECT year(date) AS year, count(*) AS n, {r('sum(close)', 'total', 2)} FROM ohlcv GROUP BY 1")
def resumed_ingest(spark, sf):
    """Years loaded in three runs: the first dies after its data, before its status; every row is there once."""
    bars = materialise(B.ohlcv(spark, sf), "bars").withColumn("year", F.year("date"))
    years, status, data = bars.select("year").distinct(), scratch(spark, "status"), scratch(spark, "data")
    load = lambda todo: bars.join(todo, "year", "left_semi")
    I.land(years.filter("year % 3 = 0"), data, load)
    I.ingest(years.filter("year % 2 = 0"), status, data, load)
    I.ingest(years, status, data, load)
    return spark.read.parquet(data).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("total"))


@query("S14", f"{B.OHLCV_SQL} SELECT year(date) AS year, count(*) AS n_rows FROM ohlcv GROUP BY 1 UNION ALL SELECT 1900, 0")
def ingest_status(spark, sf):
    """The status table of such a load: every key once, with the rows that landed; a key without rows has 0."""
    bars = materialise(B.ohlcv(spark, sf), "bars").withColumn("year", F.year("date"))
    years, status, data = bars.select("year").union(spark.range(1).select(F.lit(1900))).distinct(), scratch(spark, "status"), scratch(spark, "data")
    load = lambda todo: bars.join(todo, "year", "left_semi")
    I.ingest(years.filter("year < 1999"), status, data, load)
    I.land(years.filter("year = 2000"), data, load)
    I.ingest(years, status, data, load)
    I.ingest(years, status, data, load)
    return spark.read.parquet(status)


@query("S2 U6", f"""{B.META.replace('meta AS', 'WITH meta AS', 1)}
SELECT ticker, name, coalesce(category_group, 'Uncategorized') AS category_group,
       coalesce(category, 'Uncategorized') AS category, family, currency, exchange, is_leveraged FROM meta""")
def metadata_columns(spark, sf):
    return P.fill_category(P.read_metadata(B.metadata(spark, sf)))


@query("S3 U9", f"{B.DAILY_SQL} SELECT date, t, ticker, {r('close')} FROM panel")
def dense_daily_close(spark, sf):
    return B.panel(spark, sf, B.daily(spark, sf)).select("date", "t", "ticker", "close")


# fixed list: the five region names of the tables
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("S4", f"""{B.PANEL_SQL}
SELECT date, {', '.join(r(f"avg(close) FILTER (category = '{c}')", f'"{c}"') for c in REGIONS)}
FROM panel GROUP BY date""")
def pivot_category_close(spark, sf):
    return B.panel(spark, sf).groupBy("date").pivot("category", REGIONS).agg(F.avg("close"))


@query("S5", f"""{B.OHLCV_SQL}
SELECT date, ticker, {rs('high', 'low', 'close')},
       CASE WHEN cast(volume AS bigint) % 7 = 0 THEN NULL ELSE volume END + 0.0 AS volume FROM ohlcv""")
def upload_rows(spark, sf):
    text = B.ohlcv(spark, sf).select(
        F.date_format("date", "yyyy-MM-dd").alias(" Date"),
        F.concat(F.lit(" "), F.lower("ticker")).alias("Symbol"),
        F.col("high").cast("string").alias("HIGH"),
        F.col("low").cast("string").alias("Low "),
        F.col("close").cast("string").alias("Adj Close"),
        F.when(F.col("volume").cast("long") % 7 == 0, "n/a").otherwise(F.col("volume").cast("string")).alias("Volume"),
    )
    return U.parse_upload(text)


def article_lines(spark, sf):
    """One JSON line per document, mixed with lines that lack an id and lines that are not JSON."""
    d = B.table(spark, sf, "documents")
    ticker = F.concat(F.lit("F"), F.lpad(F.pmod("doc_id", F.lit(25)).cast("string"), 9, "0"))
    published = F.concat(
        F.date_format(F.date_add(F.lit("1999-01-04").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int")), "yyyy-MM-dd"),
        F.lit("T21:30:00Z"),
    )
    body = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("title"),
        F.col("text").alias("description"),
        published.alias("published_utc"),
        ticker.alias("query_ticker"),
    )
    no_id = B.table(spark, sf, "events").select(F.col("props").alias("value"))
    not_json = B.table(spark, sf, "pages").select(F.col("html").alias("value"))
    return d.select(F.to_json(body).alias("value")).unionByName(no_id).unionByName(not_json)


@query("S6 S7", """
SELECT 'wire' AS source, cast(doc_id AS varchar) AS id, 'F' || lpad(cast(doc_id % 25 AS varchar), 9, '0') AS ticker,
       DATE '1999-01-04' + cast(doc_id % 400 AS integer) AS published, md5(trim(source || ' ' || text, ' ')) AS digest
FROM documents""")
def article_parse(spark, sf):
    a = N.parse_articles(article_lines(spark, sf), "wire")
    return a.withColumn("digest", F.md5("text")).drop("text")


@query("S7", """
SELECT event_id, cast(ts AS date) AS from_epoch, cast(ts AS date) AS from_iso FROM events""")
def article_day(spark, sf):
    e = B.table(spark, sf, "events").select(
        "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
    )
    return e.select("event_id", N.parse_date(epoch="epoch").alias("from_epoch"), N.parse_date(iso="iso").alias("from_iso"))


@query("S9", f"""{B.OHLCV_SQL} SELECT year(date) AS year, count(*) AS n, {r('sum(close)', 'total', 2)}
FROM ohlcv GROUP BY 1""")
def parquet_stage(spark, sf):
    path = scratch(spark, "stage")
    P.write_panel(B.ohlcv(spark, sf), path, as_float=False)
    back = P.read_ohlcv(spark, path)
    return back.groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("total")
    )


@query("S10", f"""{B.META.replace('meta AS', 'WITH meta AS', 1)}
SELECT category, cast(count(*) AS varchar) AS members FROM meta GROUP BY 1""")
def report_sink(spark, sf):
    path = scratch(spark, "report")
    P.write_report(B.metadata(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("members")), path, "csv")
    return spark.read.option("header", True).csv(path)


@query("S10", f"""{B.META.replace('meta AS', 'WITH meta AS', 1)}
SELECT category, count(*) AS members FROM meta GROUP BY 1""")
def json_report(spark, sf):
    path = scratch(spark, "report")
    P.write_report(B.metadata(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("members")), path)
    return spark.read.schema("category string, members long").json(path)


@query("S10", f"""{B.META.replace('meta AS', 'WITH meta AS', 1)}
SELECT '| ' || category || ' | ' || count(*) || ' |' AS value FROM meta GROUP BY category""")
def markdown_report(spark, sf):
    path = scratch(spark, "report")
    P.markdown_table(B.metadata(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("members")), path)
    return spark.read.text(f"{path}/part=1")


@query("S12 J14", f"""{B.OHLCV_SQL} SELECT date, ticker, {r('CASE WHEN year(date) % 2 = 0 AND month(date) > 6 THEN close + 1 ELSE close END', 'close')}, {rs('volume')} FROM ohlcv""")
def combined_batches(spark, sf):
    """Three batches that overlap; of clashing rows the last batch's stays."""
    b = B.ohlcv(spark, sf).select("date", "ticker", "close", "volume")
    odd, even, late = F.year("date") % 2 == 1, F.year("date") % 2 == 0, F.month("date") > 6
    corrected = b.filter(even & late).withColumn("close", F.col("close") + 1)
    return P.combine_batches([b.filter(odd | late), b.filter(even), corrected])


@query("S13", f"""{B.PANEL_SQL}, a AS (SELECT *, {B.chg('close')} AS r1 FROM panel)
, b AS (SELECT *, {B.roll('avg', 'r1', 20)} AS mean_20, {B.roll('stddev_samp', 'r1', 20)} AS vol_20 FROM a)
SELECT date, ticker, {rs('mean_20', 'vol_20')} FROM b""")
def incremental_refresh(spark, sf):
    grid = B.panel(spark, sf)

    def compute(df):
        df = df.withColumn("r1", R.pct_change("close"))
        return df.select("date", "ticker", R.mean("r1", 20).alias("mean_20"), R.std("r1", 20).alias("vol_20"))

    held = compute(grid.filter(F.col("date") < F.lit("2000-01-01").cast("date")))
    return held.unionByName(I.refresh(grid, held, compute, lookback=20))


@query("S14 J9", f"""{B.OHLCV_SQL}, listed AS (SELECT DISTINCT ticker FROM ohlcv)
SELECT ticker FROM listed WHERE ticker NOT IN (SELECT ticker FROM meta WHERE is_leveraged OR exchange IS NULL)""")
def remaining_keys(spark, sf):
    work = B.ohlcv(spark, sf).select("ticker").distinct()
    done = B.metadata(spark, sf).filter(F.col("is_leveraged") | F.col("exchange").isNull())
    return N.remaining(work, done, ["ticker"])


@query("S15", f"""{B.OHLCV_SQL}
SELECT * FROM (SELECT ticker, min(date) AS start, least(max(date), DATE '2001-06-29') AS "end" FROM ohlcv GROUP BY 1)
WHERE start <= "end\"""")
def ticker_date_ranges(spark, sf):
    return N.date_ranges(B.ohlcv(spark, sf), "2001-06-29")


@query("S16", f"""{B.OHLCV_SQL}, g AS (SELECT ticker, min(date) AS start, max(date) AS "end" FROM ohlcv GROUP BY 1)
SELECT ticker, start, "end", cast(c AS date) AS chunk_start, least(cast(c AS date) + 364, "end") AS chunk_end
FROM (SELECT *, unnest(generate_series(start, "end", INTERVAL 365 DAY)) AS c FROM g)""")
def request_windows(spark, sf):
    return N.date_chunks(N.date_ranges(B.ohlcv(spark, sf), F.lit("9999-12-31").cast("date")))


def _copies(spark, sf):
    return B.table(spark, sf, "documents").select(F.md5("text").alias("id"), "doc_id", "source", "n_chars")


@query("S17", """
WITH d AS (SELECT md5(text) AS id, doc_id, source, n_chars FROM documents)
SELECT id, doc_id, source, n_chars FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1""")
def first_copy(spark, sf):
    return N.dedupe(_copies(spark, sf), ["id"], ["doc_id"])


@query("S17", """
WITH d AS (SELECT md5(text) AS id, doc_id, source, n_chars FROM documents)
SELECT id, doc_id, source, n_chars FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1""")
def last_copy(spark, sf):
    return N.dedupe(_copies(spark, sf), ["id"], ["doc_id"], keep="last")
