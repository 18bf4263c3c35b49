"""News articles: JSON lines, publication days, de-duplication, daily features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.expr import col

SCHEMA = (
    "id STRING, title STRING, description STRING, published_utc STRING, "
    "headline STRING, summary STRING, datetime LONG, query_ticker STRING, _bad STRING"
)


def parse_date(epoch=None, iso=None) -> Column:
    """Publication day in UTC from epoch seconds or an ISO string."""
    from_epoch = F.to_date(F.timestamp_seconds(col(epoch))) if epoch is not None else F.lit(None).cast("date")
    from_iso = F.to_date(F.try_to_timestamp(col(iso))) if iso is not None else F.lit(None).cast("date")
    return F.coalesce(from_epoch, from_iso)


def parse_articles(lines: DataFrame, source: str, line: str = "value") -> DataFrame:
    """Articles from JSON text lines; unreadable lines and lines without an id are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    j = lines.select(F.from_json(line, SCHEMA, options).alias("j")).select("j.*")
    text = F.trim(
        F.concat_ws(" ", F.coalesce("title", "headline", F.lit("")), F.coalesce("description", "summary", F.lit("")))
    )
    return j.filter(F.col("_bad").isNull() & F.col("id").isNotNull() & (F.col("id") != "")).select(
        F.lit(source).alias("source"),
        "id",
        F.col("query_ticker").alias("ticker"),
        parse_date("datetime", "published_utc").alias("published"),
        text.alias("text"),
    )


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last by ``order``.

    An aggregate instead of a window, so a key with very many copies is thinned
    out before the shuffle.
    """
    place = F.struct(*order)
    whole = F.struct(*[c for c in df.columns if c not in keys])
    pick = F.min_by(whole, place) if keep == "first" else F.max_by(whole, place)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """Mean and count of article scores per (date, ticker), and the same over the
    ticker's own last five news days (not calendar days)."""
    day = scored.groupBy("date", "ticker").agg(
        F.avg("sent").alias("news_sent_1d"), F.count(F.lit(1)).cast("double").alias("news_n_1d")
    )
    own = Window.partitionBy("ticker").orderBy("date").rowsBetween(-4, 0)
    return day.withColumns(
        {"news_sent_5d": F.avg("news_sent_1d").over(own), "news_n_5d": F.sum("news_n_1d").over(own)}
    )


def date_chunks(ranges: DataFrame, start: str = "start", end: str = "end", days: int = 365) -> DataFrame:
    """Split [start, end] into consecutive request windows of at most ``days`` days."""
    starts = F.sequence(F.col(start), F.col(end), F.make_dt_interval(F.lit(days)))
    out = ranges.withColumn("chunk_start", F.explode(starts))
    return out.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(end)))


def date_ranges(prices: DataFrame, last: Column | str) -> DataFrame:
    """First and last priced day per ticker, the end capped; empty ranges dropped."""
    live = F.when(F.col("close").isNotNull(), F.col("date"))
    cap = F.lit(last).cast("date") if isinstance(last, str) else last
    out = prices.groupBy("ticker").agg(F.min(live).alias("start"), F.least(F.max(live), cap).alias("end"))
    return out.filter(F.col("start") <= F.col("end"))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work not yet listed in the status table."""
    return work.join(done.select(*keys), keys, "left_anti")
