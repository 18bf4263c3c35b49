"""From raw tables to the dense (date, ticker) grid every operator works on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.functions.expr import finite

FIELDS = ["open", "high", "low", "close", "volume"]
META_COLUMNS = [
    "name", "category_group", "category", "family", "currency", "exchange",
    "is_leveraged", "bad_ticks", "is_delisted",
]
UNCATEGORIZED = "Uncategorized"


def read_ohlcv(spark: SparkSession, path: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Long price table from parquet; NaN cells become NULL."""
    df = spark.read.parquet(path)
    present = [f for f in fields if f in df.columns]
    return df.select(F.col("date").cast("date").alias("date"), "ticker", *[finite(f).alias(f) for f in present])


def unpivot_wide(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Wide date x ticker matrix to long rows, keeping missing cells."""
    tickers = [c for c in df.columns if c != date]
    return df.unpivot(date, tickers, "ticker", value)


def pivot_wide(df: DataFrame, value: str, tickers: Sequence[str]) -> DataFrame:
    """Long rows to a wide matrix over a named list of tickers (an export shape)."""
    return df.groupBy("date").pivot("ticker", list(tickers)).agg(F.first(value, ignorenulls=True))


def read_metadata(df: DataFrame, columns: Sequence[str] = META_COLUMNS) -> DataFrame:
    """Entity metadata limited to the wanted columns that exist."""
    return df.select("ticker", *[c for c in columns if c in df.columns])


def fill_category(meta: DataFrame, columns: Sequence[str] = ("category", "category_group")) -> DataFrame:
    present = [c for c in columns if c in meta.columns]
    return meta.withColumns({c: F.coalesce(F.col(c), F.lit(UNCATEGORIZED)) for c in present})


def combine_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Stack downloaded batches and keep one row per (date, ticker): that of the last batch that has one.

    Rows of one batch that clash are told apart by their values, the greatest staying, so the result does not depend on partitioning.
    """
    out = None
    for i, b in enumerate(batches):
        b = b.withColumn("_batch", F.lit(i))
        out = b if out is None else out.unionByName(b)
    columns = [c for c in batches[0].columns if c not in ("date", "ticker")]
    row = F.struct("_batch", *columns)
    return out.groupBy("date", "ticker").agg(F.max(row).alias("_r")).select("date", "ticker", *[F.col("_r")[c].alias(c) for c in columns]).select(*batches[0].columns)


def calendar(df: DataFrame) -> DataFrame:
    """One row per trading date with its position t = 0, 1, ... (calendar-sized)."""
    dates = df.select("date").distinct()
    return dates.withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)


def calendar_array(df: DataFrame) -> DataFrame:
    """The whole calendar as one sorted array in one row."""
    return df.select("date").distinct().agg(F.sort_array(F.collect_list("date")).alias("dates"))


def densify(prices: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Every ticker on every calendar date; absent cells hold NULL.

    The calendar travels as one array (a scalar subquery) and is exploded per
    ticker, so the grid needs no join of its own; ``tickers`` may carry
    metadata columns, which then appear on every row.
    """
    if tickers is None:
        tickers = prices.select("ticker").distinct()
    grid = tickers.select("*", F.posexplode(calendar_array(prices).scalar()).alias("t", "date"))
    return grid.join(prices, ["date", "ticker"], "left")


def clean_panel(
    prices: DataFrame, meta: DataFrame, min_group: int, flags: Sequence[str] = ("is_leveraged", "bad_ticks")
) -> DataFrame:
    """Tickers that can carry a peer-relative label, as a metadata subset.

    Drops flagged tickers, then categories left with fewer than ``min_group``
    members or without a name. Restrict prices with :func:`restrict`.
    """
    bad = F.lit(False)
    for f in flags:
        if f in meta.columns:
            bad = bad | F.coalesce(F.col(f), F.lit(False))
    listed = prices.select("ticker").distinct()
    usable = meta.filter(~bad).join(listed, "ticker", "left_semi")
    big = (
        usable.filter(F.col("category") != UNCATEGORIZED)
        .groupBy("category")
        .agg(F.countDistinct("ticker").alias("members"))
        .filter(F.col("members") >= min_group)
    )
    return usable.join(big.select("category"), "category", "left_semi")


def restrict(prices: DataFrame, tickers: DataFrame) -> DataFrame:
    return prices.join(tickers.select("ticker"), "ticker", "left_semi")


def write_panel(df: DataFrame, path: str, mode: str = "overwrite", as_float: bool = True) -> None:
    """Write a long panel as parquet partitioned by year; doubles shrink to float."""
    if as_float:
        doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
        df = df.withColumns({c: F.col(c).cast("float") for c in doubles})
    out = df.withColumn("year", F.year("date"))
    out.repartition("year", F.pmod(F.xxhash64("ticker"), F.lit(16))).write.mode(mode).partitionBy("year").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a result table as CSV or JSON, a file for each of its partitions."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def markdown_table(df: DataFrame, path: str) -> None:
    """A result table as Markdown lines, every row of it, written by Spark; the header stands in a file of its own that sorts first."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    spark = df.sparkSession
    header = spark.range(1).select(F.explode(F.array(*map(F.lit, head))).alias("value"))
    header.coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    df.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value")).write.mode("overwrite").text(f"{path}/part=1")
