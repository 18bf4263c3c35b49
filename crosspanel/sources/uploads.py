"""Price tables handed in by users: header aliases, type coercion, rejection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# header spellings that stand for another column
ALIASES = {"symbol": "ticker", "adj close": "close"}
REQUIRED = ["date", "ticker", "high", "low", "close", "volume"]
NUMERIC = ["open", "high", "low", "close", "volume"]


class UploadError(ValueError):
    """The table cannot be used; the message says why."""


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    return parse_upload(spark.read.option("header", True).csv(path))


def normalise_headers(df: DataFrame) -> DataFrame:
    names = [c.strip().lower() for c in df.columns]
    taken = set(names)
    names = [ALIASES[n] if n in ALIASES and ALIASES[n] not in taken else n for n in names]
    return df.toDF(*names)


def parse_upload(df: DataFrame) -> DataFrame:
    """Typed, validated rows of an all-string table.

    One aggregate over the table decides on rejection: an unreadable date, a
    repeated (date, ticker) or fewer than two dates.
    """
    df = normalise_headers(df)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise UploadError(f"missing columns: {', '.join(missing)}")
    typed = df.select(
        F.to_date(F.try_to_timestamp(F.trim("date"))).alias("date"),
        F.upper(F.trim("ticker")).alias("ticker"),
        *[F.col(c).try_cast("double").alias(c) for c in NUMERIC if c in df.columns],
        *[F.col(c) for c in df.columns if c not in ("date", "ticker", *NUMERIC)],
    )
    cells = typed.groupBy("date", "ticker").count()
    facts = cells.agg(
        F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("count"))), F.lit(0)).alias("undated"),
        F.coalesce(F.max(F.when(F.col("date").isNotNull(), F.col("count"))), F.lit(0)).alias("copies"),
        F.countDistinct("date").alias("dates"),
    ).first()
    if facts["undated"]:
        raise UploadError(f"{facts['undated']} rows have an unreadable date")
    if facts["copies"] > 1:
        raise UploadError("a (date, ticker) pair appears more than once")
    if facts["dates"] < 2:
        raise UploadError("at least two dates are needed")
    return typed
