"""An append-only stream of scores, rolled up by time window and key while it arrives.

The windows are state of a streaming aggregation, bounded by the watermark. A micro-batch writes the windows it has changed into a folder of
its own number, which is replaced if the batch is repeated; the table of a stream is the latest version of every window. So a restarted run
loses and doubles nothing, and rows that come late but within the watermark correct the windows they belong to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def roll_up(scores: DataFrame, ts: str, key: Sequence[str], x: str, window: str, watermark: str) -> DataFrame:
    """Count, sum, extremes and newest value of ``x`` for each (window, key); works on a stream and on a table alike."""
    value = F.col(x)
    return scores.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("_w"), *key).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), F.max_by(value, ts).alias("latest"), F.max(ts).alias("newest"),
    ).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *key, "n", "total", "low", "high", "latest", "newest")


def run(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, ts: str, key: Sequence[str], x: str, window: str = "1 day",
        watermark: str = "2 days", files_per_batch: int = 1) -> None:
    """Read what has been appended to the folder ``source`` since the last run, and stop; versions of windows go to ``target``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    started = roll_up(stream, ts, key, x, window, watermark).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()


def table(spark: SparkSession, target: str, key: Sequence[str]) -> DataFrame:
    """The latest version of every window."""
    versions = spark.read.parquet(target)
    kept = [c for c in versions.columns if c != "batch"]
    last = versions.groupBy("window_start", *key).agg(F.max_by(F.struct(*kept), "batch").alias("_v"))
    return last.select("_v.*")
