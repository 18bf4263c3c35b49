"""Incremental refresh of derived tables: only what is newer than the table is recomputed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.session import discard, materialise


def refresh(
    source: DataFrame, target: DataFrame, compute: Callable[[DataFrame], DataFrame], lookback: int
) -> DataFrame:
    """Rows of ``compute(source)`` dated after the target's newest date.

    ``source`` is a dense grid with position ``t``; ``lookback`` is the longest
    window ``compute`` looks back over, so the slice it sees is long enough and
    results equal a full recompute. The cut is a scalar subquery.
    """
    newest = target.agg(F.max("date"))
    held = source.filter(F.col("date") <= newest.scalar()).agg(F.max("t"))
    recent = source.filter(F.col("t") > F.coalesce(held.scalar(), F.lit(-1)) - lookback)
    return compute(recent).filter(F.col("date") > newest.scalar())


def append(target_path: str, fresh: DataFrame) -> None:
    fresh.write.mode("append").parquet(target_path)


def _todo(work: DataFrame, status_path: str) -> DataFrame:
    try:
        done = work.sparkSession.read.parquet(status_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return work  # no status table yet
    return work.join(done.select(*work.columns), work.columns, "left_anti")


def land(todo: DataFrame, data_path: str, load: Callable[[DataFrame], DataFrame]) -> None:
    """Write the rows of the keys, one partition for each key; what an earlier run left of a key is replaced."""
    keys = todo.columns
    load(todo).repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(data_path)


def ingest(work: DataFrame, status_path: str, data_path: str, load: Callable[[DataFrame], DataFrame]) -> None:
    """Load the keys the status table does not list yet, then list them with the number of rows that landed.

    The data is partitioned by the columns of ``work``, and a key's partition is replaced as a whole: a run that dies between data and
    status, or in the middle of the data, is repeated without doubling or losing a row. The status is read off the data that landed;
    keys without rows are listed with 0.
    """
    spark, keys = work.sparkSession, work.columns
    todo = materialise(_todo(work, status_path).distinct(), "todo")
    if todo.limit(1).count() == 0:
        return
    land(todo, data_path, load)
    try:
        landed = spark.read.parquet(data_path).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
        status = todo.join(landed, keys, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        status = todo.withColumn("n_rows", F.lit(0).cast("long"))  # nothing has landed at all
    status.write.mode("append").parquet(status_path)
    discard(todo)
