"""Session settings the operators expect.

``tune`` only sets SQL options that may change at run time, so it also works
on a session somebody else created (a cluster shell, the test driver).
"""

from __future__ import annotations

import contextlib
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # window stages are heavy per byte: merge shuffle partitions only when they are tiny
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # data frame libraries write times in nanoseconds, which Spark has no type for
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver was started; once per context."""
    context = spark.sparkContext
    if getattr(context, "_crosspanel_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="run-package-"), "crosspanel.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    context._crosspanel_shipped = True


def local_session(cpus: str | int = "*", app: str = "crosspanel", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("CROSSPANEL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-warehouse-"))
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, which the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="run-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, below one folder for each application."""
    return os.path.join(shared_folder(spark), f"crosspanel-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def options(spark: SparkSession, values: dict[str, str]):
    """SQL options for the statements planned inside the block."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield spark
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Shuffle files of a table that is written go when it is, not at some later collection of garbage on the driver.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A join takes rows as the windows before it have dealt them out by some of its keys, without another exchange.
AS_DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def materialise(df, name: str = "step", as_dealt: bool = False):
    """Write an intermediate table to the shared folder and read it back.

    For tables several later steps read: they are computed once, survive the
    loss of any executor, and the scan after it prunes columns and knows its size.
    They live until ``drop_tables`` or the end of a ``tables`` block.

    With ``as_dealt`` wide rows that windows have dealt out by a key (which must spread them well) stay there for joins on more keys.
    """
    path = scratch_path(df.sparkSession, name)
    with options(df.sparkSession, CLEANUP | (AS_DEALT if as_dealt else {})):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Delete a table written by ``materialise`` that nothing reads any more."""
    spark = df.sparkSession
    own = os.path.dirname(scratch_path(spark, "any"))
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(own).toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete every intermediate table this application has written; frames that read them are of no use any more."""
    folder = os.path.dirname(scratch_path(spark, "any"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def tables(spark: SparkSession):
    """Results must be written or collected inside the block; its intermediate tables go at the end."""
    try:
        yield spark
    finally:
        drop_tables(spark)
