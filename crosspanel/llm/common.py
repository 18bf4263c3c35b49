"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.session import scratch_path, tune

#: Bytes of one Arrow batch given to Python; a worker holds a few of them at a time.
BATCH_BYTES = "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of these operators: the library's own, and Arrow batches bounded by bytes."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return scratch_path(spark, f"llm-{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder; cuts the lineage there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables written by ``stored`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            if "/llm-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_ids(df: DataFrame, name: str) -> None:
    """Raise unless ids are whole numbers: components are told by the smallest."""
    if not isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{name} must hold whole numbers, not {df.schema[name].dataType.simpleString()}")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """``fn`` over every Arrow batch, in the scan's own stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null gives empty bytes."""
    for value in column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary()):
        yield value.as_py() or b""


def string_texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys in sorted columns, and the length at the end."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(1, np.int64)
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs as a forest of depth one: (member, smallest member of its component), roots left out."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        # hook the roots of both ends, then halve every path
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    member = label != np.arange(len(nodes))
    return nodes[member], nodes[label[member]]


PAIR = "node long, root long"


def _local_forests(pairs: DataFrame) -> DataFrame:
    """Each task replaces its share of the pairs by a forest of depth one."""

    def run(batches):
        a, b, held = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= 2_000_000:
                node, root = forest(np.concatenate(a), np.concatenate(b))
                if len(node) > held // 2:  # little to gain in memory: pass it on
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])
                    a, b, held = [], [], 0
                else:
                    a, b, held = [node], [root], len(node)
        if held:
            node, root = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

    return pairs.mapInArrow(run, PAIR)


def components(pairs: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (a, b): one row per linked id that is not the smallest of its component.

    ``pairs`` has two long columns without nulls; the result has ``node`` and ``root``, the smallest id that can be
    reached. Every round, tasks replace their links by local forests, and every node then links its parents to
    the smallest one, so distances shrink geometrically. Each round's table lies in the shared folder. Only
    the count of unsettled nodes reaches the driver.
    """
    a, b = pairs.columns
    links = stored(_local_forests(pairs.select(F.greatest(col(a), col(b)).alias("node"), F.least(col(a), col(b)).alias("root"))
                                  .filter("node > root")), name)
    while True:
        # the smallest parent of a node; its other parents belong to the same component and link to that one
        best = links.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        low = stored(best, name)
        several = low.filter("high > low").select("node", "low")
        rewired = links.join(several, "node").filter("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        # a parent that has a parent itself is replaced by it
        up = low.select(F.col("node").alias("root"), F.col("low").alias("above"))
        stepped = (low.select("node", F.col("low").alias("root")).join(up, "root", "left")
                   .select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        state = stored(stepped.unionByName(rewired.select("node", "root", F.lit(True).alias("moved"))), name)
        unsettled = state.filter("moved").limit(1).count()
        old, links = links, state.select("node", "root")
        if not unsettled:
            drop_stored(old, low)
            return links
        links = stored(_local_forests(links), name)
        drop_stored(old, low, state)
