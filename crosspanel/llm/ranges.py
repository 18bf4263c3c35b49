"""Positions in a global order, by range partitions and the counts of each: no group has to fit one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.llm.common import fresh, stored


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``name``: 1, 2, 3, ... in the order of ``order``, which must leave no ties.

    Rows are sorted by range, numbered within each range while they stream by, and shifted by the rows of the ranges
    before. Only one count for each range reaches the driver.
    """
    spark = df.sparkSession
    part, local = fresh(df, "range_no"), fresh(df, "range_row")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField(local, T.LongType())])

    def count(batches):
        seen = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(seen + 1, seen + b.num_rows + 1), pa.int64())], [*b.schema.names, local])
            seen += b.num_rows

    rows = stored(dealt.mapInArrow(count, schema), "numbered")
    before, shifts = 0, []
    for r in rows.groupBy(part).agg(F.max(local).alias("n")).orderBy(part).collect():
        shifts.append((r[part], before))
        before += r.n
    if not shifts:
        return rows.select(*df.columns, F.col(local).alias(name))
    shift = F.element_at(F.create_map(*[F.lit(x) for pair in shifts for x in pair]), F.col(part))
    return rows.select(*df.columns, (F.col(local) + shift).alias(name))
