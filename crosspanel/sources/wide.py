"""Wide panel files: one row for each date, one column for each (field, ticker), as data frame libraries write them.

Column names carry the pair: ``('Close', 'SPY')`` or ``Close|SPY``, in either order. Such files have thousands of columns. They are read in
groups of tickers, each a scan that names its own columns alone, so no row of the plan is ever wider than a group; and they are written
from one array for each date, in the order of the table's own universe. A file's footer tells of every column, and each scan reads it. So a
table of more than ``COLUMNS`` columns is written as strips of that many, files side by side in one folder, every one with all dates, and
the work grows with the cells. Strips are read whole, each file by the task that gets it, so their columns are in no plan and the driver,
which would need memory for each of them, never sees their names.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.session import CLEANUP, materialise, options, scratch_path
from crosspanel.sources import panel as P

#: Tickers of one group of columns.
GROUP = 200
#: Scans a table is read in, about; tables of more groups are read in wider ones.
SCANS = 128
#: Columns of one file; a table of more lies in several, one folder each.
COLUMNS = 5_000
STRIP = "columns-"
#: Cells of one batch that Python makes, and of one file of a strip, which a task reads as a whole.
CELLS, FILE_CELLS = 1_000_000, 8_000_000
#: Names of the row index, as libraries write it.
DATE_NAMES = ("date", "datetime", "timestamp", "index", "__index_level_0__")


class WideError(ValueError):
    """A file that is no wide panel."""


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _pair(name: str, separator: str) -> tuple[str, str] | None:
    if name.startswith("(") and name.endswith(")"):
        try:
            parts = ast.literal_eval(name)
        except (SyntaxError, ValueError):
            return None
        return (str(parts[0]), str(parts[1])) if isinstance(parts, tuple) and len(parts) == 2 else None
    first, found, second = name.partition(separator)
    return (first, second) if found else None


def column_map(columns: Sequence[str], fields: Sequence[str] = P.FIELDS, separator: str = "|") -> tuple[str, dict[str, dict[str, str]]]:
    """The date column, and for every ticker the column of each field it has; other columns are ignored."""
    known = {f.lower() for f in fields}
    date, found = None, {}
    for name in columns:
        pair = _pair(name, separator)
        if pair is None or not (pair[1] or pair[0].lower() in DATE_NAMES):
            if name.lower() in DATE_NAMES and date is None:
                date = name
            continue
        a, b = pair
        if b == "" or (a.lower() in DATE_NAMES and b.lower() not in known):
            date = date or name
        elif a.lower() in known:
            found.setdefault(b, {}).setdefault(a.lower(), name)
        elif b.lower() in known:
            found.setdefault(a, {}).setdefault(b.lower(), name)
    if date is None:
        raise WideError(f"no date column among {list(columns)[:6]}")
    if not found:
        raise WideError("no (field, ticker) column")
    return date, found


def _read_in_spark(kind: T.DataType) -> bool:
    """Whether cells are cast by Spark; plain numbers are by Arrow."""
    return not isinstance(kind, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def _long_schema(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *[T.StructField(f, T.DoubleType()) for f in fields]])


def _long(column: Callable[[str], pa.Array], date: str, tickers: Sequence[str], places: Mapping[str, Sequence[tuple[int, str]]], keep_missing: bool) -> pa.RecordBatch:
    """The cells of one batch of wide rows, whose columns ``column`` gives, as (date, ticker, fields); ``places`` has the columns of each field."""
    day, names, values = column(date), pa.array(tickers, pa.string()), []
    n = len(day)
    for named in places.values():
        x = np.full((n, len(tickers)), np.nan)
        for i, c in named:
            x[:, i] = column(c).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        values.append(x.ravel())
    there = [np.isfinite(x) for x in values]
    rows = np.arange(n * len(tickers)) if keep_missing else np.flatnonzero(np.any(there, axis=0))
    columns = [day.take(pa.array(rows // len(tickers))), names.take(pa.array(rows % len(tickers)))]
    columns += [pa.array(x[rows], mask=~ok[rows]) for x, ok in zip(values, there)]
    return pa.RecordBatch.from_arrays(columns, ["date", "ticker", *places])


def _cells(part: DataFrame, date: str, kinds: Mapping[str, T.DataType], found: Mapping[str, Mapping[str, str]], fields: Sequence[str], keep_missing: bool) -> DataFrame:
    """(date, ticker, fields) of a frame of the date and the columns of a few tickers, which ``found`` names."""
    day = _col(date)
    if isinstance(kinds[date], T.LongType):  # nanoseconds
        day = F.timestamp_micros(F.floor(day / 1000).cast("long"))
    changed = {c: _col(c).cast("double") for names in found.values() for c in names.values() if _read_in_spark(kinds[c])}
    # one struct of all columns, so their names are neither parsed nor sent one by one
    part = part.withColumns(changed | {date: day.cast("date")}).select(F.struct(F.col("*")).alias("row"))
    tickers, schema = list(found), _long_schema(fields)
    places = {f: [(i, found[t][f]) for i, t in enumerate(tickers) if f in found[t]] for f in fields}

    def run(batches):
        step = max(1, CELLS // (len(tickers) * len(fields)))
        for whole in batches:
            at = {f.name: i for i, f in enumerate(whole.column(0).type)}
            for start in range(0, whole.num_rows, step):
                b = whole.column(0).slice(start, step)
                yield _long(lambda c, b=b: b.field(at[c]), date, tickers, places, keep_missing)

    return part.mapInArrow(run, schema)


def _grouped(schema: T.StructType, scan, fields: Sequence[str], separator: str, group: int, keep_missing: bool) -> list[DataFrame]:
    """Long rows of every group of tickers of a table; ``scan`` gives the frame of a list of its columns."""
    date, found = column_map(schema.names, fields, separator)
    kinds = {f.name: f for f in schema.fields}
    tickers, out = sorted(found), []
    for at in range(0, len(tickers), group):
        mine = {t: {f: c for f, c in found[t].items() if f in fields} for t in tickers[at : at + group]}
        wanted = [kinds[date], *[kinds[c] for names in mine.values() for c in names.values()]]
        out.append(_cells(scan(wanted), date, {f.name: f.dataType for f in wanted}, mine, fields, keep_missing))
    return out


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    while len(parts) > 1:
        parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def from_wide(df: DataFrame, fields: Sequence[str] = P.FIELDS, separator: str = "|", group: int = GROUP, keep_missing: bool = False) -> DataFrame:
    """(date, ticker, fields): the cells of a wide table as long rows.

    A field a ticker has no column of is NULL, and so are NaN and infinite cells. Cells where every field is missing are left out unless
    ``keep_missing``.
    """
    scan = lambda wanted: df.select(*[_col(f.name) for f in wanted])
    return _union(_grouped(df.schema, scan, fields, separator, group, keep_missing))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def strips(spark: SparkSession, path: str) -> list[str]:
    """The folders of the strips of a wide table, or its own path if it lies in one piece."""
    folder, system = _folder(spark, path)
    found = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{STRIP}*")) if system.exists(folder) else None
    return sorted(s.getPath().toString() for s in found or []) or [path]


def _strip_rows(spark: SparkSession, paths: Sequence[str], fields: Sequence[str], separator: str, keep_missing: bool) -> DataFrame:
    """Long rows of strips; a task reads the files it gets, names of their columns among them."""
    fields = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contents in batches:
            for content in contents.column(0):
                file = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                date, found = column_map(file.schema_arrow.names, fields, separator)
                tickers = sorted(found)
                places = {f: [(i, found[t][f]) for i, t in enumerate(tickers) if f in found[t]] for f in fields}
                wanted = [date, *[c for named in places.values() for _, c in named]]
                for b in file.iter_batches(max(1, CELLS // (len(tickers) * len(fields))), columns=wanted):
                    at = {c: i for i, c in enumerate(b.schema.names)}
                    yield _long(lambda c, b=b, at=at: b.column(at[c]), date, tickers, places, keep_missing)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(list(paths))
    return files.select("content").mapInArrow(run, _long_schema(fields))


def read_wide(spark: SparkSession, path: str, fields: Sequence[str] = P.FIELDS, separator: str = "|", group: int = GROUP, keep_missing: bool = False) -> DataFrame:
    """Long rows of a wide parquet file, or of all strips of one; every group of columns is a scan of those columns alone.

    Tables of more than ``SCANS`` groups are read in wider ones, so the number of scans is bounded. Strips of plain numbers, which all have
    the types of the first, are read by file.
    """
    found = strips(spark, path)
    schemas = {found[0]: spark.read.parquet(found[0]).schema}
    date, _ = column_map(schemas[found[0]].names, fields, separator)
    plain = all(isinstance(f.dataType, T.DateType) if f.name == date else not _read_in_spark(f.dataType) for f in schemas[found[0]].fields)
    if found != [path] and plain:
        return _strip_rows(spark, found, fields, separator, keep_missing)
    schemas |= {p: spark.read.parquet(p).schema for p in found[1:]}
    tickers = sum(len(column_map(s.names, fields, separator)[1]) for s in schemas.values())
    group = max(group, math.ceil(tickers / SCANS))
    parts = []
    for p, schema in schemas.items():
        scan = lambda wanted, p=p: spark.read.schema(T.StructType(wanted)).parquet(p)
        parts += _grouped(schema, scan, fields, separator, group, keep_missing)
    return _union(parts)


def universe(df: DataFrame) -> list[str]:
    """The tickers of a long table in order; the columns of its wide form, so a list that has to be on the driver."""
    return [r.ticker for r in df.select("ticker").distinct().orderBy("ticker").collect()]


def _rows(df: DataFrame, fields: Sequence[str], tickers: Sequence[str], width: int) -> DataFrame:
    """(strip, date, cells): the cells (place, fields) of each strip of ``width`` tickers on every date, without the missing ones."""
    spark = df.sparkSession
    places = spark.createDataFrame([(t, i // width, i % width) for i, t in enumerate(tickers)], "ticker string, strip int, place int")
    dates = df.select("date").filter("date IS NOT NULL").distinct()
    every = dates.select("date", F.explode(F.sequence(F.lit(0), F.lit((len(tickers) - 1) // width))).alias("strip"))
    cells = df.join(F.broadcast(places), "ticker").groupBy("strip", "date").agg(F.collect_list(F.struct("place", *fields)).alias("cells"))
    return every.join(cells, ["strip", "date"], "left").select("strip", "date", F.coalesce("cells", F.array().cast(cells.schema["cells"].dataType)).alias("cells"))


def _spread(rows: DataFrame, kinds: Sequence[T.StructField], tickers: Sequence[str], names: Mapping[str, str] | None) -> DataFrame:
    """The wide form of the rows (date, cells) of one strip."""
    label = {f.name: (names or {}).get(f.name, f.name.capitalize()) for f in kinds[1:]}
    schema = T.StructType([kinds[0], *[T.StructField(str((label[f.name], t)), f.dataType) for f in kinds[1:] for t in tickers]])
    width, fields = len(tickers), [f.name for f in kinds[1:]]

    def run(batches):
        step = max(1, CELLS // (width * len(fields)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                n, cells = b.num_rows, b.column(1).flatten()
                row = np.repeat(np.arange(n), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
                at = cells.field("place").to_numpy(zero_copy_only=False).astype(np.int64) * n + row
                index = np.full(width * n, -1)
                index[at] = np.arange(len(at))
                if np.count_nonzero(index >= 0) < len(at):
                    raise WideError("a date has several rows of one ticker")
                index = pa.array(index, mask=index < 0)
                columns = [b.column(0)]
                for f in fields:
                    values = cells.field(f).take(index)
                    columns += [values.slice(i * n, n) for i in range(width)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.select("date", "cells").mapInArrow(run, schema)


def _kinds(df: DataFrame, fields: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in ("date", *fields)]


def to_wide(df: DataFrame, fields: Sequence[str] = P.FIELDS, tickers: Sequence[str] | None = None, names: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each date, a column ``('Field', 'ticker')`` for every pair; missing cells are NULL.

    ``names`` gives the fields other names than their capitalised ones. (date, ticker) must be unique.
    """
    tickers = list(tickers) if tickers is not None else universe(df)
    kinds = _kinds(df, fields)
    if not tickers:
        return df.select("date").limit(0)
    return _spread(_rows(df, fields, tickers, len(tickers)), kinds, tickers, names)


def write_wide(df: DataFrame, path: str, fields: Sequence[str] = P.FIELDS, columns: int = COLUMNS) -> None:
    """The wide form as a parquet file, or as strips of up to ``columns`` columns if it has more."""
    spark = df.sparkSession
    df = materialise(df.select("date", "ticker", *fields), "wide-long")  # its calendar, universe and cells are read from here
    tickers, width = universe(df), max(1, columns // len(fields))
    if len(tickers) <= width:
        to_wide(df, fields, tickers).write.mode("overwrite").parquet(path)
        return
    rows = scratch_path(spark, "wide-strips")
    with options(spark, CLEANUP):
        _rows(df, fields, tickers, width).repartition("strip", "date").write.partitionBy("strip").parquet(rows)
    kinds = _kinds(df, fields)
    folder, system = _folder(spark, path)
    system.delete(folder, True)
    for k in range(0, len(tickers), width):
        mine = spark.read.parquet(f"{rows}/strip={k // width}")
        files = _spread(mine, kinds, tickers[k : k + width], None).write.option("maxRecordsPerFile", max(1, FILE_CELLS // (width * len(fields))))
        files.parquet(f"{path}/{STRIP}{k // width:06d}")
