"""Query registry: name -> (Spark callable, optional SQL, inventory ids it covers)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.session import tune

MODULES = [
    "sources", "quality", "trailing", "peers", "families", "indicators", "labels", "splits", "joins",
    "evaluation", "portfolios", "audits", "screens", "models", "boosted", "linear", "streams",
]


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str
    module: str


QUERIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None, digits: int = 6):
    """Register a query. Double columns are rounded the same way on both sides."""

    def wrap(fn):
        name = fn.__name__
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(tune(spark), sf_dir), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = Entry(run, sql, covers, fn.__module__)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and normalise integer widths so both engines print one value."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_all() -> dict[str, Entry]:
    for m in MODULES:
        try:
            importlib.import_module(f"catalog.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"catalog.{m}":
                raise
    return QUERIES
