"""As-of joins, full outer alignment and set differences between baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_key_table(keys: DataFrame, key: str, dates: DataFrame, out: str) -> DataFrame:
    """For every distinct key date, the first listed date on or after it.

    Keys past the end get the last listed date. Both inputs are calendar-sized
    (distinct days), so the single ordered window stays small.
    """
    days = dates.select(F.col(out).alias("_d")).distinct()
    both = keys.select(F.col(key).alias("_d"), F.lit(True).alias("_want")).distinct().unionByName(
        days.withColumn("_want", F.lit(False))
    )
    both = both.groupBy("_d").agg(F.max("_want").alias("_want"), F.min("_want").alias("_all_wanted"))
    listed = F.when(~F.col("_all_wanted"), F.col("_d"))
    ahead = Window.orderBy("_d").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.coalesce(F.first(listed, ignorenulls=True).over(ahead), F.max(listed).over(whole))
    return both.select(F.col("_d").alias(key), found.alias(out), "_want").filter("_want").drop("_want")


def next_date(rows: DataFrame, key: str, dates: DataFrame, out: str) -> DataFrame:
    """Forward as-of join onto a calendar: add the first listed date on or after ``key``.

    The search runs once per distinct day; rows then take an equi-join. Rows without a key stay, without a date.
    """
    days = next_key_table(rows.filter(F.col(key).isNotNull()), key, dates, out)
    return rows.join(days, key, "left")


def forward_asof(rows: DataFrame, key: str, series: DataFrame, values: Sequence[str], date: str = "date") -> DataFrame:
    """Add the series values at the first series date on or after ``key`` (past the end: the last)."""
    days = next_key_table(rows, key, series, date).withColumnRenamed(date, "_at")
    looked = days.join(series.select(F.col(date).alias("_at"), *values), "_at").drop("_at")
    return rows.join(looked, key, "left")


def align(frames: Sequence[DataFrame], keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Full outer alignment of several frames on their keys; a repeated column keeps the first frame's."""
    out = frames[0]
    for f in frames[1:]:
        fresh = [c for c in f.columns if c not in out.columns]
        out = out.join(f.select(*keys, *fresh), list(keys), "full_outer")
    return out


def basket_changes(baskets: DataFrame, k: str = "k", name: str = "ticker") -> DataFrame:
    """Members that entered or left at each basket against the one before.

    Every member is emitted at its own basket and at the next one, so the
    symmetric difference is one aggregate instead of a self join.
    """
    last = baskets.agg(F.max(k)).scalar()
    marks = F.array(
        F.struct(F.col(k).alias(k), F.lit(1).alias("_m")), F.struct((F.col(k) + 1).alias(k), F.lit(-1).alias("_m"))
    )
    rows = baskets.select(name, F.explode(marks).alias("_x")).select(name, f"_x.{k}", "_x._m")
    net = rows.groupBy(k, name).agg(F.sum("_m").alias("_m")).filter((F.col("_m") != 0) & (F.col(k) <= last))
    return net.select(k, name, F.when(F.col("_m") > 0, "entered").otherwise("left").alias("change"))


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Sizes of two key sets, of their intersection, and the share covered."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    tagged = x.withColumn("_s", F.lit(1)).unionByName(y.withColumn("_s", F.lit(2)))
    sides = tagged.groupBy(*keys).agg(F.sum("_s").alias("_s"))
    out = sides.agg(
        F.count(F.when(F.col("_s") != 2, 1)).alias("left_keys"),
        F.count(F.when(F.col("_s") != 1, 1)).alias("right_keys"),
        F.count(F.when(F.col("_s") == 3, 1)).alias("common"),
    )
    return out.withColumn("coverage", F.try_divide(F.col("common"), F.greatest("left_keys", "right_keys")))
