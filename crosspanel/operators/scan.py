"""Recurrences of any length as associative scans: a ticker's rows are split over tasks, and no Python worker is needed.

A smoothed mean with gaps turns each known value into a map m -> a m + b of the mean before it; such maps compose. Rows are cut into segments
of ``SEGMENT`` calendar rows. Every segment composes its own maps, the much shorter table of segments is scanned in the
same way, level by level, and the mean that enters a segment is put into its maps. A task holds single segments, whatever the length of a ticker.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.rolling import ENTITY, ORDER
from crosspanel.session import materialise

#: Rows of a segment; the prefix of a segment is built by appending, so its cost grows with the square of this.
SEGMENT = 64

PAIR = "array<struct<a:double,b:double>>"



def _number(x) -> Column:
    return F.lit(x).cast("double")


def _before(df: DataFrame, key: Sequence[str], at: str) -> Window:
    return Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)


def affine(df: DataFrame, key: Sequence[str], at: str, maps: Mapping[str, tuple[str, str]], segment: int = SEGMENT) -> DataFrame:
    """Values of recurrences v(i) = a(i) v(i - 1) + b(i), v = 0 before the first row: adds one column for each of ``maps`` (out -> (a, b)).

    Rows of a key are ordered by the whole number ``at``, without ties; null maps leave a value as it is.
    """
    key, names = list(key), list(maps)
    payload = F.struct(F.col(at).alias("_at"), F.struct(*df.columns).alias("_row"),
                       *[F.coalesce(F.col(a), _number(1)).alias(f"_a{i}") for i, (a, _) in enumerate(maps.values())],
                       *[F.coalesce(F.col(b), _number(0)).alias(f"_b{i}") for i, (_, b) in enumerate(maps.values())])
    cut = df.groupBy(*key, F.floor(F.col(at) / segment).cast("long").alias("_segment")).agg(F.array_sort(F.collect_list(payload)).alias("_rows"))

    def composed(i: int) -> Column:
        def step(acc, r):
            a, b = r[f"_a{i}"] * acc["a"], r[f"_a{i}"] * acc["b"] + r[f"_b{i}"]
            return F.struct(a.alias("a"), b.alias("b"), F.concat(acc["done"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("done"))
        start = F.struct(_number(1).alias("a"), _number(0).alias("b"), F.array().cast(PAIR).alias("done"))
        return F.aggregate("_rows", start, step)

    cut = materialise(cut.withColumns({f"_m{i}": composed(i) for i in range(len(names))}), "segments")
    several = cut.agg(F.max("_segment") > F.min("_segment")).first()[0]
    if several:
        short = cut.select(*key, "_segment", *[F.col(f"_m{i}.{c}").alias(f"_{c}{i}") for i in range(len(names)) for c in "ab"])
        # numbers of the segments from 0, so that levels end
        least = short.agg(F.min("_segment")).scalar()
        short = short.withColumn("_at", F.col("_segment") - least)
        ends = affine(short, key, "_at", {f"_v{i}": (f"_a{i}", f"_b{i}") for i in range(len(names))}, segment)
        over = _before(ends, key, "_segment")
        enters = ends.select(*key, "_segment", *[F.coalesce(F.last(f"_v{i}").over(over), _number(0)).alias(f"_e{i}") for i in range(len(names))])
        cut = cut.join(enters, [*key, "_segment"])
    else:
        cut = cut.withColumns({f"_e{i}": _number(0) for i in range(len(names))})
    rows = cut.select(*[f"_e{i}" for i in range(len(names))], F.explode(F.arrays_zip(F.col("_rows"), *[F.col(f"_m{i}.done").alias(f"_d{i}") for i in range(len(names))])).alias("_z"))
    return rows.select("_z._rows._row.*", *[(F.col(f"_z._d{i}.a") * F.col(f"_e{i}") + F.col(f"_z._d{i}.b")).alias(n) for i, n in enumerate(names)])


def ewm(df: DataFrame, columns: Mapping[str, tuple[str, float]], segment: int = SEGMENT) -> DataFrame:
    """Add exponentially weighted means with gaps (out -> (x, alpha)), as ``recurrence.ewm`` does, on rows of any number per ticker."""
    names = list(columns)
    rows = F.array_sort(F.collect_list(F.struct(F.col(ORDER).cast("long").alias("_t"), F.struct(*df.columns).alias("_row"))))
    cut = df.groupBy(ENTITY, F.floor(F.col(ORDER) / segment).cast("long").alias("_segment")).agg(rows.alias("_rows"))

    def scanned(x: str, alpha: float) -> Column:
        """From the first known value m of the segment on, the mean is p m + q."""
        def step(acc, r):
            v, t = r["_row"][x].cast("double"), r["_t"]
            known, fresh = v.isNotNull(), acc["from"].isNull()
            d = F.pow(_number(1 - alpha), (t - acc["to"]).cast("double"))
            p = F.when(known & ~fresh, d / (d + alpha) * acc["p"]).otherwise(acc["p"])
            q = F.when(known & ~fresh, (d * acc["q"] + alpha * v) / (d + alpha)).otherwise(acc["q"])
            seen = known | ~fresh
            put = F.struct(F.when(seen, p).alias("a"), F.when(seen, q).alias("b"))
            return F.struct(F.when(known & fresh, t).otherwise(acc["from"]).alias("from"), F.when(known, t).otherwise(acc["to"]).alias("to"),
                            F.when(known & fresh, v).otherwise(acc["first"]).alias("first"), p.alias("p"), q.alias("q"), F.concat(acc["done"], F.array(put)).alias("done"))
        start = F.struct(F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"), _number(None).alias("first"), _number(1).alias("p"), _number(0).alias("q"),
                         F.array().cast(PAIR).alias("done"))
        return F.aggregate("_rows", start, step)

    cut = materialise(cut.withColumns({f"_m{i}": scanned(*columns[n]) for i, n in enumerate(names)}), "segments")
    short = cut.select(ENTITY, "_segment", *[F.col(f"_m{i}.{c}").alias(f"_{c}{i}") for i in range(len(names)) for c in ("from", "to", "first", "p", "q")])
    over = _before(short, [ENTITY], "_segment")
    short = short.withColumns({f"_prev{i}": F.last(f"_to{i}", ignorenulls=True).over(over) for i in range(len(names))})
    added = {}
    for i, n in enumerate(names):
        alpha = columns[n][1]
        d = F.pow(_number(1 - alpha), (F.col(f"_from{i}") - F.col(f"_prev{i}")).cast("double"))
        # of the first known value: all of it where nothing is known before
        a = F.when(F.col(f"_from{i}").isNotNull(), F.coalesce(d / (d + alpha), _number(0)))
        b = F.coalesce(alpha * F.col(f"_first{i}") / (d + alpha), F.col(f"_first{i}"))
        added |= {f"_a{i}": a, f"_b{i}": b, f"_pa{i}": F.col(f"_p{i}") * a, f"_pb{i}": F.col(f"_p{i}") * b + F.col(f"_q{i}")}
    ends = affine(short.withColumns(added), [ENTITY], "_segment", {f"_v{i}": (f"_pa{i}", f"_pb{i}") for i in range(len(names))}, segment)
    enter = {}
    for i in range(len(names)):
        came = F.when(F.col(f"_prev{i}").isNotNull(), F.last(f"_v{i}").over(over))
        enter |= {f"_e{i}": came, f"_f{i}": F.when(F.col(f"_from{i}").isNotNull(), F.coalesce(F.col(f"_a{i}") * came, _number(0)) + F.col(f"_b{i}"))}
    ends = ends.withColumns(enter).select(ENTITY, "_segment", *enter)
    whole = cut.join(ends, [ENTITY, "_segment"])
    zipped = F.arrays_zip(F.col("_rows"), *[F.col(f"_m{i}.done").alias(f"_d{i}") for i in range(len(names))])
    rows = whole.select(*enter, F.explode(zipped).alias("_z"))
    return rows.select("_z._rows._row.*", *[F.coalesce(F.col(f"_z._d{i}.a") * F.col(f"_f{i}") + F.col(f"_z._d{i}.b"), F.col(f"_e{i}")).alias(n) for i, n in enumerate(names)])
