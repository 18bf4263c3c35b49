"""The (date, ticker) panel derived from the given tables, in Spark and in SQL.

ticker    four neighbouring suppliers, so the universe grows with the tables
date      Monday of the shipping week
category  region of the lead supplier's nation (one region holds over a third)
prices    part retail prices in shipping order; volume is the shipped quantity
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.session import materialise
from crosspanel.sources import panel as P

# fixed words from which fund names are put together
ADJECTIVES = ["Gold", "Core", "Ultra-Short", "Growth", "Inverse", "Value", "Global"]
NOUNS = ["Trust", "Bond", "2x Bull", "Goldfields", "Equity", "Income (USD)"]
MIN_GROUP = 3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ticker(suppkey):
    return F.concat(F.lit("F"), F.lpad(F.floor(F.col(suppkey) / 4).cast("string"), 9, "0"))


def trades(spark, sf) -> DataFrame:
    """Priced shipments: (ticker, day, price, quantity, ordering keys)."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.to_date("l_shipdate").alias("day"),
        _ticker("l_suppkey").alias("ticker"),
        F.col("p_retailprice").alias("price"),
        "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def _bars(rows: DataFrame) -> DataFrame:
    # the place of a trade in its bar as one number (day, order, line, part), so that
    # the aggregate stays hash-based; a struct would force a sort of every input split
    number = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    ten = lambda k: F.lit(10**k).cast(f"decimal({k + 1},0)")
    day = F.datediff("day", "date").cast("decimal(3,0)")
    place = ((day * ten(15) + number("l_orderkey", 15)) * 10 + number("l_linenumber", 1)) * ten(12) + number("l_partkey", 12)
    return rows.withColumn("place", place).groupBy("date", "ticker").agg(
        F.min_by("price", "place").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "place").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def ohlcv(spark, sf) -> DataFrame:
    """Weekly bars (sparse: only weeks with a shipment)."""
    return _bars(trades(spark, sf).withColumn("date", F.trunc("day", "week").cast("date")))


def daily(spark, sf) -> DataFrame:
    """Daily bars: many gaps, used where gaps are the point."""
    return _bars(trades(spark, sf).withColumn("date", F.col("day")))


def metadata(spark, sf) -> DataFrame:
    """One row per ticker, from the lead supplier, its nation and its region."""
    s = table(spark, sf, "supplier").select(
        F.floor(F.col("s_suppkey") / 4).alias("g"), _ticker("s_suppkey").alias("ticker"), "s_suppkey", "s_nationkey"
    )
    lead = s.groupBy("g", "ticker").agg(F.min_by("s_nationkey", "s_suppkey").alias("s_nationkey"))
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    words_a = F.array(*[F.lit(w) for w in ADJECTIVES])
    words_n = F.array(*[F.lit(w) for w in NOUNS])
    g = F.col("g")
    return (
        lead.join(n, lead.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            "ticker",
            F.concat_ws(
                " ",
                F.initcap("n_name"),
                F.element_at(words_a, (g % len(ADJECTIVES) + 1).cast("int")),
                F.element_at(words_n, (g % len(NOUNS) + 1).cast("int")),
                g.cast("string"),
            ).alias("name"),
            F.when(g % 11 == 7, None).otherwise(F.concat(F.lit("Desk "), (g % 3).cast("string"))).alias("category_group"),
            F.col("r_name").alias("category"),
            F.col("n_name").alias("family"),
            F.when(g % 2 == 0, "USD").otherwise("EUR").alias("currency"),
            F.when(g % 5 == 0, "NMS").when(g % 5 == 1, None).otherwise("PCX").alias("exchange"),
            (g % 13 == 5).alias("is_leveraged"),
        )
    )


def universe_rows(spark, sf) -> int:
    """Upper bound on rows per date: tickers cannot outnumber suppliers."""
    return table(spark, sf, "supplier").count()


def panel(spark, sf, bars: DataFrame | None = None) -> DataFrame:
    """The dense grid with category: date, t, ticker, category, OHLCV.

    The bars are written once: calendar, universe and grid then read that small
    table, and the trade table is scanned a single time.
    """
    bars = materialise(ohlcv(spark, sf) if bars is None else bars, "bars")
    listed = bars.select("ticker").distinct()
    tickers = metadata(spark, sf).select("ticker", "category").join(listed, "ticker", "left_semi")
    return P.densify(bars, tickers)


# -- the same tables in SQL --------------------------------------------------------------


def _sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TICKER_SQL = "'F' || lpad(cast({k} // 4 AS varchar), 9, '0')"

TRADES = f"""
trades AS MATERIALIZED (
  SELECT cast(l_shipdate AS date) AS day, {TICKER_SQL.format(k="l_suppkey")} AS ticker, p_retailprice AS price,
         l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def bars_sql(name: str, date: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT {date} AS date, ticker, arg_min(price, place) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, place) AS close, sum(l_quantity) AS volume
  FROM trades GROUP BY 1, 2)"""


WEEK = "cast(date_trunc('week', day) AS date)"

META = f"""
meta AS MATERIALIZED (
  SELECT ticker, array_to_string([upper(n_name[1]) || lower(n_name[2:]),
           {_sql_list(ADJECTIVES)}[g % {len(ADJECTIVES)} + 1], {_sql_list(NOUNS)}[g % {len(NOUNS)} + 1],
           cast(g AS varchar)], ' ') AS name,
         CASE WHEN g % 11 = 7 THEN NULL ELSE 'Desk ' || cast(g % 3 AS varchar) END AS category_group,
         r_name AS category, n_name AS family, CASE WHEN g % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
         CASE WHEN g % 5 = 0 THEN 'NMS' WHEN g % 5 = 1 THEN NULL ELSE 'PCX' END AS exchange,
         g % 13 = 5 AS is_leveraged
  FROM (SELECT s_suppkey // 4 AS g, {TICKER_SQL.format(k="s_suppkey")} AS ticker,
               arg_min(s_nationkey, s_suppkey) AS nk FROM supplier GROUP BY 1, 2)
  JOIN nation ON nk = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def grid_sql(bars: str = "ohlcv", cal: str = "cal", grid: str = "panel") -> str:
    return f"""
{cal} AS MATERIALIZED (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM {bars})),
{grid} AS MATERIALIZED (
  SELECT c.date, c.t, m.ticker, m.category, o.open, o.high, o.low, o.close, o.volume
  FROM {cal} c CROSS JOIN (SELECT ticker, category FROM meta WHERE ticker IN (SELECT ticker FROM {bars})) m
  LEFT JOIN {bars} o ON o.date = c.date AND o.ticker = m.ticker)"""


OHLCV_SQL = f"WITH {TRADES}, {bars_sql('ohlcv', WEEK)}, {META}"
PANEL_SQL = f"{OHLCV_SQL}, {grid_sql()}"
DAILY_SQL = f"WITH {TRADES}, {bars_sql('ohlcv', 'day')}, {META}, {grid_sql()}"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """A rounded output column; the added zero turns -0.0 into 0.0."""
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


AXIS = "PARTITION BY ticker ORDER BY t"


def w(k: int, skip: int = 0) -> str:
    end = "CURRENT ROW" if skip == 0 else f"{skip} PRECEDING"
    return f"({AXIS} ROWS BETWEEN {k - 1 + skip} PRECEDING AND {end})"


def roll(agg: str, x: str, k: int, need: int | None = None, skip: int = 0) -> str:
    """Rolling aggregate with the minimum-observations guard."""
    return f"CASE WHEN count({x}) OVER {w(k, skip)} >= {k if need is None else need} THEN {agg}({x}) OVER {w(k, skip)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({AXIS})"


def chg(x: str, n: int = 1) -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def pr(x: str, keys: str) -> str:
    """Average-tie percentile rank within keys."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys}, {x} IS NULL ORDER BY {x}) "
        f"+ (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {keys}) END"
    )


def ar(x: str, keys: str) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys}, {x} IS NULL ORDER BY {x}) "
        f"+ (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 END"
    )


DC = "date, category"


def loo(x: str, keys: str = DC, null_self: bool = False) -> str:
    over = f"OVER (PARTITION BY {keys})"
    if null_self:
        return f"((sum({x}) {over} - {x}) / nullif(count({x}) {over} - 1, 0))"
    return (
        f"((sum({x}) {over} - coalesce({x}, 0)) / "
        f"nullif(count({x}) {over} - CASE WHEN {x} IS NULL THEN 0 ELSE 1 END, 0))"
    )


def tile_sql(rank: str, n: str, q: int) -> str:
    op = ">=" if q == 3 else ">"
    steps = " + ".join(f"CASE WHEN {q} * ({rank} - 1) {op} {k} * ({n} - 1) THEN 1 ELSE 0 END" for k in range(1, q))
    return f"({steps})"
