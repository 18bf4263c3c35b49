"""Portfolio return tables on the scored panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import r, rs
from catalog.registry import query
from catalog.scored import ARMS_SQL, SCORED_SQL, arms, scored_table
from crosspanel.operators import cross as X
from crosspanel.operators import joins as J
from crosspanel.operators import portfolio as PF
from crosspanel.session import materialise

H = 5
PY = 52 / H


def n_rows(spark, sf):
    return B.universe_rows(spark, sf)


def rebalance_sql(src="sc", by="", h=H, least=6, name="rb"):
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    on = f"(date{', ' + by if by else ''})"
    return f"""{name}_s AS (SELECT {b}date, count(*) AS _size, row_number() OVER ({part}ORDER BY date) - 1 AS i FROM {src} GROUP BY {b}date),
{name}_k AS (SELECT {b}date, _size, row_number() OVER ({part}ORDER BY date) - 1 AS k FROM {name}_s WHERE i % {h} = 0 AND _size >= {least}),
{name} AS MATERIALIZED (SELECT s.* EXCLUDE (_n), _size, k FROM {src} s JOIN {name}_k USING {on})"""


def basket_sql(top, by="", name="bk", src="rb", least=3):
    b = f"{by}, " if by else ""
    return f"""{name} AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {b}date ORDER BY score DESC, ticker) AS rn FROM {src})
  WHERE rn <= greatest(cast(round_even(_size * {top}, 0) AS bigint), {least}))"""


def weight_sql(kind, by="", name="hd", src="bk"):
    b = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {b}date)"
    raw = {"equal": "1.0", "score": f"score - min(score) {over} + 1e-9", "invvol": "1.0 / greatest(vol_20d, 1e-4)"}[kind]
    return f"{name} AS MATERIALIZED (SELECT * EXCLUDE (raw), raw / sum(raw) {over} AS w FROM (SELECT *, {raw} AS raw FROM {src}))"


def turn_sql(by="", name="tn", src="hd"):
    b = f"{by}, " if by else ""
    pb = "".join(f"AND p.{c} = h.{c} " for c in by.split(", ") if c)
    keys = ", ".join(f"coalesce(h.{c}, p.{c}) AS {c}" for c in by.split(", ") if c)
    keys = keys + ", " if keys else ""
    return f"""{name} AS (SELECT {b}k, sum(abs(coalesce(a, 0) - coalesce(c, 0))) AS turn FROM (
  SELECT {keys}coalesce(h.k, p.k + 1) AS k, h.w AS a, p.w AS c FROM {src} h FULL JOIN {src} p ON p.k + 1 = h.k AND p.ticker = h.ticker {pb}) GROUP BY {b}k)"""


def frame_sql(bps, by="", name="pf"):
    b = f"{by}, " if by else ""
    on = f"({b}k)"
    return f"""{name}_b AS (SELECT {b}date, k, avg(fwd_ret) AS bench FROM rb GROUP BY {b}date, k), {name}_p AS (SELECT {b}k, sum(fwd_ret * w) AS port, count(*) AS n FROM hd GROUP BY {b}k),
{name} AS MATERIALIZED (SELECT *, turn * {bps} / 1e4 AS cost, port - bench - turn * {bps} / 1e4 AS excess_net FROM {name}_b JOIN {name}_p USING {on} JOIN tn USING {on})"""


def backtest_sql(top=0.2, kind="equal", bps=5.0, src="sc", by="", head=SCORED_SQL):
    return (f"{head}, {rebalance_sql(src, by)}, {basket_sql(top, by)}, {weight_sql(kind, by)}, {turn_sql(by)}, {frame_sql(bps, by)}")


PERIOD = f"date, n, {rs('port', 'bench', 'turn', 'excess_net')}, {r('cost * 1e4', 'cost_bps')}"


def show(df, *by):
    return df.select(*by, "date", "n", "port", "bench", "turn", "excess_net", (F.col("cost") * 1e4).alias("cost_bps"))


@query("B1 B2 B3 B4 B5", f"{backtest_sql()} SELECT {PERIOD} FROM pf")
def equal_weight_backtest(spark, sf):
    return show(PF.backtest(scored_table(spark, sf), H, 0.2, group_rows=n_rows(spark, sf)))


@query("B3 B4 B5", f"{backtest_sql(0.33, 'score')} SELECT {PERIOD} FROM pf")
def score_weight_backtest(spark, sf):
    return show(PF.backtest(scored_table(spark, sf), H, 0.33, weight="score", group_rows=n_rows(spark, sf)))


@query("B3 B4 B5", f"{backtest_sql(0.33, 'invvol')} SELECT {PERIOD} FROM pf")
def inverse_volatility_backtest(spark, sf):
    return show(PF.backtest(scored_table(spark, sf), H, 0.33, weight="invvol", group_rows=n_rows(spark, sf)))


def arm_rows(spark, sf):
    return arms(scored_table(spark, sf))


ARM_SRC = "(SELECT arm, s AS score, * EXCLUDE (arm, s, score) FROM arms)"


def summary_sql(src, x, by="", sd="stddev_samp", turn=True):
    b = f"{by}, " if by else ""
    t = f", {r('avg(turn)', 'turn')}" if turn else ""
    return (f"SELECT {b}count({x}) AS n, {r(f'avg({x}) * {PY}', 'ann')}, {r(f'{sd}({x}) * sqrt({PY})', 'vol')}, {r(f'avg({x}) * {PY} / ({sd}({x}) * sqrt({PY}))', 'ir')}, "
            f"{r(f'avg({x}) / ({sd}({x}) / sqrt(count({x})))', 't')}, {r(f'avg(CASE WHEN {x} > 0 THEN 1.0 ELSE 0 END)', 'hit')}{t} FROM {src} GROUP BY ALL")


@query("B5 B7", f"{backtest_sql(0.2, src=ARM_SRC, by='arm', head=ARMS_SQL)} {summary_sql('pf', 'excess_net', 'arm')}")
def arm_summaries(spark, sf):
    bt = PF.backtest(arm_rows(spark, sf), H, 0.2, by=["arm"], group_rows=n_rows(spark, sf))
    return PF.summary(bt, "excess_net", PY, ["arm"])


@query("B7", f"{backtest_sql()} {summary_sql('pf', 'port', sd='stddev_pop')}")
def population_summary(spark, sf):
    return PF.summary(PF.backtest(scored_table(spark, sf), H, 0.2, group_rows=n_rows(spark, sf)), "port", PY, ddof=0)


TIERS = [(200000.0, 1.0), (160000.0, 3.0), (120000.0, 10.0), (0.0, 80.0)]
TIER_SQL = "CASE WHEN adv >= 200000 THEN 1.0 WHEN adv >= 160000 THEN 3.0 WHEN adv >= 120000 THEN 10.0 ELSE 80.0 END"


def _grid_sql():
    parts = []
    for kind in ("equal", "score"):
        for top in (0.1, 0.2, 0.33):
            inner = backtest_sql(top, kind, "(SELECT b FROM bps)", head=f"{SCORED_SQL}, bps AS (SELECT avg({TIER_SQL}) AS b FROM sc)")
            parts.append(f"SELECT '{kind}' AS weight, {top}::DOUBLE AS top, * FROM ({inner} SELECT {r('avg(port - bench)', 'gross')}, {r('avg(turn)', 'turn')}, "
                         f"{r('avg(port - bench) / greatest(avg(turn), 1e-9) * 1e4', 'breakeven_bps', 4)}, {r('avg(excess_net)', 'net')} FROM pf)")
    return " UNION ALL ".join(parts)


@query("B8 J11", _grid_sql())
def breakeven_grid(spark, sf):
    n = n_rows(spark, sf)
    sc = scored_table(spark, sf)
    bps = sc.agg(F.avg(PF.spread_of("adv", TIERS))).scalar()
    tops = F.explode(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.33)))
    rows = materialise(PF.rebalance_rows(sc, H, min_rows=6).withColumn("top", tops), "rebalance")  # the dates are the same for every share
    basket = PF.top_basket(rows, F.col("top"), ["top"], group_rows=n)
    out = None
    for kind in ("equal", "score"):
        frame = PF.period_frame(rows, PF.weigh(basket, kind, ["top"], group_rows=n), bps, ["top"])
        one = PF.breakeven(frame, ["top"]).join(frame.groupBy("top").agg(F.avg("excess_net").alias("net")), "top")
        one = one.select(F.lit(kind).alias("weight"), "top", "gross", "turn", F.round("breakeven_bps", 4).alias("breakeven_bps"), "net")
        out = one if out is None else out.unionByName(one)
    return out


LS = f"""{SCORED_SQL}, {rebalance_sql(least=12)},
lg AS (SELECT *, CASE WHEN hi <= 6 THEN 1 WHEN lo <= 6 THEN -1 END AS side FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS hi,
  row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS lo FROM rb)),
fr AS (SELECT date, k, avg(fwd_ret) FILTER (side = 1) AS long, avg(fwd_ret) FILTER (side = -1) AS short, avg(fwd_ret) AS bench FROM lg GROUP BY 1, 2),
m AS (SELECT k, side, ticker FROM lg WHERE side IS NOT NULL),
ch AS (SELECT k, count(*) / 12.0 AS turn FROM (SELECT coalesce(a.k, b.k + 1) AS k FROM m a FULL JOIN m b ON b.k + 1 = a.k AND a.side = b.side AND a.ticker = b.ticker WHERE a.k IS NULL OR b.k IS NULL) GROUP BY 1)"""


@query("B9 J12", f"""{LS} SELECT date, {rs('long', 'short', 'bench')}, {r('coalesce(turn, 0)', 'turn')}, {r('long - short', 'gross')},
  {r('long - short - coalesce(turn, 0) * 15 / 1e4', 'net')} FROM fr LEFT JOIN ch USING (k)""")
def long_short_books(spark, sf):
    out = PF.long_short(scored_table(spark, sf), H, 6, 15.0, group_rows=n_rows(spark, sf))
    return out.select("date", "long", "short", "bench", "turn", "gross", "net")


CLS = f"""{SCORED_SQL}, {rebalance_sql(least=1)}, cu AS (SELECT date, quantile_cont(confidence, 0.75) AS cut FROM rb GROUP BY 1),
pk AS (SELECT rb.*, CASE WHEN ret_20d > 0 THEN 1 WHEN ret_20d < 0 THEN -1 END AS side FROM rb JOIN cu USING (date) WHERE confidence >= cut),
l0 AS (SELECT date, avg(fwd_ret) FILTER (side = 1) AS long, avg(fwd_ret) FILTER (side = -1) AS short, count(*) FILTER (side = 1) AS n_long, count(*) FILTER (side = -1) AS n_short FROM pk WHERE side IS NOT NULL GROUP BY 1),
l1 AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS kk FROM l0 WHERE n_long > 0 AND n_short > 0),
m AS (SELECT kk, side, ticker FROM pk JOIN l1 USING (date) WHERE side IS NOT NULL),
ch AS (SELECT kk, count(*) AS changed FROM (SELECT coalesce(a.kk, b.kk + 1) AS kk FROM m a FULL JOIN m b ON b.kk + 1 = a.kk AND a.side = b.side AND a.ticker = b.ticker WHERE a.kk IS NULL OR b.kk IS NULL) GROUP BY 1)"""


@query("B10", f"""{CLS} SELECT date, n_long, n_short, {r('long')}, {r('short')}, {r('coalesce(changed, 0) / (n_long + n_short)', 'turn')},
  {r('long - short - coalesce(changed, 0) / (n_long + n_short) * 15 / 1e4', 'net')} FROM l1 LEFT JOIN ch USING (kk)""")
def conviction_books(spark, sf):
    out = PF.conviction_long_short(scored_table(spark, sf), H, "confidence", "ret_20d", 0.75, 15.0, n_rows(spark, sf))
    return out.select("date", "n_long", "n_short", "long", "short", "turn", "net")


CSAT = f"""{SCORED_SQL}, {rebalance_sql(least=10)}, c0 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY vol_20d, ticker) AS rn FROM rb),
c1 AS (SELECT *, rn <= greatest(cast(round_even(_size * 0.4, 0) AS bigint), 5) AS is_core, vol_20d * greatest(score, 0) AS bold FROM c0),
sat0 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY bold DESC, ticker) AS sn FROM c1 WHERE NOT is_core),
pk AS (SELECT date, k, ticker, fwd_ret, 'core' AS part FROM c1 WHERE is_core UNION ALL
  SELECT date, k, ticker, fwd_ret, 'satellite' FROM sat0 WHERE sn <= greatest(cast(round_even(_size * 0.1, 0) AS bigint), 2)),
hd AS MATERIALIZED (SELECT *, CASE WHEN part = 'core' THEN 0.85 ELSE 0.15 END / count(*) OVER (PARTITION BY date, part) AS w FROM pk), {turn_sql()}, {frame_sql(15.0)},
sz AS (SELECT k, count(*) FILTER (part = 'core') AS n_core, count(*) FILTER (part = 'satellite') AS n_sat FROM hd GROUP BY 1)"""


@query("B11 J9", f"{CSAT} SELECT date, n_core, n_sat, {rs('port', 'bench', 'turn', 'excess_net')} FROM pf JOIN sz USING (k)")
def core_satellite(spark, sf):
    out = PF.core_satellite(scored_table(spark, sf), H, "vol_20d", "score", 15.0, group_rows=n_rows(spark, sf))
    return out.select("date", "n_core", "n_sat", "port", "bench", "turn", "excess_net")


@query("B12", f"""{SCORED_SQL}, pk AS (SELECT t, ticker FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rn FROM sc) WHERE rn <= 5),
lv AS (SELECT ticker, t AS f, h, t + h AS tt FROM pk, (SELECT unnest(generate_series(1, 4)) AS h)), rt AS (SELECT date, t, ticker, close / nullif(lag(close) OVER ({B.AXIS}), 0) - 1 AS r1 FROM panel),
co AS (SELECT date, f, h, avg(r1) AS rr FROM lv JOIN rt ON rt.t = lv.tt AND rt.ticker = lv.ticker GROUP BY 1, 2, 3),
d AS (SELECT date, sum(rr) / 4 AS gross, count(*) AS cohorts, count(*) FILTER (h = 1) / 4 * 2 * 10 / 1e4 AS cost FROM co GROUP BY 1)
SELECT date, cohorts, {rs('gross')}, {r('gross - cost', 'net')} FROM d""")
def overlapping_cohorts(spark, sf):
    n = n_rows(spark, sf)
    from crosspanel.operators import rolling as R

    picks = X.top_n(scored_table(spark, sf), X.DATE, "score", 5, group_rows=n).select("t", "ticker")
    rets = B.panel(spark, sf).select("date", "t", "ticker", R.pct_change("close").alias("ret_1d"))
    return PF.overlapping_cohorts(picks, rets, 4, 10.0).select("date", "cohorts", "gross", "net")


@query("B13 B14", f"""{backtest_sql()}, x AS (SELECT date, port - cost AS net, sum(port - cost) OVER (ORDER BY date) AS cum, exp(sum(ln(1 + port - cost)) OVER (ORDER BY date)) AS growth FROM pf)
SELECT date, {rs('cum', 'growth')}, {r('cum - max(cum) OVER (ORDER BY date)', 'dd_add')}, {r('growth / max(growth) OVER (ORDER BY date) - 1', 'dd_mult')} FROM x""")
def equity_curve(spark, sf):
    bt = PF.backtest(scored_table(spark, sf), H, 0.2, group_rows=n_rows(spark, sf)).withColumn("net", F.col("port") - F.col("cost"))
    return PF.equity(bt, "net").select("date", "cum", "growth", "dd_add", "dd_mult")


@query("B13 X9", f"""{SCORED_SQL}, {rebalance_sql(least=5)}, q AS (SELECT date, fwd_ret, {' + '.join(f'CASE WHEN 5 * (rn - 1) > {k} * (_size - 1) THEN 1 ELSE 0 END' for k in range(1, 5))} AS tile
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS rn FROM rb)), d AS (SELECT date, tile, avg(fwd_ret) AS ret, count(*) AS n FROM q GROUP BY 1, 2)
SELECT date, tile, n, {rs('ret')}, {r('exp(sum(ln(1 + ret)) OVER (PARTITION BY tile ORDER BY date))', 'growth')} FROM d""")
def quantile_equity(spark, sf):
    books = PF.quantile_books(scored_table(spark, sf), H, 5, n_rows(spark, sf))
    return PF.equity(books, "ret", ["tile"]).select("date", "tile", "n", "ret", "growth")


BENCH = "bs AS (SELECT date, lead(close, 5) OVER (ORDER BY date) / close - 1 AS bench_ret FROM ohlcv WHERE ticker = 'F000000003')"


def with_benchmark(spark, sf, bt):
    px = B.ohlcv(spark, sf).filter(F.col("ticker") == "F000000003").select("date", "close")
    return J.forward_asof(bt, "date", PF.forward_series(px, H, "bench_ret").withColumnRenamed("date", "at"), ["bench_ret"], date="at")


BT_BENCH = f"""{backtest_sql()}, {BENCH}, seek AS (SELECT pf.date, coalesce((SELECT min(date) FROM bs WHERE bs.date >= pf.date), (SELECT max(date) FROM bs)) AS d FROM pf),
wb AS (SELECT pf.*, port - cost AS net, bench_ret FROM pf JOIN seek USING (date) JOIN bs ON bs.date = seek.d)"""


@query("B15 J6", f"""{BT_BENCH}, x AS (SELECT *, net - bench_ret AS ex FROM wb WHERE net IS NOT NULL AND bench_ret IS NOT NULL)
SELECT count(*) AS n, {r('regr_slope(net, bench_ret)', 'beta')}, {r(f'regr_intercept(net, bench_ret) * {PY}', 'alpha')}, {r('corr(net, bench_ret)', 'corr')},
  {r(f'avg(ex) * {PY}', 'excess')}, {r(f'avg(ex) * {PY} / (stddev_samp(ex) * sqrt({PY}))', 'ir')}, {r('avg(ex) / (stddev_samp(ex) / sqrt(count(*)))', 't')},
  {r('avg(CASE WHEN ex > 0 THEN 1.0 ELSE 0 END)', 'hit')} FROM x""")
def benchmark_regression(spark, sf):
    bt = PF.backtest(scored_table(spark, sf), H, 0.2, group_rows=n_rows(spark, sf))
    bt = with_benchmark(spark, sf, bt.withColumn("net", F.col("port") - F.col("cost")))
    return PF.against_benchmark(bt, "net", "bench_ret", PY)


@query("B16 J6", f"""{BT_BENCH} SELECT date, {r('exp(sum(ln(1 + coalesce(net, 0))) OVER (ORDER BY date))', 'model')}, {r('exp(sum(ln(1 + coalesce(bench_ret, 0))) OVER (ORDER BY date))', 'benchmark')} FROM wb""")
def benchmark_curve(spark, sf):
    bt = PF.backtest(scored_table(spark, sf), H, 0.2, group_rows=n_rows(spark, sf))
    bt = with_benchmark(spark, sf, bt.withColumn("net", F.col("port") - F.col("cost")))
    curves = PF.equity(bt, "net").withColumnRenamed("growth", "model").drop("cum", "dd_add", "dd_mult")
    return PF.equity(curves, "bench_ret").select("date", "model", F.col("growth").alias("benchmark"))


@query("B17", f"""{SCORED_SQL}, {rebalance_sql()}, {basket_sql(0.2)}, p AS (SELECT category, count(*) / sum(count(*)) OVER () AS s FROM bk GROUP BY 1),
u AS (SELECT category, count(*) / sum(count(*)) OVER () AS s FROM (SELECT DISTINCT ticker, category FROM sc) GROUP BY 1)
SELECT category, {r('p.s', 'pick_share')}, {r('u.s', 'universe_share')}, {r('p.s - coalesce(u.s, 0)', 'tilt')} FROM p LEFT JOIN u USING (category) ORDER BY p.s - coalesce(u.s, 0) DESC, category LIMIT 3""")
def category_tilt(spark, sf):
    sc = scored_table(spark, sf)
    picks = PF.top_basket(PF.rebalance_rows(sc, H, min_rows=6), 0.2, group_rows=n_rows(spark, sf))
    return PF.category_tilt(picks, sc, 3)


@query("B18", f"""{backtest_sql()} SELECT year(date) AS year, count(excess_net) AS n, {r('sum(excess_net)', 'total')}, {r('avg(excess_net)', 'mean')},
  {r('avg(CASE WHEN excess_net > 0 THEN 1.0 ELSE 0 END)', 'hit')} FROM pf GROUP BY 1""")
def portfolio_by_year(spark, sf):
    return PF.by_year(PF.backtest(scored_table(spark, sf), H, 0.2, group_rows=n_rows(spark, sf)), "excess_net")


def buffer_walk_sql(by):
    """Baskets ``bk`` of the rows ``rb``, which carry top and buffer, as a recursion over rebalance dates that carries the held list."""
    same = " AND ".join(f"r.{c} = w.{c}" for c in by.split(", "))
    r_by = ", ".join(f"r.{c}" for c in by.split(", "))
    return f"""rk AS MATERIALIZED (SELECT {by}, k, _size, list({{'t': ticker, 'o': rn}} ORDER BY rn) AS l,
  greatest(cast(round_even(_size * top, 0) AS bigint), 3) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {by}, date ORDER BY score DESC, ticker) AS rn FROM rb) GROUP BY {by}, k, _size),
wk AS (SELECT {by}, 0::BIGINT AS k, list_transform(l[:n], lambda x: x.t) AS held FROM rk WHERE k = 0 UNION ALL
  SELECT {by}, k, list_concat(st, nw[:greatest(n - len(st), 0)])[:n] FROM (SELECT {r_by}, r.k, r.n,
    list_transform(list_filter(r.l, lambda x: r.buffer > 0 AND list_contains(w.held, x.t) AND x.o <= least(cast(floor(r.n * (1 + r.buffer)) AS bigint), r._size)), lambda x: x.t) AS st,
    list_transform(list_filter(r.l, lambda x: r.buffer = 0 OR NOT list_contains(w.held, x.t)), lambda x: x.t) AS nw FROM wk w JOIN rk r ON r.k = w.k + 1 AND {same}) r),
wu AS (SELECT {by}, k, unnest(held) AS ticker FROM wk), bk AS MATERIALIZED (SELECT rb.* FROM rb JOIN wu USING ({by}, k, ticker))"""


WALK = "top, buffer"


@query("B6", f"""{SCORED_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, sb AS (SELECT *, 0.2::DOUBLE AS top, 0.5::DOUBLE AS buffer FROM sc), {rebalance_sql('sb', WALK)}, {buffer_walk_sql(WALK)}
SELECT k, ticker FROM bk""")
def buffered_baskets(spark, sf):
    rows = PF.rebalance_rows(scored_table(spark, sf), H, min_rows=6).withColumns({"top": F.lit(0.2), "buffer": F.lit(0.5)})
    return PF.buffered_baskets(rows, "top", "buffer", ["top", "buffer"], group_rows=n_rows(spark, sf)).select("k", "ticker")


