"""Overfitting and significance statistics of the configuration grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import r, rs
from catalog.evaluation import ic_sql, nw_sql
from catalog.portfolios import H, PY, basket_sql, buffer_walk_sql, frame_sql, rebalance_sql, turn_sql, weight_sql
from catalog.registry import query
from catalog.scored import SCORED_SQL, scored, scored_table
from crosspanel.functions import stats as ST
from crosspanel.operators import overfit as O
from crosspanel.operators import portfolio as PF

# the configuration grid: 4 liquidity floors x 4 basket shares x 2 buffers
SCREENS = [0.0, 90000.0, 120000.0, 150000.0]
TOPS = [0.1, 0.15, 0.2, 0.33]
BUFFERS = [0.0, 0.5]
NAMES = [f"screen{s}_top{t}_buffer{b}" for s in SCREENS for t in TOPS for b in BUFFERS]


def configs(spark, buffers):
    return PF.config_grid(spark, screen=SCREENS, top=TOPS, buffer=list(buffers))


def returns(spark, sf, buffers=tuple(BUFFERS)):
    sc = scored_table(spark, sf).select("date", "ticker", "score", "fwd_ret", "adv", "rel")
    return O.config_returns(sc, configs(spark, buffers), H, group_rows=B.universe_rows(spark, sf))


def named(df):
    return df.withColumn("config", O.label_config())


BY = "screen, top, buffer"


def grid_sql(buffers, baskets, head=SCORED_SQL):
    return f"""{head}, cfg AS (SELECT screen, top, buffer FROM (SELECT unnest({SCREENS}::DOUBLE[]) AS screen), (SELECT unnest({TOPS}::DOUBLE[]) AS top), (SELECT unnest({buffers}::DOUBLE[]) AS buffer)),
tg AS MATERIALIZED (SELECT sc.*, cfg.* FROM sc, cfg WHERE adv >= screen), {rebalance_sql('tg', BY)}, {baskets}, {weight_sql('equal', BY)}, {turn_sql(BY)}, {frame_sql(5.0, BY)},
g0 AS (SELECT {BY}, date, excess_net AS ret FROM pf), g1 AS (SELECT {BY} FROM g0 GROUP BY ALL HAVING count(*) >= 40), g2 AS (SELECT g0.* FROM g0 JOIN g1 USING ({BY})),
m AS MATERIALIZED (SELECT *, 'screen' || cast(screen AS varchar) || '_top' || cast(top AS varchar) || '_buffer' || cast(buffer AS varchar) AS config FROM g2
  WHERE date IN (SELECT date FROM g2 GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM g1)))"""


PLAIN = grid_sql([0.0], basket_sql('top', BY))


@query("O1 B5", f"{PLAIN} SELECT {BY}, date, {rs('ret')} FROM m")
def config_returns(spark, sf):
    """The half of the grid without a buffer, whose baskets need no walk."""
    return returns(spark, sf, (0.0,))


GRID = grid_sql(BUFFERS, buffer_walk_sql(BY), SCORED_SQL.replace("WITH", "WITH RECURSIVE", 1))


@query("O1 B6", f"{GRID} SELECT {BY}, date, {rs('ret')} FROM m")
def config_returns_buffered(spark, sf):
    """The whole grid of 32: with a buffer, incumbents inside the widened band stay."""
    return returns(spark, sf)


RATIO = f"{GRID}, rt AS (SELECT {BY}, config, count(*) AS periods, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret) / stddev_samp(ret) * sqrt({PY}) AS ir FROM m GROUP BY ALL)"


@query("O1", f"{RATIO} SELECT {BY}, periods, {rs('mean', 'sd', 'ir')} FROM rt")
def config_ratios(spark, sf):
    return O.config_ratio(returns(spark, sf), PY)


def _share(d):
    return (f"SELECT '{d}' AS dimension, {r('sum((m - g) * (m - g)) / sum((ir - g) * (ir - g))', 'share')} FROM "
            f"(SELECT ir, avg(ir) OVER (PARTITION BY {d}) AS m, avg(ir) OVER () AS g FROM rt)")


@query("O2", f"{RATIO} {' UNION ALL '.join(_share(d) for d in O.DIMS)}")
def variance_shares(spark, sf):
    return O.variance_shares(O.config_ratio(returns(spark, sf), PY))


@query("O3", f"""{GRID}, c AS (SELECT a.config AS x, b.config AS y, corr(a.ret, b.ret) AS c FROM m a JOIN m b USING (date) GROUP BY 1, 2)
SELECT {r('avg(c) FILTER (x < y)', 'mean_corr')}, {r('(SELECT count(DISTINCT config) FROM m) ** 2 / sum(c * c)', 'n_effective')},
  (SELECT count(DISTINCT config) FROM m) AS n_nominal FROM c""")
def effective_trials(spark, sf):
    return O.effective_trials(named(returns(spark, sf)), NAMES)


def _squared(k):
    return f"""sq{k} AS MATERIALIZED (SELECT a.x, b.y, sum(a.c * b.c) AS c FROM pw{k} a JOIN pw{k} b ON a.y = b.x GROUP BY 1, 2),
pw{k + 1} AS MATERIALIZED (SELECT x, y, c / (SELECT sum(c) FROM sq{k} WHERE x = y) AS c FROM sq{k})"""


@query("O3", f"""{GRID}, c AS (SELECT a.config AS x, b.config AS y, corr(a.ret, b.ret) AS c FROM m a JOIN m b USING (date) GROUP BY 1, 2),
nm AS (SELECT unnest({NAMES}) AS x), pw0 AS MATERIALIZED (SELECT a.x, b.x AS y, CASE WHEN a.x = b.x THEN 1.0 ELSE coalesce(c.c, 0) END AS c FROM nm a CROSS JOIN nm b LEFT JOIN c ON c.x = a.x AND c.y = b.x),
{", ".join(_squared(k) for k in range(O.SQUARINGS))}
SELECT {r(f'sum(a.c * b.c) / {len(NAMES)}', 'pc1_share')} FROM pw0 a JOIN pw{O.SQUARINGS} b USING (x, y)""")
def first_component_share(spark, sf):
    """Share of the largest eigenvalue of the configurations' correlation matrix."""
    return O.first_component_share(named(returns(spark, sf)), NAMES)


@query("O4", f"""{GRID}, mo AS (SELECT {BY}, count(*) AS periods, avg(ret) / stddev_samp(ret) AS sr, (sum(pow(ret - mu, 3)) / count(*)) / pow(stddev_pop(ret), 3) AS skew,
  (sum(pow(ret - mu, 4)) / count(*)) / pow(stddev_pop(ret), 4) AS kurt FROM (SELECT *, avg(ret) OVER (PARTITION BY {BY}) AS mu FROM m) GROUP BY ALL),
t0 AS (SELECT *, count(sr) OVER () AS nt, var_samp(sr) OVER () AS v FROM mo), t1 AS (SELECT *, 1 - 1 / nt AS p1, 1 - 1 / (nt * exp(1)) AS p2 FROM t0),
t2 AS (SELECT *, {ST.normal_ppf_start_sql('p1')} AS s1, {ST.normal_ppf_start_sql('p2')} AS s2 FROM t1),
t3 AS (SELECT *, CASE WHEN nt >= 2 AND v > 0 THEN sqrt(v) * ({1 - O.GAMMA} * {ST.normal_ppf_step_sql('s1', 'p1')} + {O.GAMMA} * {ST.normal_ppf_step_sql('s2', 'p2')}) ELSE 0 END AS sr0,
  1 - skew * sr + (kurt - 1) / 4 * sr * sr AS inside FROM t2),
t4 AS (SELECT *, CASE WHEN inside > 0 THEN (sr - sr0) * sqrt(periods - 1.0) / sqrt(inside) END AS z FROM t3)
SELECT {BY}, periods, {r('sr', 'sr')}, {r(f'sr * sqrt({PY})', 'sr_ann')}, {rs('sr0', 'skew', 'kurt')}, {r(ST.normal_cdf_sql('z'), 'dsr')} FROM t4""")
def deflated_sharpe(spark, sf):
    """Probability that each configuration beats the best of as many zero-skill trials."""
    return O.deflated_sharpe(returns(spark, sf), PY)


@query("O4", f"""{GRID} SELECT {BY}, count(*) AS periods, {r('avg(ret) / stddev_samp(ret)', 'sr')},
  {r('(sum(pow(ret - mu, 3)) / count(*)) / pow(stddev_pop(ret), 3)', 'skew')}, {r('(sum(pow(ret - mu, 4)) / count(*)) / pow(stddev_pop(ret), 4)', 'kurt')}
FROM (SELECT *, avg(ret) OVER (PARTITION BY {BY}) AS mu FROM m) GROUP BY ALL""")
def config_moments(spark, sf):
    return O.moments(returns(spark, sf), O.DIMS)


CSCV = f"""{GRID}, dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM m)),
bl AS (SELECT date, CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1) ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // (n // 10) END AS block FROM dn),
mk AS (SELECT id FROM (SELECT unnest(generate_series(0, 1023)) AS id) WHERE bit_count(id) = 5),
hv AS (SELECT id, config, (id >> block) & 1 = 1 AS inside, ret FROM m JOIN bl USING (date), mk),
sr AS (SELECT id, config, round(avg(ret) FILTER (inside) / stddev_samp(ret) FILTER (inside), 10) AS a, round(avg(ret) FILTER (NOT inside) / stddev_samp(ret) FILTER (NOT inside), 10) AS b FROM hv GROUP BY 1, 2),
ranked AS (SELECT *, (rank() OVER (PARTITION BY id ORDER BY b) + (count(*) OVER (PARTITION BY id, b) - 1) / 2.0) / count(*) OVER (PARTITION BY id) AS rb,
  row_number() OVER (PARTITION BY id ORDER BY a DESC, config) AS best, count(*) OVER (PARTITION BY id) AS nc FROM sr),
w AS MATERIALIZED (SELECT id, config, nc, greatest(1.0 / (nc + 1), least(1 - 1.0 / (nc + 1), rb)) AS ro FROM ranked WHERE best = 1), lg AS (SELECT *, ln(ro / (1 - ro)) AS logit FROM w)"""


@query("O5", f"{CSCV} SELECT id AS mask, config AS winner, {r('ro', 'rank_out')}, {rs('logit')} FROM lg")
def cscv_splits(spark, sf):
    return O.cscv_splits(named(returns(spark, sf))).select("mask", "winner", "rank_out", "logit")


@query("O5", f"""{CSCV} SELECT count(*) AS n_combinations, max(nc) AS n_configs, {r('avg(CASE WHEN logit < 0 THEN 1.0 ELSE 0 END)', 'pbo')},
  {r('median(logit)', 'median_logit')}, {r('median(ro)', 'median_oos_rank')} FROM lg""")
def overfit_probability(spark, sf):
    return O.overfit_probability(O.cscv_splits(named(returns(spark, sf))))


ONE = f"{GRID}, one AS (SELECT date, ret, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM m WHERE config = '{NAMES[1]}')"


def one_config(spark, sf):
    return returns(spark, sf).filter((F.col("screen") == SCREENS[0]) & (F.col("top") == TOPS[0]) & (F.col("buffer") == BUFFERS[1])).select("date", "ret")


@query("O6", f"""{ONE}, dr AS (SELECT d AS draw, j, cast('0x' || substr(md5('0|' || cast(d AS varchar) || '|' || cast(j AS varchar)), 1, 12) AS bigint) % (SELECT max(n) FROM one) AS pos
  FROM (SELECT unnest(generate_series(0, 19999)) AS d), (SELECT unnest(generate_series(0, (SELECT max(n) - 1 FROM one))) AS j)),
bt AS (SELECT draw, avg(ret) / stddev_samp(ret) * sqrt({PY}) AS ir FROM dr JOIN one USING (pos) GROUP BY 1)
SELECT count(*) AS periods, {r(f'avg(ret) / stddev_samp(ret) * sqrt({PY})', 'ir')}, {r('avg(ret) / stddev_samp(ret) * sqrt(count(*))', 't')}, {r(f'sqrt({PY} / count(*))', 'ir_se')},
  {r('(SELECT quantile_cont(ir, 0.025) FROM bt)', 'low')}, {r('(SELECT quantile_cont(ir, 0.975) FROM bt)', 'high')},
  {r('(SELECT avg(CASE WHEN ir <= 0 THEN 1.0 ELSE 0 END) FROM bt)', 'share_le_0')} FROM one""")
def bootstrap_interval(spark, sf):
    return O.bootstrap_summary(one_config(spark, sf), PY, 20000)


@query("O6 E8", f"""{RATIO}, tt AS (SELECT {BY}, periods, ir, mean / (sd / sqrt(periods)) AS t, periods - 1 AS df FROM rt), ab AS (SELECT *, abs(t) AS size FROM tt)
SELECT {BY}, periods, {rs('ir', 't')}, {r(f"1 - ({ST.t_cdf_sql('t', 'df')})", 'p_one_sided')}, {r(f"2 * (1 - ({ST.normal_cdf_sql('size')}))", 'p_two_sided')} FROM ab""")
def p_values(spark, sf):
    """One-sided Student and two-sided normal p-values of every configuration's mean."""
    ratios = O.config_ratio(returns(spark, sf), PY)
    return O.with_p_values(ratios.withColumn("t", F.col("mean") / (F.col("sd") / F.sqrt("periods")))).drop("mean", "sd")


@query("O7", f"""{GRID}, dn AS (SELECT date, row_number() OVER (ORDER BY date) <= count(*) OVER () // 2 AS fst FROM (SELECT DISTINCT date FROM m)),
p AS (SELECT config, round(avg(ret) FILTER (fst) / stddev_samp(ret) FILTER (fst) * sqrt({PY}), 10) AS a, round(avg(ret) FILTER (NOT fst) / stddev_samp(ret) FILTER (NOT fst) * sqrt({PY}), 10) AS b FROM m JOIN dn USING (date) GROUP BY 1),
k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p)
SELECT {r('corr(ra, rb)', 'spearman')}, {r('regr_slope(b, a)', 'slope')}, {r('regr_intercept(b, a)', 'intercept')}, arg_max(config, row(a, config)) AS best_config,
  {r('max(a)', 'best_first')}, {r('arg_max(b, row(a, config))', 'its_second')}, {r('max(b)', 'best_second')} FROM k""")
def half_degradation(spark, sf):
    return O.half_degradation(named(returns(spark, sf)), PY)


@query("O8 E6 E7 E8", f"""{SCORED_SQL}, scr AS (SELECT screen, sc.* FROM sc, (SELECT unnest({SCREENS}::DOUBLE[]) AS screen) WHERE adv >= screen),
{ic_sql('scr', 'screen', 8)}, {nw_sql('ic', 5, 'screen')} SELECT screen, n, {rs('mean', 'se', 't_iid', 'autocorr1', 'share_positive')}, {r('mean / se', 't')} FROM nw2""")
def screened_ic(spark, sf):
    return O.screened_ic(scored(spark, sf), SCREENS, 5, 8, B.universe_rows(spark, sf))
