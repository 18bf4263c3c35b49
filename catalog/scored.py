"""The scored panel used by evaluation, portfolio and screen queries, in Spark and in SQL.

Class probabilities are a fixed softmax of 20-row momentum, so both engines can
form them; outcome columns come from the label operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import chg, loo, roll, tile_sql
from catalog.families import staged
from catalog.labels import fwd
from crosspanel.functions.expr import clip
from crosspanel.operators import cross as X
from crosspanel.operators import decisions as D
from crosspanel.operators import labels as L
from crosspanel.operators import rolling as R
from crosspanel.session import materialise

HORIZON = 5
NEEDED = ["ret_20d", "ret_5d", "vol_20d", "adv", "rel"]


def scored(spark, sf, horizon: int = HORIZON):
    """date, t, ticker, category, features, p0..p2, score, prediction, confidence, fwd_ret, rel, target."""
    n = B.universe_rows(spark, sf)
    g = B.panel(spark, sf).withColumns({
        "ret_1d": R.pct_change("close"), "ret_5d": R.pct_change("close", 5), "ret_20d": R.pct_change("close", 20),
        "dv": F.col("close") * F.col("volume"), "fwd_ret": L.forward_return(horizon)})
    g = g.withColumns({"vol_20d": R.std("ret_1d", 20), "adv": R.mean("dv", 20)})
    g = X.add_loo(g, X.PEERS, {"_peer": "fwd_ret"}, False, n).withColumn("rel", F.col("fwd_ret") - F.col("_peer"))
    g = g.dropna(subset=NEEDED)
    s = clip(F.col("ret_20d") * 25, -3.0, 3.0)
    g = g.withColumns({"_u": F.exp(-s), "_o": F.exp(s)})
    total = F.col("_u") + 1 + F.col("_o")
    g = g.withColumns({"p0": F.col("_u") / total, "p1": F.lit(1.0) / total, "p2": F.col("_o") / total})
    g = g.withColumns(D.score_columns())
    g = X.quantile_tile(g, X.DATE, "rel", "target", 3, group_rows=n)
    return g.select(
        "date", "t", "ticker", "category", F.year("date").alias("year"), "close", "ret_1d", "ret_5d", "ret_20d", "vol_20d",
        "adv", "p0", "p1", "p2", "score", "prediction", "confidence", "fwd_ret", "rel", "target")


def scored_table(spark, sf):
    """The scored panel as a written table, for queries that read it several times."""
    return materialise(scored(spark, sf), "scored")


_STAGES = [
    {"ret_1d": chg("close"), "ret_5d": chg("close", 5), "ret_20d": chg("close", 20), "dv": "close * volume", "fwd_ret": fwd(HORIZON)},
    {"vol_20d": roll("stddev_samp", "ret_1d", 20), "adv": roll("avg", "dv", 20), "rel": f"fwd_ret - {loo('fwd_ret')}",
     "s": "least(3, greatest(-3, ret_20d * 25))"},
]
SCORED_SQL = staged(_STAGES) + f""",
q1 AS MATERIALIZED (SELECT *, exp(-s) / (exp(-s) + 1 + exp(s)) AS p0, 1 / (exp(-s) + 1 + exp(s)) AS p1, exp(s) / (exp(-s) + 1 + exp(s)) AS p2
  FROM z WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NEEDED)}),
q2 AS MATERIALIZED (SELECT *, p2 - p0 AS score, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction,
  greatest(p0, p1, p2) AS confidence, year(date) AS year, row_number() OVER (PARTITION BY date ORDER BY rel, ticker) AS _rn,
  count(*) OVER (PARTITION BY date) AS _n FROM q1),
sc AS MATERIALIZED (SELECT *, {tile_sql('_rn', '_n', 3)} AS target FROM q2)"""

ARMS = ["momentum", "reversal", "quiet"]


def arms(df):
    """Three score definitions over the same rows, tagged by arm."""
    return df.withColumn("arm_score", F.explode(F.array(
        F.struct(F.lit("momentum").alias("arm"), F.col("score").alias("s")),
        F.struct(F.lit("reversal").alias("arm"), (-F.col("ret_5d")).alias("s")),
        F.struct(F.lit("quiet").alias("arm"), (-F.col("vol_20d")).alias("s"))))
    ).withColumns({"arm": F.col("arm_score.arm"), "score": F.col("arm_score.s")}).drop("arm_score")


ARMS_SQL = f"""{SCORED_SQL}, arms AS MATERIALIZED (
  SELECT 'momentum' AS arm, score AS s, * EXCLUDE (s) FROM sc UNION ALL SELECT 'reversal', -ret_5d, * EXCLUDE (s) FROM sc
  UNION ALL SELECT 'quiet', -vol_20d, * EXCLUDE (s) FROM sc)"""
