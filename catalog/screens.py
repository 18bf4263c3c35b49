"""Queries over a scored day, metadata and score records."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import pr, r, rs
from catalog.evaluation import TERC
from catalog.families import staged
from catalog.indicators import V3_BASE, v3_stages
from catalog.registry import query
from catalog.scored import ARMS_SQL, NEEDED, SCORED_SQL, arms, scored, scored_table
from crosspanel.operators import cross as X
from crosspanel.operators import quality as Q
from crosspanel.operators import screen as S
from crosspanel.plans import families as FM
from crosspanel.plans import indicators as I
from crosspanel.session import scratch_path
from crosspanel.sources import panel as P
from crosspanel.sources import uploads as U

META = B.META.replace("meta AS", "WITH meta AS", 1)
WORD = "CASE prediction WHEN 0 THEN 'underperform' WHEN 1 THEN 'neutral' ELSE 'outperform' END"
DAY = f"""{SCORED_SQL}, dy AS MATERIALIZED (SELECT sc.ticker, date, score, confidence, {WORD} AS prediction, m.name, m.category, category_group, family, exchange, is_leveraged
  FROM sc LEFT JOIN meta m ON m.ticker = sc.ticker WHERE date = (SELECT max(date) FROM sc))"""


def day(spark, sf):
    sc = scored_table(spark, sf).withColumn("prediction", S.class_word("prediction")).drop("category")
    return S.scored_day(sc, B.metadata(spark, sf), NEEDED)


@query("Q1", f"""{B.OHLCV_SQL}, d AS (SELECT DISTINCT date FROM ohlcv) SELECT date, (SELECT min(date) FROM d) AS first_date, (SELECT max(date) FROM d) AS last_date
FROM d ORDER BY date DESC LIMIT 30""")
def scoreable_dates(spark, sf):
    return S.scoreable_dates(B.ohlcv(spark, sf), 30)


@query("Q2 J4 M7", f"{DAY} SELECT ticker, date, {rs('score', 'confidence')}, prediction, name, category, is_leveraged FROM dy")
def scored_day(spark, sf):
    return day(spark, sf).select("ticker", "date", "score", "confidence", "prediction", "name", "category", "is_leveraged")


@query("Q3", f"""{DAY} SELECT ticker, {rs('score')}, prediction FROM dy WHERE category IN ('ASIA', 'MIDDLE EAST', 'EUROPE') AND prediction IN ('outperform', 'neutral')
  AND NOT coalesce(is_leveraged, false) AND score >= -0.5 AND score <= 0.9 AND confidence >= 0.334
  AND (contains(lower(ticker), 'nation') OR contains(lower(coalesce(name, '')), 'nation') OR contains(lower(coalesce(family, '')), 'nation') OR contains(lower(coalesce(category, '')), 'nation'))""")
def filtered_day(spark, sf):
    out, missing = S.select_rows(day(spark, sf), [
        *S.one_of("category", ["ASIA", "MIDDLE EAST", "EUROPE"]), *S.one_of("no_such_field", ["x"]), *S.one_of("prediction", ["outperform", "neutral"]),
        *S.unset("is_leveraged"), *S.within("score", -0.5, 0.9), *S.within("confidence", 0.334)], "Nation")
    assert missing == ["no_such_field"]
    return out.select("ticker", "score", "prediction")


@query("Q4", f"""{META}, w AS (SELECT * FROM (VALUES ('category', 'ASIA'), ('category', 'ATLANTIS'), ('exchange', 'NMS'), ('exchange', 'XXX')) t(field, value))
SELECT field, value FROM w WHERE NOT EXISTS (SELECT 1 FROM meta WHERE (field = 'category' AND category = value) OR (field = 'exchange' AND exchange = value))""")
def unknown_facet_values(spark, sf):
    return S.unknown_values(B.metadata(spark, sf), {"category": ["ASIA", "ATLANTIS"], "exchange": ["NMS", "XXX"]})


@query("Q5", f"{META} SELECT ticker, name, category FROM meta ORDER BY category DESC NULLS LAST, ticker LIMIT 10 OFFSET 5")
def sorted_page(spark, sf):
    return S.sort_page(B.metadata(spark, sf), "category", False, 5, 10).select("ticker", "name", "category")


@query("Q5", f"{META} SELECT ticker, name, category FROM meta ORDER BY category DESC NULLS LAST, ticker LIMIT 4 OFFSET 8")
def keyset_page(spark, sf):
    """The third page, each page found by the last key of the one before."""
    meta, after = B.metadata(spark, sf), None
    for _ in range(2):
        last = S.page_after(meta, "category", False, after, 4).select("category", "ticker").collect()[-1]  # one page
        after = tuple(last)
    return S.page_after(meta, "category", False, after, 4).select("ticker", "name", "category")


@query("Q5", f"""{META}, n AS (SELECT category, ticker, row_number() OVER (ORDER BY category DESC NULLS LAST, ticker) AS k, count(*) OVER () AS n FROM meta)
SELECT k // 4 + 1 AS page, category AS value, ticker FROM n WHERE k % 4 = 0 AND k < n""")
def page_starts(spark, sf):
    """The key before every page of four."""
    return S.page_starts(B.metadata(spark, sf), "category", False, 4)


@query("Q6", f"""{DAY} SELECT count(*) AS n, {r('avg(score)', 'mean_score')}, {r('avg(confidence)', 'mean_confidence')}, count(*) FILTER (prediction = 'underperform') AS underperform,
  count(*) FILTER (prediction = 'neutral') AS neutral, count(*) FILTER (prediction = 'outperform') AS outperform FROM dy""")
def day_summary(spark, sf):
    return S.day_summary(day(spark, sf))


@query("Q7", f"""{DAY} SELECT category, count(*) AS n_funds, {r('avg(score)', 'mean_score')}, {r('avg(confidence)', 'mean_confidence')},
  count(*) FILTER (prediction = 'outperform') AS n_outperform, count(*) FILTER (prediction = 'underperform') AS n_underperform, arg_min(ticker, row(-score, ticker)) AS top_ticker
FROM dy GROUP BY 1 HAVING count(*) >= 3""")
def category_roll_up(spark, sf):
    return S.roll_up(day(spark, sf), "category", 3)


@query("Q8", f"""{DAY} SELECT 'best' AS side, * FROM (SELECT ticker, name, {rs('score')} FROM dy ORDER BY dy.score DESC, ticker LIMIT 10)
UNION ALL SELECT 'worst', * FROM (SELECT ticker, name, {rs('score')} FROM dy ORDER BY dy.score, ticker LIMIT 10)""")
def best_and_worst(spark, sf):
    d = day(spark, sf).select("ticker", "name", "score")
    tag = lambda df, s: df.select(F.lit(s).alias("side"), "*")
    return tag(S.picks(d, 10), "best").unionByName(tag(S.picks(d, 10, best=False), "worst"))


@query("Q9 W16 J8", f"""{SCORED_SQL}, h AS (SELECT date, score, target FROM sc WHERE ticker = 'F000000007' ORDER BY date DESC LIMIT 60)
SELECT date, {r('score')}, target, {r('close')} FROM h JOIN (SELECT date, close FROM ohlcv WHERE ticker = 'F000000007') USING (date)""")
def ticker_history(spark, sf):
    h = S.ticker_history(scored(spark, sf), "f000000007", 60).select("date", "score", "target")
    return h.join(S.history_prices(B.ohlcv(spark, sf), h, "f000000007"), "date")


def search_universe(spark, sf):
    """Parts as a search universe: symbol, name, type as category, brand as family."""
    p = B.table(spark, sf, "part")
    return p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"),
                    F.col("p_type").alias("category"), F.col("p_brand").alias("family"))


def part_liquidity(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return li.groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker")).agg(F.sum("l_quantity").alias("liquidity"))


def search_sql(q, limit):
    low = q.lower()
    return f"""WITH u AS (SELECT 'P' || cast(p_partkey AS varchar) AS ticker, p_name AS name, p_type AS category, p_brand AS family, lower(p_name) AS n, lower(p_type) AS c,
  lower(p_brand) AS f, lower('P' || cast(p_partkey AS varchar)) AS k FROM part), lq AS (SELECT 'P' || cast(l_partkey AS varchar) AS ticker, sum(l_quantity) AS liquidity FROM lineitem GROUP BY 1),
b AS (SELECT *, CASE WHEN k = '{low}' THEN 0 WHEN starts_with(k, '{low}') THEN 1 WHEN regexp_matches(n, '(^|[^a-z0-9])\\Q{low}\\E([^a-z0-9]|$)') THEN 2
  WHEN regexp_matches(n, '(^|[^a-z0-9])\\Q{low}\\E') THEN 3 WHEN contains(k, '{low}') THEN 4 WHEN contains(n, '{low}') THEN 5
  WHEN regexp_matches(f, '(^|[^a-z0-9])\\Q{low}\\E') OR regexp_matches(c, '(^|[^a-z0-9])\\Q{low}\\E') THEN 6 WHEN contains(f, '{low}') OR contains(c, '{low}') THEN 7 END AS bucket,
  CASE WHEN strpos(n, '{low}') = 0 THEN 999 ELSE strpos(n, '{low}') - 1 END AS position FROM u)
SELECT ticker, name, bucket, position, coalesce(liquidity, 0) + 0.0 AS liquidity FROM b LEFT JOIN lq USING (ticker) WHERE bucket IS NOT NULL
ORDER BY bucket, coalesce(liquidity, 0) DESC, position, length(n), ticker LIMIT {limit}"""


def _search(q, limit):
    def run(spark, sf):
        return S.search(search_universe(spark, sf), q, limit, liquidity=part_liquidity(spark, sf)).select(
            "ticker", "name", "bucket", "position", "liquidity")
    return run


for _name, _q, _n in (("search_word", "Ring", 50), ("search_ticker", "p12", 40), ("search_literal", "d#1", 30), ("search_part", "ol", 60)):
    _fn = _search(_q, _n)
    _fn.__name__ = _name
    query("Q10", search_sql(_q, _n))(_fn)


def _indexed(q, limit):
    def run(spark, sf):
        meta, path = search_universe(spark, sf), scratch_path(spark, "search-index")
        S.write_search_index(meta, path)
        return S.search_indexed(meta, spark.read.parquet(path), q, limit, liquidity=part_liquidity(spark, sf)).select(
            "ticker", "name", "bucket", "position", "liquidity")
    return run


for _name, _q, _n in (("search_word", "Ring", 50), ("search_ticker", "p12", 40), ("search_literal", "d#1", 30), ("search_part", "ol", 60)):
    _fn = _indexed(_q, _n)
    _fn.__name__ = f"{_name}_indexed"
    query("Q10", search_sql(_q, _n))(_fn)


@query("Q11 J4", f"""{DAY} SELECT m.ticker, m.name, {r('d.score', 'score')}, d.score IS NOT NULL AS scored FROM meta m LEFT JOIN dy d ON d.ticker = m.ticker
WHERE contains(lower(m.name), 'bond') ORDER BY m.ticker""")
def search_with_scores(spark, sf):
    hits = B.metadata(spark, sf).filter(F.lower("name").contains("bond")).select("ticker", "name")
    return S.attach_scores(hits, day(spark, sf)).select("ticker", "name", "score", "scored")


@query("Q12", META + " UNION ALL ".join(
    f" SELECT '{f}' AS facet, coalesce({f}, 'Uncategorized') AS value, count(*) AS n FROM meta GROUP BY ALL" for f in S.FACETS))
def facet_counts(spark, sf):
    return S.facet_counts(B.metadata(spark, sf))


@query("Q13", f"{META} SELECT ticker, name, category FROM meta WHERE upper(ticker) = 'F000000004'")
def resolved_ticker(spark, sf):
    return S.resolve(B.metadata(spark, sf), "f000000004").select("ticker", "name", "category")


@query("Q14 W16", f"""{B.PANEL_SQL}, a AS (SELECT *, close * volume AS dv FROM panel), b AS (SELECT date, ticker, {B.roll('avg', 'dv', 20)} AS adv FROM a)
SELECT ticker, {r('arg_max(adv, date) / 1000', 'liquidity')} FROM b WHERE adv IS NOT NULL GROUP BY 1""")
def ticker_liquidity(spark, sf):
    return S.liquidity(Q.with_adv(B.panel(spark, sf)), "adv").select("ticker", (F.col("liquidity") / 1000).alias("liquidity"))


ARM_PRED = f"""{ARMS_SQL}, rec AS MATERIALIZED (SELECT arm, date, ticker, s AS score, fwd_ret, target, {TERC.format(p='(' + pr('s', 'arm, date') + ')')} AS pred FROM arms)"""
W = "CASE {0} WHEN 0 THEN 'underperform' WHEN 1 THEN 'neutral' WHEN 2 THEN 'outperform' END"
KNOWN = ["quiet", "momentum", "transfer"]


def records(spark, sf):
    a = arms(scored(spark, sf))
    a = X.pct_rank(a, ["arm", "date"], {"_p": "score"}, B.universe_rows(spark, sf))
    return a.withColumn("pred", X.tercile_of("_p")).select("arm", "date", "ticker", "score", "fwd_ret", "target", "pred")


@query("Q15", f"""{ARM_PRED} SELECT arm, max(date) AS latest_date, count(*) AS n, list_position({KNOWN}, arm) AS place FROM rec WHERE arm IN ('quiet', 'momentum', 'transfer') GROUP BY 1""")
def arm_list(spark, sf):
    return S.arm_list(records(spark, sf), KNOWN)


@query("Q15", f"""{ARM_PRED} SELECT ticker, coalesce(name, ticker) AS name, {rs('score')}, {W.format('pred')} AS prediction, {W.format('target')} AS realized_class, {rs('fwd_ret')}
FROM rec LEFT JOIN (SELECT ticker, name FROM meta WHERE NOT is_leveraged) USING (ticker) WHERE arm = 'reversal' AND date = (SELECT max(date) FROM rec WHERE arm = 'reversal')""")
def arm_day(spark, sf):
    names = B.metadata(spark, sf).filter(~F.col("is_leveraged"))
    return S.arm_day(records(spark, sf), "reversal", names)


@query("Q15", f"""{ARM_PRED} SELECT date, {rs('score')}, {W.format('pred')} AS prediction, {W.format('target')} AS realized_class, {rs('fwd_ret')}
FROM rec WHERE arm = 'quiet' AND ticker = 'F000000003' ORDER BY date DESC LIMIT 45""")
def arm_history(spark, sf):
    return S.arm_history(records(spark, sf), "quiet", "f000000003", 45)


UPCAT = "CASE WHEN ticker < 'F000000006' THEN 'Supplied' WHEN is_leveraged THEN 'Uncategorized' ELSE category END"


def upload(spark, sf):
    """The weekly bars as uploaded text, with a category for some tickers only."""
    text = B.ohlcv(spark, sf)
    own = F.when(F.col("ticker") < "F000000006", "Supplied")
    text = text.select(F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("ticker").alias("Symbol"),
                       *[F.col(c).cast("string").alias(c.title()) for c in ("high", "low", "close", "volume")], own.alias("Category"))
    return U.parse_upload(text)


def known_meta(spark, sf):
    return B.metadata(spark, sf).filter(~F.col("is_leveraged"))


@query("Q16 S5", f"{META} SELECT ticker, {UPCAT} AS category FROM meta")
def upload_categories(spark, sf):
    return S.upload_categories(upload(spark, sf), known_meta(spark, sf))


UP_FEATURES = ["rsi_14", "peer_rank_20d", "cat_ret_5d", "vol_20d", "ret_20d"]
UP_BASE = V3_BASE.replace("FROM panel)", f"FROM (SELECT p.* EXCLUDE (category), {UPCAT.replace('category END', 'm.category END').replace('ticker <', 'p.ticker <')} AS category FROM panel p JOIN meta m USING (ticker)))", 1)


@query("Q16 F1 F2 W16", f"""{staged(v3_stages('date, category'), UP_BASE, 'g')}
SELECT ticker, date, category, {rs(*UP_FEATURES)}, 0.0 AS news_n_1d FROM z QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""")
def upload_latest(spark, sf):
    up = upload(spark, sf)
    cats = S.upload_categories(up, known_meta(spark, sf))
    grid = P.densify(up.drop("category"), cats)
    n = B.universe_rows(spark, sf)
    feats = I.v3(grid, n).select("date", "ticker", *UP_FEATURES)
    levels = FM.support_resistance(grid).select("date", "ticker", "dist_res_20")
    both = feats.join(levels, ["date", "ticker"], "left").withColumn("news_n_1d", F.lit(0.0))
    last, _ = S.latest_with_features(both, [*UP_FEATURES, "dist_res_20"])
    return last.join(cats, "ticker").select("ticker", "date", "category", *UP_FEATURES, "news_n_1d")


@query("Q17", f"""{DAY}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM dy)
SELECT greatest(0, least(39, cast(ceil((score - lo) * 40 / (hi - lo)) AS bigint) - 1)) AS bin, count(*) AS n FROM dy, e GROUP BY 1""")
def score_histogram(spark, sf):
    return S.score_histogram(day(spark, sf))


@query("Q17", f"{DAY} SELECT category, {r('avg(score)', 'mean')}, count(*) AS count FROM dy GROUP BY 1 HAVING count(*) >= 3")
def mean_score_by_category(spark, sf):
    return S.mean_by_category(day(spark, sf))


@query("Q18", f"{SCORED_SQL} SELECT count(*) AS rows, max(date) AS latest_date, count(DISTINCT ticker) AS tickers, 2 AS models FROM sc")
def health_counts(spark, sf):
    return S.health(scored(spark, sf), ["linear", "forest"])
