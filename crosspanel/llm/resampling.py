"""Importance resampling towards a target distribution: documents drawn in proportion to target over corpus likelihood.

Features are hashed runs of words. The gain of a bucket is the log ratio of its smoothed shares in the target and in the corpus,
in thousandths; a document's weight is the mean gain over its features, read from an array with one number for each bucket. A Gumbel
term from a hash of the id turns the weights into a draw without replacement: the highest scores win.

The winners are found by a distributed quickselect. Each round takes a few random keys as pivots, counts exactly what lies before,
at and between them, and goes on in the interval that holds the k-th key. Only the winners are sorted, by range, and ranked.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import col, raw_texts, stored
from crosspanel.llm.ranges import numbered

BUCKETS = 10_000
MAX_RUN = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Keys compared with every candidate in one round of the selection.
PIVOTS = 31

# bytes of UTF-8 texts in lower case: digits, letters a to z, and everything beyond ASCII
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(data: bytes) -> list[bytes]:
    """Words of a text; only A to Z become lower case."""
    return WORD.findall(data.lower())


def buckets_of(words: list[bytes], max_run: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``max_run`` words, repeats included."""
    found = []
    for n in range(1, max_run + 1):
        runs = words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        found.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)))
    return np.concatenate(found) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; each task sends at most one number for each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for data in raw_texts(b.column(0)):
                total += np.bincount(buckets_of(words_of(data), max_run, buckets), minlength=buckets)
        live = np.flatnonzero(total)
        if len(live):
            yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    # one row for each bucket at most
    for r in texts.select(col(text_col)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


@dataclass(frozen=True)
class Gains:
    """Gain of each bucket, in thousandths of a unit of log likelihood."""

    gain: np.ndarray
    max_run: int

    @property
    def buckets(self) -> int:
        return len(self.gain)


def fit(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS) -> Gains:
    """Gains from all rows of both tables; null texts have no words, and two empty tables give gains of 0."""
    s, t = bucket_counts(docs, text_col, max_run, buckets), bucket_counts(target, target_text_col, max_run, buckets)
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    gain = [math.floor(1000.0 * math.log(((b + 1.0) * whole_s) / ((a + 1.0) * whole_t))) for a, b in zip(s.tolist(), t.tolist())]
    return Gains(np.array(gain, np.int64), max_run)


def score(docs: DataFrame, gains: Gains, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row for each document: id, n_words, n_features, weight, score and a row number of its own.

    The weight of a text without features is 0. A null id draws with the empty string as its id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number for each bucket
    source = docs.select(F.monotonically_increasing_id().alias("row"), col(text_col).alias("text"), col(id_col).alias("id"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        g = shared.value
        for b in batches:
            n_words, n_features, weight = [], [], []
            for data in raw_texts(b.column(1)):
                words = words_of(data)
                at = buckets_of(words, g.max_run, g.buckets)
                n_words.append(len(words))
                n_features.append(len(at))
                weight.append(int(g.gain[at].sum()) // len(at) if len(at) else 0)
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *numbers], ["row", "id", "n_words", "n_features", "weight"])

    rows = source.mapInArrow(run, f"row long, id {kind}, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + draw.cast("long"))


#: The order of the draw: higher scores first, then smaller ids (null last), then rows as they lie in the table.
KEY = "struct(-score AS down, id IS NULL AS unnamed, id, row)"


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED):
    """The k-th smallest ``key`` (k from 1 to the number of rows); keys must differ.

    Every round reads the candidates once. About ``pivots`` keys reach the driver, and a count for each interval between them.
    """
    kind = rows.schema["key"].dataType
    low = high = None
    turn = 0
    while True:
        inside = rows
        if low is not None:
            inside = inside.filter(F.col("key") > low)
        if high is not None:
            inside = inside.filter(F.col("key") < high)
        chosen = inside.select("key").orderBy(F.xxhash64(F.lit(seed + turn), "key.row")).limit(pivots).orderBy("key").collect()
        keys = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r.key, kind.fields)]) for r in chosen]
        # 2 i: between pivots i - 1 and i; 2 i + 1: at pivot i
        cell = sum((F.when(F.col("key") > p, 2).when(F.col("key").eqNullSafe(p), 1).otherwise(0) for p in keys), F.lit(0))
        counts = {r.cell: r["n"] for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
        for at in range(2 * len(keys) + 1):
            n = counts.get(at, 0)
            if k <= n:
                break
            k -= n
        if at % 2:
            return keys[at // 2]
        low, high = (keys[at // 2 - 1] if at else low), (keys[at // 2] if at // 2 < len(keys) else high)
        turn += 1


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, pivots: int = PIVOTS) -> DataFrame:
    """The scored rows with ``rank``: 1, 2, 3, ... for the drawn ones, null for the others.

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100) are drawn. Rows that agree in score and id are
    drawn in the order of the table; they are alike in every column but ``row`` where their texts agree.
    """
    rows = stored(scored.withColumn("key", F.expr(KEY)), "scores")
    able = F.col("n_words") >= min_words
    k = rows.filter(able).count() * percent // 100
    if not k:
        return rows.drop("key").withColumn("rank", F.lit(None).cast("long"))
    last = kth_key(rows.filter(able).select("key"), k, pivots)
    won = able & (F.col("key") <= last)
    winners = numbered(rows.filter(won), [F.col("key")], "rank")
    return winners.unionByName(rows.filter(~won).withColumn("rank", F.lit(None).cast("long"))).drop("key")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS, max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row for each document (id, n_words, n_features, weight, score, row, rank); repeated rows are documents of their own.

    Other columns are not read. An empty table gives an empty result, an empty target gains against nothing but the smoothing.
    """
    return draw(score(docs, fit(docs, target, text_col, target_text_col, max_run, buckets), id_col, text_col, seed), percent, min_words)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
b AS (SELECT {_WORDS_SQL} AS words FROM benchmark),
dw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM d) GROUP BY word),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY word),
known AS (SELECT word FROM dw UNION SELECT word FROM bw),
bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT) AS bytes FROM known),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x:
    list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % {BUCKETS} AS bucket FROM bytes),
s AS (SELECT bucket, sum(n)::DOUBLE AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
whole AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS} AS s, (SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS} AS t),
gain AS (SELECT word, floor(1000.0::DOUBLE * ln((coalesce(t.n, 0) + 1) * whole.s / ((coalesce(s.n, 0) + 1) * whole.t)))::BIGINT AS gain
         FROM hashed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket) CROSS JOIN whole),
weighed AS (SELECT i, floor(sum(gain) / count(*))::BIGINT AS weight FROM (SELECT i, unnest(words) AS word FROM (SELECT row_number() OVER () AS i, words FROM d)) JOIN gain USING (word) GROUP BY i),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM (SELECT row_number() OVER () AS i, * FROM d) LEFT JOIN weighed USING (i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND place <= able * {PERCENT} // 100 THEN place END AS rank FROM ranked
"""
