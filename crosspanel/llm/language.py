"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are learned by the follow-the-regularised-leader rule with an elastic net (the L1 part keeps them sparse), and the scores are
calibrated by one temperature fitted on documents that the weights have not seen. Document frequencies count all training
documents; the weights learn from a sample of at most ``per_language`` documents of each language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.llm.common import col, string_texts

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: At most about so many documents of a language fit the weights (their features are gathered on the driver).
PER_LANGUAGE = 400
CHUNK_CHARS = 1 << 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of the hashed character n-grams of a whole lower-cased text."""
    total = np.zeros(BUCKETS, np.int64)
    longest = max(ORDERS)
    low = text.lower()
    for at in range(0, len(low), CHUNK_CHARS):
        # each chunk counts the n-grams that start in it
        c = np.frombuffer(low[at : at + CHUNK_CHARS + longest - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        starts = min(CHUNK_CHARS, len(low) - at)
        for n in ORDERS:
            m = min(starts, len(c) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h ^= c[k : k + m]
                h *= MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            total += np.bincount(h >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    live = np.flatnonzero(total)
    return live.astype(np.int32), total[live]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        bucket, n = counts(text)
        p = softmax((tf_idf(self.idf, bucket, n) @ self.weights[bucket] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def tf_idf(idf: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(n)) * idf[bucket]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and their number; tasks count, Spark adds up."""

    def run(batches):
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in string_texts(b.column(0)):
                seen[counts(text)[0]] += 1
                n += 1
        if n:
            live = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(live, BUCKETS).astype(np.int32)), pa.array(np.append(seen[live], n))], ["bucket", "n"])

    total = np.zeros(BUCKETS + 1, np.int64)
    for row in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        total[row.bucket] = row.n
    return total[:-1], int(total[-1])


def sample(rows: DataFrame, per_language: int) -> list:
    """Counts of a sample (id, lang, bucket, n): ``per_language`` rows of each language, or all it has if these are fewer.

    Rows are drawn by a hash of id, text and place in the table, so ids may be null or repeated; a first draw leaves about half
    as many again, of which those with the smallest hashes stay.
    """
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one number for each language
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_language / size))).otherwise(share)
    drawn = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("draw", F.xxhash64("id", "text", "place"))
    drawn = drawn.filter(F.pmod("draw", F.lit(2**53)) / F.lit(float(2**53)) < share)
    order = Window.partitionBy("lang").orderBy("draw", "place")
    chosen = drawn.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language)

    def run(batches):
        for b in batches:
            found = [counts(t) for t in string_texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array([x[0].astype("<i4").tobytes() for x in found], pa.binary()),
                                              pa.array([x[1].astype("<i4").tobytes() for x in found], pa.binary())], ["id", "lang", "bucket", "n"])

    return chosen.select("id", "lang", "text").mapInArrow(run, "id string, lang string, bucket binary, n binary").collect()


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int):
    """Follow the regularised leader, coordinate by coordinate; bucket BUCKETS is the bias and is not regularised."""
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))
    rng = np.random.default_rng(seed)

    def weights(i):
        zi, ni = z[i], n[i]
        free = (i == BUCKETS)[:, None]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(free, 0.0, l1), 0.0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + np.where(free, 0.0, l2))

    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            bucket, x, y = examples[k]
            i, x = np.append(bucket, BUCKETS), np.append(x, 1.0)
            w = weights(i)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    every = weights(np.arange(BUCKETS + 1))
    return every[:-1], every[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, from 1/16 to 16."""
    if len(y) == 0:
        return 1.0
    grid = 2.0 ** np.linspace(-4, 4, 161)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, epochs: int = 4,
        alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 5) -> Model:
    """Learn from the rows with a language and a text; every fifth sampled document calibrates. No such row gives a model that knows no language.

    Ids only order the sample: they may be null, repeated, or of any type.
    """
    rows = train.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    frequency, total = document_frequencies(rows.select("text"))
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0
    found = sorted(sample(rows, per_language), key=lambda r: (r.lang, r.id or "", r.bucket))
    languages = sorted({r.lang for r in found})
    place = {lang: k for k, lang in enumerate(languages)}
    examples = [(b := np.frombuffer(r.bucket, "<i4"), tf_idf(idf, b, np.frombuffer(r.n, "<i4")), place[r.lang]) for r in found if len(r.bucket)]
    if not examples:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    weights, bias = ftrl([e for k, e in enumerate(examples) if k % 5], len(languages), epochs, alpha, beta, l1, l2, seed)
    rest = [e for k, e in enumerate(examples) if k % 5 == 0]
    logits = np.array([x @ weights[b] + bias for b, x, _ in rest]).reshape(len(rest), len(languages))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias, calibrate(logits, np.array([y for *_, y in rest], np.int64)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred (a learned language; ``und`` for a null text, one without letters, or an empty model), score (0 to 1).

    Only the text counts, so repeated rows agree, an empty table gives an empty result, and other columns are not read. Ties go to the
    language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in string_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema.names)

    return docs.select(col(id_col), col(text_col)).mapInArrow(run, schema)
