"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with feature values x is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

where the sum-of-squares identity gives all pairwise interactions in time linear in the features.

The fit reads a bounded sample of the labelled rows (``max_labelled``); scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.llm.common import col, fresh, raw_texts

#: Buckets of hashed words; the statistics follow them in the weight vector.
WORD_BUCKETS = 1 << 14
RANK = 6
#: At most about so many labelled documents fit the model (their features are gathered on the driver).
MAX_LABELLED = 8_000
#: A document is kept if its score reaches this.
KEEP_SCORE = 0.3

PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
N_STATS = len(PUNCTUATION) + 10


def statistics(data: bytes, words: list[bytes], hashes: np.ndarray, counts: np.ndarray, n_chars: int | None) -> np.ndarray:
    """Structure of a text and its length as recorded, all scaled to about 0..1."""
    out = np.zeros(N_STATS, np.float32)
    if not data:
        out[-1] = 1.0
        return out
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, n_words = len(data), max(1, len(words))
    k = len(PUNCTUATION)
    out[:k] = np.sqrt(histogram[PUNCTUATION] / n_words)
    letters = max(1, int(histogram[65:91].sum() + histogram[97:123].sum() + histogram[128:].sum()))
    out[k] = histogram[65:91].sum() / letters
    out[k + 1] = histogram[48:58].sum() / n
    out[k + 2] = np.sqrt(histogram[10] / n_words)
    out[k + 3] = len(counts) / n_words
    out[k + 4] = counts.max() / n_words if len(counts) else 0.0
    out[k + 5] = min(n / n_words, 40.0) / 20.0
    out[k + 6] = np.log1p(n) / 12.0
    lines = [x for x in data.split(b"\n") if x]
    out[k + 7] = 1.0 - len(set(lines)) / len(lines) if lines else 0.0
    out[k + 8] = np.log1p(n_chars if n_chars is not None and n_chars > 0 else 0) / 12.0
    return out


def features(data: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): words by bucket with damped counts of unit length, then the statistics."""
    words = data.split()
    hashes, counts = np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), return_counts=True)
    stats = statistics(data, words, hashes, counts, n_chars)
    values = np.log1p(counts).astype(np.float32)
    norm = float(np.sqrt((values * values).sum()))
    if norm:
        values /= norm
    live = np.flatnonzero(stats)
    return (np.concatenate([(hashes % WORD_BUCKETS).astype(np.int32), (WORD_BUCKETS + live).astype(np.int32)]),
            np.concatenate([values, stats[live]]))


@dataclass(frozen=True)
class Model:
    """Weights; ``bias`` alone where nothing could be learned."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - (v * v).sum()))

    def score(self, data: bytes, n_chars: int | None) -> float:
        z = self.raw(*features(data, n_chars))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _chars_column(docs: DataFrame, chars_col: str | None):
    return col(chars_col).cast("long") if chars_col and chars_col in docs.columns else F.lit(None).cast("long")


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, chars_col: str | None, label_col: str,
                      max_labelled: int) -> list:
    """Features of a sample of labelled documents, chosen by a hash of the id: ``max_labelled`` at most.

    Of several labels of an id the greatest counts, and of several texts the one with the smallest hash.
    """
    usable = labels.filter(col(label_col).isin(0, 1) & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(
        F.max(col(label_col)).cast("int").alias("y"))
    n = usable.count()
    if n > max_labelled:
        draw = F.xxhash64("id")
        near = usable.filter(F.pmod(draw, F.lit(2**53)) / F.lit(float(2**53)) < F.lit(1.5 * max_labelled / n))
        usable = near.orderBy(draw, "id").limit(max_labelled)
    # the sample is bounded by max_labelled rows of two values
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), _chars_column(docs, chars_col).alias("chars"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "chars")).alias("d")
    sample = texts.join(F.broadcast(usable), "id").groupBy("id", "y").agg(one).select("id", "y", "d.text", "d.chars")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            index, value = [], []
            for data, chars in zip(raw_texts(b.column(2)), b.column(3).to_pylist()):
                f = features(data, chars)
                index.append(f[0].astype("<i4").tobytes())
                value.append(f[1].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                                             ["id", "y", "idx", "val"])

    return sample.mapInArrow(run, f"id {kind}, y int, idx binary, val binary").collect()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
        label_col: str = "quality", max_labelled: int = MAX_LABELLED, visits: int = 48_000, seed: int = 7) -> Model:
    """Learn from labels 0 and 1 by AdaGrad on small batches, in about ``visits`` visits of an example; other labels and null ids are ignored.

    No labelled document at all gives the score 0.5 everywhere, a single class its smoothed share.
    """
    rows = sorted(labelled_features(docs, labels, id_col, text_col, chars_col, label_col, max_labelled), key=lambda r: (r.id, r.idx, r.val))
    dim = WORD_BUCKETS + N_STATS
    rng = np.random.default_rng(seed)
    w, v = np.zeros(dim, np.float64), rng.normal(0, 0.02, (dim, RANK))
    y = np.array([r.y for r in rows], np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(share / (1 - share)))
    if len(rows) == 0 or y.min() == y.max():
        return Model(bias, w.astype(np.float32), np.zeros((dim, RANK), np.float32))
    index = [np.frombuffer(r.idx, "<i4") for r in rows]
    value = [np.frombuffer(r.val, "<f4").astype(np.float64) for r in rows]
    gw, gv, gb = np.full(dim, 1e-6), np.full((dim, RANK), 1e-6), 1e-6
    rate, decay, size = 0.1, 1e-5, 64
    for _ in range(max(1, visits // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            part = order[at : at + size]
            i, x = np.concatenate([index[p] for p in part]), np.concatenate([value[p] for p in part])
            lengths = np.array([len(index[p]) for p in part])
            row = np.repeat(np.arange(len(part)), lengths)
            start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = v[i] * x[:, None]
            total = np.add.reduceat(vx, start, axis=0)
            z = bias + np.add.reduceat(w[i] * x, start) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            used, inverse = np.unique(i, return_inverse=True)
            e = error[row] * x
            dw = np.bincount(inverse, e, len(used)) + decay * w[used]
            dv = np.stack([np.bincount(inverse, e * (total[row, f] - vx[:, f]), len(used)) for f in range(RANK)], 1) + decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            db = error.sum()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
    return Model(float(bias), w.astype(np.float32), v.astype(np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
          keep_score: float = KEEP_SCORE) -> DataFrame:
    """One row per document: ``id_col``, score (0 to 1, higher is better), predicted (1 if score >= keep_score).

    A null text counts as an empty one, which has its own feature; a null length as 0. Rows are scored one by one, so repeated
    rows get the same score, an empty table gives an empty result, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(col(id_col), col(text_col), _chars_column(docs, chars_col))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        m = shared.value
        for b in batches:
            s = np.array([m.score(data, n) for data, n in zip(raw_texts(b.column(1)), b.column(2).to_pylist())], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= keep_score).astype(np.int32))], [id_col, "score", "predicted"])

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", chars_col: str | None = "n_chars", keep_score: float = KEEP_SCORE) -> DataFrame:
    """The documents whose score reaches ``keep_score``, with all their columns, whatever these are called."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chars, text = fresh(docs, "chars"), docs.columns.index(text_col)
    n = len(docs.columns)
    source = docs.withColumn(chars, _chars_column(docs, chars_col))

    def run(batches):
        m = shared.value
        for b in batches:
            kept = [m.score(data, c) >= keep_score for data, c in zip(raw_texts(b.column(text)), b.column(n).to_pylist())]
            yield b.select(range(n)).filter(pa.array(kept, pa.bool_()))

    return source.mapInArrow(run, docs.schema)
