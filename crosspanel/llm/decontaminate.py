"""Benchmark decontamination: an FM-index over the words of every training shard.

Every task indexes its documents shard by shard. Words outside the benchmark's vocabulary end a run; runs shorter than the shortest
test phrase cannot hold one and are not indexed. The index of a shard is the Burrows-Wheeler transform of its
runs in a wavelet matrix, with every ``SAMPLE``-th suffix position. Test phrases are searched backwards, all at once; each
row found is walked to a sampled position; the spans are merged per document.

Memory of a task is bounded by ``SHARD_WORDS`` plus one document. The benchmark is sent to the tasks in blocks of at most
``BLOCK_WORDS`` words, each block in one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.llm.common import col, raw_texts, stored

WINDOW = 13
#: Indexed words of one shard, words of one benchmark block, distance of sampled suffix positions.
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 500_000
SAMPLE = 8
#: Contaminated from this share of hit words on, as 1 / SHARE.
SHARE = 20

#: ASCII letters in lower case, digits and all bytes beyond ASCII are word bytes; the others become blanks.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


# -- the index of one shard --------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling: positions in the order of their suffixes."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


@dataclass
class WaveletMatrix:
    """Rank of any symbol before any place, one bit plane per binary digit."""

    levels: list[np.ndarray] = field(default_factory=list)
    zeros: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, symbols: np.ndarray) -> WaveletMatrix:
        out = cls()
        for bit in reversed(range(max(1, int(symbols.max()).bit_length()))):
            ones = (symbols >> bit) & 1
            out.levels.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
            out.zeros.append(int(len(symbols) - ones.sum()))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        return out

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros(len(place), np.int64), place.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (len(self.levels) - 1 - k)) & 1
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            high = np.where(bit == 1, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros(len(place), np.int64), place.astype(np.int64)
        for ones, zeros in zip(self.levels, self.zeros):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Backward search over a text of positive symbols; 0 is its end."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        full = np.concatenate([text, [0]])
        order = suffix_array(full)
        bwt = full[order - 1]
        self.tree = WaveletMatrix.of(bwt)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(full))])
        sampled = (order % sample == 0)
        self.sampled = sampled
        self.place = np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of all phrases, one phrase per matrix row, padded at the end."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sampled), np.int64)
        for back in range(phrases.shape[1]):
            live = np.flatnonzero((back < lengths) & (low < high))
            if len(live) == 0:
                break
            symbol = phrases[live, lengths[live] - 1 - back]
            known = symbol < len(self.first) - 1
            start = self.first[np.where(known, symbol, 0)]
            symbol = np.where(known, symbol, 0)
            low[live] = np.where(known, start + self.tree.rank(symbol, low[live]), 0)
            high[live] = np.where(known, start + self.tree.rank(symbol, high[live]), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back through the text until a sampled row."""
        at, steps, out = rows.copy(), 0, np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            done = self.sampled[here]
            out[open_[done]] = self.positions[self.place[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            if len(open_):
                symbol = self.tree.access(here)
                at[open_] = self.first[symbol] + self.tree.rank(symbol, here)
            steps += 1
        return out


# -- the benchmark -----------------------------------------------------------------------------


@dataclass
class Phrases:
    """The distinct windows of a block of items, as symbols of its vocabulary (from 2 on; 1 ends a run)."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    owners: list[list]  # ids of the items that have the window

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def phrases(items: list[tuple[object, list[bytes]]], window: int) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set] = {}
    for item, tokens in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in tokens]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            owners = found.setdefault(tuple(ids[at : at + window]), set())
            if item is not None:
                owners.add(item)
    keys = list(found)
    matrix = np.zeros((len(keys), window), np.int64)
    for k, key in enumerate(keys):
        matrix[k, : len(key)] = key
    return Phrases(vocabulary, matrix, np.array([len(k) for k in keys], np.int64), [sorted(found[k]) for k in keys])


def benchmark_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded size; the driver holds one block at a time."""
    held, size = [], 0
    for row in items.filter(col(text_col).isNotNull()).select(col(id_col).cast("string"), col(text_col)).toLocalIterator():
        tokens = words(row[1].encode())
        held.append((row[0], tokens))
        size += len(tokens)
        if size >= block_words:
            yield phrases(held, window)
            held, size = [], 0
    yield phrases(held, window)


# -- documents ---------------------------------------------------------------------------------


def shard_hits(symbols: list[np.ndarray], known: Phrases) -> list[tuple[np.ndarray, set]]:
    """For each document of a shard, given as symbols with 0 for unknown words: hit flags and ids of the items found."""
    out = [(np.zeros(len(s), bool), set()) for s in symbols]
    if known.shortest == 0:
        return out
    every = np.concatenate([np.append(s, 0) for s in symbols]) if symbols else np.zeros(0, np.int64)
    document = np.repeat(np.arange(len(symbols)), [len(s) + 1 for s in symbols])
    # runs of known words that are long enough, each followed by the symbol 1
    inside = every > 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= known.shortest
    start, end = start[long], end[long]
    if len(start) == 0:
        return out
    size = end - start + 1
    source = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    index = FMIndex(np.where(inside[source], every[source], 1))
    low, high = index.search(known.windows, known.lengths)
    hits = np.flatnonzero(high > low)
    if len(hits) == 0:
        return out
    count = (high - low)[hits]
    which = np.repeat(hits, count)
    rows = np.repeat(low[hits] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    at = source[index.locate(rows)]
    # spans of all occurrences, merged by counting openings and closings
    cover = np.zeros(len(every) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + known.lengths[which], -1)
    covered = np.cumsum(cover[:-1]) > 0
    begins = np.concatenate([[0], np.cumsum([len(s) + 1 for s in symbols])])
    for d in np.unique(document[at]):
        out[d][0][:] = covered[begins[d] : begins[d + 1] - 1]
    for d, w in set(zip(document[at].tolist(), which.tolist())):
        out[d][1].update(known.owners[w])
    return out


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of hit words as [first, last + 1)."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))]


def _searched(batches, text_at: int, known: Phrases, build):
    """Batches with what was found in them; a batch is cut into shards of bounded size."""
    get = known.vocabulary.get
    for b in batches:
        shard, size, first = [], 0, 0
        for k, data in enumerate(raw_texts(b.column(text_at))):
            tokens = words(data)
            shard.append(np.fromiter((get(w, 0) for w in tokens), np.int64, len(tokens)))
            size += len(tokens) + 1
            if size >= SHARD_WORDS:
                yield build(b.slice(first, k + 1 - first), shard, shard_hits(shard, known))
                shard, size, first = [], 0, k + 1
        if shard:
            yield build(b.slice(first), shard, shard_hits(shard, known))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, n_words, hit_spans (word numbers [first, end), merged) and items (ids as sorted strings).

    A null text has no words; items without words, and a benchmark without rows, hit nothing. An item without an id marks words but
    names no item; items with one id are one item. Rows that agree in id and text share their result where a benchmark takes several blocks.
    """
    key = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("key"), col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    schema = T.StructType([key.schema["id"], key.schema["key"], *RESULT])

    def build(batch, shard, hits):
        found = [spans(h[0]) for h in hits]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in shard], pa.int64()),
                                           pa.array([[list(x) for x in f] for f in found], pa.list_(pa.list_(pa.int64()))),
                                           pa.array([sorted(h[1]) for h in hits], pa.list_(pa.string()))], schema.names)

    def one(known):
        shared = context.broadcast(known)
        return key.mapInArrow(lambda batches: _searched(batches, 2, shared.value, build), schema)

    parts = [one(known) for known in benchmark_blocks(benchmark, item_id_col, item_text_col, window, block_words)]
    if len(parts) == 1:
        return parts[0].drop("key")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    blocks = len(parts)
    merged = both.groupBy("id", "key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("s"),
                                           F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                           (F.count(F.lit(1)) / blocks).cast("int").alias("copies"))
    joined = F.aggregate(F.array_sort("s"), F.array().cast("array<array<bigint>>"), lambda done, x: F.when(
        F.size(done) == 0, F.array(x)).when(F.element_at(F.element_at(done, -1), 2) >= x[0], F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], x[1])))))
        .otherwise(F.concat(done, F.array(x))))
    return merged.withColumn("hit_spans", joined).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("id", "n_words", "hit_spans", "items")


def verdicts(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated beside what ``find`` gives."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    rows = found.withColumn("n_hit", n_hit)
    return rows.select("id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
               window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    With several benchmark blocks the hits of all blocks are gathered per row first, in passes that carry them in a column and are written.
    """
    context = docs.sparkSession.sparkContext
    text, n = docs.columns.index(text_col), len(docs.columns)
    state = "_".join(["hits", *docs.columns])  # longer than any column: cannot clash
    rows = docs.withColumn(state, F.lit(None).cast("binary"))
    blocks = benchmark_blocks(benchmark, item_id_col, item_text_col, window, block_words)
    known, following = next(blocks), None
    while known is not None:
        following = next(blocks, None)
        shared, last = context.broadcast(known), following is None

        def run(batches, shared=shared, last=last):
            def build(batch, shard, hits):
                before = batch.column(n).to_pylist()
                flags = [h[0] if x is None else h[0] | np.unpackbits(np.frombuffer(x, np.uint8), count=len(h[0])).astype(bool) for h, x in zip(hits, before)]
                if last:
                    clean = [not (f.any() and SHARE * int(f.sum()) >= len(f)) for f in flags]
                    return batch.filter(pa.array(clean, pa.bool_()))
                packed = pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())
                return pa.RecordBatch.from_arrays([*batch.columns[:n], packed], batch.schema.names)

            return _searched(batches, text, shared.value, build)

        rows = rows.mapInArrow(run, rows.schema)
        if not last:  # so that tasks hold one block at a time
            rows = stored(rows, "hits")
            shared.unpersist()
        known = following
    return rows.drop(state)
