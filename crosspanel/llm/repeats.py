"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Equal strings contain equal anchors: of all ``GRAM``-byte grams in a window of ``LENGTH`` bytes, the one with the smallest hash. So only the
suffixes that start at an anchor whose gram occurs more than once need to be sorted. They are dealt by gram; each task holds
whole groups of them, up to LENGTH bytes to the right and what a window can hold to the left, and

* sorts them (an enhanced suffix array: order and common prefixes of neighbours),
* scans the common prefixes with a stack for the intervals of the common-prefix tree,
* in every interval sorts the members by what stands to their left; a run that has LENGTH bytes in common in both directions is a
  repeat group, and where its members' left extensions part it is a maximal one. All its members are occurrences.

Equal texts are one text with a count, equal contexts one suffix with a count. A gram with more than ``BLOCK`` different contexts is not
gathered anywhere: its windows are counted one by one, by digest, with map-side aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.llm.common import col, raw_texts, stored

LENGTH = 400
GRAM = 64
#: Different contexts of one gram that one task sorts; and the contexts it holds at a time.
BLOCK = 5_000
HELD = 16_000
MIX = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Grams of a period up to this are no anchors; half a gram.
PERIOD = 32


# -- anchors -----------------------------------------------------------------------------------


def gram_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 64 bytes from every place on, built from 8 and 16 bytes."""
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)
    h = np.ascontiguousarray(words).view("<u8").ravel().astype(np.uint64) * MIX
    h ^= h >> np.uint64(32)
    h *= MIX
    for half in (8, 16, 32):
        shorter = h
        h = h[:-half] * np.uint64(0x100000001B3) + h[half:]
        h ^= h >> np.uint64(29)
        h *= MIX
    return shorter, h


def smallest_period(gram: bytes) -> int:
    """The smallest period up to PERIOD of a gram, or 0."""
    p = gram.find(gram[:PERIOD], 1)
    while 0 < p <= PERIOD:
        if gram[p:] == gram[:-p]:
            return p
        p = gram.find(gram[:PERIOD], p + 1)
    return 0


def _periodic(half: np.ndarray, n: int) -> np.ndarray:
    """Which of the n grams have a period up to PERIOD; two equal halves at a distance cover what must be equal."""
    out = np.zeros(n, bool)
    for p in range(1, PERIOD + 1):
        same = half[p:] == half[:-p]
        out |= same[:n] & same[PERIOD - p : PERIOD - p + n]
    return out


def _sliding(values: np.ndarray, width: int, best, worst) -> np.ndarray:
    """Minimum or maximum of every window, from running ones of blocks in both directions."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, worst, values.dtype)]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def _smallest_of_windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of every window, and the places that are the smallest of some window, ties included."""
    low = _sliding(h, width, np.minimum, TOP)
    # a gram is the smallest of a window if the largest of the minima around it equals it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return low, np.flatnonzero((_sliding(padded, width, np.maximum, np.uint64(0)) == h) & (h != TOP))


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, int, int, int]]]:
    """(places, hashes, periodic windows) of a text.

    The anchor of a window is the smallest of its grams that have no short period; so even in repetitive text few grams of a window
    tie. A window without such a gram has a short period itself: such windows are told by their digest, (digest, start of the
    first, end of the last, how many) for each phase of a run.
    """
    if len(data) < length:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), []
    half, h = gram_hashes(data)
    h = np.minimum(h, TOP - np.uint64(1))
    width = length - GRAM + 1
    low, place = _smallest_of_windows(h, width)
    windows = []
    if any(smallest_period(data[p : p + GRAM]) for p in place.tolist()):
        h[_periodic(half, len(h))] = TOP
        low, place = _smallest_of_windows(h, width)
        edge = np.diff(np.concatenate([[0], (low == TOP).view(np.int8), [0]]))
        for first, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            period = smallest_period(data[first : first + GRAM])
            for start in range(first, min(first + period, end)):
                n = (end - 1 - start) // period + 1
                windows.append((xxhash.xxh3_128_digest(data[start : start + length]), start, start + (n - 1) * period + length, n))
    return place.astype(np.int32), h[place].view(np.int64), windows


def prepared(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(id, digest, n_bytes, sha256, places, grams, windows) of every document, without its text."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("digest", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("sha256", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("grams", T.ArrayType(T.LongType())),
                           T.StructField("windows", T.ArrayType(T.StructType([T.StructField("window", T.BinaryType()), T.StructField("start", T.IntegerType()),
                                                                              T.StructField("end", T.IntegerType()), T.StructField("n", T.LongType())])))])
    window_type = pa.list_(pa.struct([("window", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("n", pa.int64())]))

    def run(batches):
        for b in batches:
            rows = [(hashlib.md5(t).digest(), len(t), hashlib.sha256(t).hexdigest(), *anchors(t, length)) for t in raw_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()),
                                              pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.list_(pa.int64())),
                                              pa.array([[dict(zip(("window", "start", "end", "n"), w)) for w in r[5]] for r in rows], window_type)], schema.names)

    return docs.select(col(id_col), col(text_col)).mapInArrow(run, schema)


def _contexts(data: bytes, place: int, length: int) -> tuple[bytes, bytes]:
    return data[max(0, place - (length - GRAM)) : place], data[place : place + length]


def _context_digest(gram: int, left: bytes, right: bytes) -> bytes:
    return xxhash.xxh3_128_digest(len(left).to_bytes(4, "little") + left + right, seed=gram & 0xFFFFFFFF)


# -- one group of suffixes ---------------------------------------------------------------------


def _order(group: np.ndarray, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and bytes, and the common prefix of each with the one before it; -1 where the group changes."""
    m = len(rows)
    size = np.fromiter(map(len, rows), np.int64, m)
    matrix = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(m, width)
    key = np.concatenate([group.astype(">u4").view(np.uint8).reshape(m, 4), matrix, size.astype(">u2").view(np.uint8).reshape(m, 2), np.ones((m, 1), np.uint8)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{width + 7}").ravel(), kind="stable")
    a, b = order[1:], order[:-1]
    same = matrix[a] == matrix[b]
    prefix = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    prefix = np.minimum(prefix, np.minimum(size[a], size[b]))
    prefix[group[a] != group[b]] = -1
    return order, np.concatenate([[-1], prefix])


class _RangeMinimum:
    def __init__(self, values: np.ndarray):
        self.levels = [values.astype(np.int16)]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of values[low + 1 .. high] with low < high."""
        span = high - low
        level = np.frexp(span.astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            values = self.levels[k]
            out[at] = np.minimum(values[low[at] + 1], values[high[at] - (1 << int(k)) + 1])
        return out


def intervals(prefix: np.ndarray, least: int):
    """Stack scan: (common prefix, first, last) of every interval of the common-prefix tree with at least ``least`` in common."""
    stack: list[tuple[int, int]] = []  # (common prefix, first)
    for i, value in enumerate([*prefix[1:].tolist(), -1], start=1):
        first = i - 1
        while stack and stack[-1][0] > value:
            common, first = stack.pop()
            if common >= least:
                yield common, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(group: np.ndarray, left: list[bytes], right: list[bytes], length: int):
    """Maximal repeat groups of at least ``length`` bytes: (left extension, right extension, members, common left of neighbours).

    ``left`` and ``right`` are the bytes before and from an anchor on; members are row numbers, ordered by what stands to their left.
    The right extension is that of an interval, so members part behind it; the left one is the least of the neighbours', so
    they part before it.
    """
    order, prefix = _order(group, right, length)
    by_left, common_left = _order(group, [x[::-1] for x in left], max(1, length - GRAM))
    rank = np.empty(len(order), np.int64)
    rank[by_left] = np.arange(len(by_left))
    lowest = _RangeMinimum(common_left)
    for common, first, last in intervals(prefix, 1):
        need = length - common
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        r = rank[members]
        beside = lowest(r[:-1], r[1:])
        enough = beside >= need
        if not enough.any():
            continue
        edge = np.diff(np.concatenate([[0], enough.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            yield int(beside[a:b].min()), int(common), members[a : b + 1], beside[a:b]


def extents(group: np.ndarray, left: list[bytes], right: list[bytes], count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and right of each anchor some repeat of ``length`` bytes reaches; 0 and 0 for none."""
    reach_left, reach_right = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    several = np.array([c > 1 and len(x) + len(y) >= length for c, x, y in zip(count, left, right)], bool)
    reach_left[several] = [len(left[k]) for k in np.flatnonzero(several)]
    reach_right[several] = [len(right[k]) for k in np.flatnonzero(several)]
    if len(left) > 1:
        for _, common, members, beside in maximal_repeats(group, left, right, length):
            best = np.maximum(np.append(beside, 0), np.insert(beside, 0, 0))
            reach_left[members] = np.maximum(reach_left[members], best)
            reach_right[members] = np.maximum(reach_right[members], common)
    return reach_left, reach_right


# -- the corpus --------------------------------------------------------------------------------


def _in_groups(batches, build):
    """Whole groups of sorted rows (gram, left, right, n), a bounded number of rows at a time."""
    gram, left, right, n = [], [], [], []
    for b in batches:
        gram += b.column(0).to_pylist()
        left += b.column(1).to_pylist()
        right += b.column(2).to_pylist()
        n += b.column(3).to_pylist()
        if len(gram) >= HELD:
            cut = len(gram) - 1
            while cut and gram[cut - 1] == gram[-1]:
                cut -= 1
            if cut:
                yield from build(gram[:cut], left[:cut], right[:cut], n[:cut])
                gram, left, right, n = gram[cut:], left[cut:], right[cut:], n[cut:]
    if gram:
        yield from build(gram, left, right, n)


EXTENT = "context binary, reach_left int, reach_right int"


def _extent_batch(gram, left, right, reach_left, reach_right):
    found = np.flatnonzero(reach_right)
    digest = [_context_digest(gram[k], left[k], right[k]) for k in found]
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(reach_left[found].astype(np.int32)), pa.array(reach_right[found].astype(np.int32))],
                                      ["context", "reach_left", "reach_right"])


def _sorted_extents(contexts: DataFrame, length: int) -> DataFrame:
    def build(gram, left, right, n):
        group = np.cumsum(np.concatenate([[0], np.diff(np.array(gram)) != 0]))
        yield _extent_batch(gram, left, right, *extents(group, left, right, np.array(n), length))

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda batches: _in_groups(batches, build), EXTENT)


def _counted_extents(contexts: DataFrame, length: int) -> DataFrame:
    """The same for crowded grams: every window around an anchor is counted by its digest."""

    def windows(batches):
        for b in batches:
            for gram, left, right, n in zip(*(c.to_pylist() for c in b.columns)):
                data, context = left + right, _context_digest(gram, left, right)
                starts = range(max(0, len(data) - length + 1))
                starts = [s for s in starts if s <= len(left)]
                if starts:
                    yield pa.RecordBatch.from_arrays([pa.array([context] * len(starts), pa.binary()), pa.array([len(left) - s for s in starts], pa.int32()),
                                                      pa.array([xxhash.xxh3_128_digest(data[s : s + length]) for s in starts], pa.binary()), pa.array([n] * len(starts), pa.int64())],
                                                     ["context", "before", "window", "n"])

    rows = stored(contexts.mapInArrow(windows, "context binary, before int, window binary, n long"), "windows")
    often = rows.groupBy("window", "before").agg(F.sum("n").alias("n")).filter("n > 1").select("window", "before")
    return rows.drop("n").join(often, ["window", "before"]).groupBy("context").agg(
        F.max("before").alias("reach_left"), (F.lit(length) - F.min("before")).alias("reach_right"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK):
    """(documents, texts, spans): documents without texts, one text for each digest that shares grams, and its spans [start, end).

    Documents whose whole text occurs again carry ``copies`` > 1 and need no spans: all of it is repeated, if it is long enough.
    """
    if length < GRAM + 1:
        raise ValueError(f"strings of fewer than {GRAM + 1} bytes hold no anchor")
    rows = stored(prepared(docs, id_col, text_col, length), "prepared")
    distinct = stored(rows.filter(F.col("n_bytes") >= length).groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.first("places").alias("places"), F.first("grams").alias("grams"), F.first("windows").alias("windows")), "distinct")
    every = distinct.select("digest", F.explode(F.arrays_zip("places", "grams")).alias("a")).select("digest", F.col("a.places").alias("place"), F.col("a.grams").alias("gram"))
    # written first, so that a join with a hot gram can be split
    often = stored(every.groupBy("gram").count().filter("count > 1").select("gram"), "often")
    # windows of a short period: all their occurrences are counted by digest
    periodic = distinct.select("digest", F.explode("windows").alias("w")).select("digest", "w.*")
    twice = periodic.groupBy("window").agg(F.sum("n").alias("n")).filter("n > 1").select("window")
    runs = stored(periodic.join(twice, "window").select("digest", F.col("start"), F.col("end")), "runs")
    known = every.join(often, "gram").select("digest", F.struct("place", "gram").alias("a"))
    marked = runs.select("digest", F.lit(None).cast(known.schema["a"].dataType).alias("a"))
    shared = known.unionByName(marked).groupBy("digest").agg(F.collect_list("a").alias("anchors"))
    source = docs.select(F.unhex(F.md5(F.coalesce(col(text_col), F.lit("")).cast("binary"))).alias("digest"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    texts = stored(source.join(shared, "digest").dropDuplicates(["digest"]), "texts")

    def occurrences(batches):
        for b in batches:
            for digest, data, found in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), b.column(2).to_pylist()):
                for at in range(0, len(found), 8_192):
                    part = found[at : at + 8_192]
                    names = [_context_digest(a["gram"], *_contexts(data, a["place"], length)) for a in part]
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(part), pa.binary()), pa.array([a["place"] for a in part], pa.int32()),
                                                      pa.array([a["gram"] for a in part], pa.int64()), pa.array(names, pa.binary())], ["digest", "place", "gram", "context"])

    def bodies(batches):
        for b in batches:
            for data, found in zip(raw_texts(b.column(1)), b.column(2).to_pylist()):
                # equal contexts of one text (as in a run of one character) are one row
                count: dict[tuple[int, bytes, bytes], int] = {}
                for a in found:
                    key = (a["gram"], *_contexts(data, a["place"], length))
                    count[key] = count.get(key, 0) + 1
                keys = list(count)
                for at in range(0, len(keys), 4_096):
                    part = keys[at : at + 4_096]
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.int64()), pa.array([k[1] for k in part], pa.binary()), pa.array([k[2] for k in part], pa.binary()),
                                                      pa.array([count[k] for k in part], pa.int64())], ["gram", "left", "right", "n"])

    places = stored(texts.mapInArrow(occurrences, "digest binary, place int, gram long, context binary"), "places")
    contexts = texts.mapInArrow(bodies, "gram long, left binary, right binary, n long").groupBy("gram", "left", "right").agg(F.sum("n").alias("n"))
    crowd = stored(places.select("gram", "context").distinct().groupBy("gram").count().filter(F.col("count") > block).select("gram"), "crowd")
    if crowd.limit(1).count():
        reach = _sorted_extents(contexts.join(crowd, "gram", "left_anti"), length).unionByName(_counted_extents(contexts.join(crowd, "gram", "left_semi"), length))
    else:
        reach = _sorted_extents(contexts, length)
    found = places.join(reach, "context").select("digest", (F.col("place") - F.col("reach_left")).alias("start"), (F.col("place") + F.col("reach_right")).alias("end"))
    spans = found.unionByName(runs).groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    documents = rows.drop("places", "grams", "windows").join(distinct.select("digest", "copies"), "digest", "left")
    return documents, texts.select("digest", "text"), spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK, with_kept: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and spans [start, end) with the kept bytes if ``with_kept``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, judged on the input; matches never cross
    documents. A null text is empty; texts shorter than ``length`` stay whole; rows that repeat are copies of each other, whatever their ids. The
    kept bytes of documents without repeats are null: they are the whole text.
    """
    documents, texts, spans = find_repeats(docs, id_col, text_col, length, block)

    def cut(batches):
        for b in batches:
            rows = []
            for digest, data, found in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), b.column(2).to_pylist()):
                runs = merged([(s["start"], s["end"]) for s in found])
                ends = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
                rows.append((digest, len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([[list(x) for x in r[2]] for r in rows], pa.list_(pa.list_(pa.int64()))), pa.array([r[3] for r in rows], pa.string()),
                                              pa.array([r[4] for r in rows], pa.binary())], ["digest", "removed", "runs", "kept_hash", "kept"])

    cuts = texts.join(spans, "digest").mapInArrow(cut, "digest binary, removed long, runs array<array<bigint>>, kept_hash string, kept binary")
    both = documents.join(cuts, "digest", "left")
    whole = F.coalesce(F.col("copies") > 1, F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    out = both.select(
        "id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce(F.size("runs"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_hash", "sha256")).alias("kept_sha256"),
        F.when(whole, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("runs", F.array().cast("array<array<bigint>>"))).alias("spans"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out if with_kept else out.drop("spans", "kept")
