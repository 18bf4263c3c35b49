"""SimHash near-duplicates by anchor-point covering.

A fingerprint is one or more words of 64 bits. Every 32-bit half of a word is a block, and in each block the anchors are the words of a
covering code: the [31, 26] Hamming code beside one free bit, whose covering radius is 1. A fingerprint is replicated to
every anchor within radius + threshold (1 + 1) of its block, at most 17 of 2^27, and is at home at the nearest one. If two
fingerprints agree in a block up to one bit, each one's home is therefore an anchor of the other. So comparing every
fingerprint at an anchor with those at home there finds all pairs that agree in some block up to one bit.

Fingerprints of one word that differ in at most 3 bits always do (3 bits over two halves): this search misses no link. Longer
fingerprints allow more differing bits; there a pair is found if one of its blocks agrees, more surely the longer they are.

``keep_one`` takes the links of the fingerprints of its five-word shingles as its first candidates; the sets of shingles decide. Sets with a Jaccard similarity
of 0.8 differ in about 15 of 100 bits, so a 32-bit block of two such fingerprints agrees up to one bit with probability 0.037, and 124 blocks
(2,108 replicas of each document) would be needed to find 99 % of them. Pairs that far apart are found by the bands of a MinHash sketch besides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.llm.common import col, components, forest, fresh, raw_texts, runs, stored, whole_ids

SHINGLE = 3
MAX_DISTANCE = 3
SEED = 42
#: Fingerprints at home at one anchor that are compared in one block; more are dealt over pairs of blocks.
BLOCK = 2_048
#: Words of a shingle, words of 64 bits, and differing bits allowed.
EXACT = (SHINGLE, 1, MAX_DISTANCE)
#: Near copies: words of a shingle, and the Jaccard similarity of the sets of shingles from which documents link.
NEAR_SHINGLE, NEAR = 5, 0.8
#: Candidates agree in one of BANDS bands of ROWS values, and in AGREE of all values: 0.9999 of the pairs at 0.8, more above.
BANDS, ROWS, AGREE = 20, 4, 46
#: Rows of a band that meet in one task, and the least rows of a part of a band for which its centre is sought.
NEAR_BLOCK, CENTRE_ROWS = 1_024, 4
#: Candidate pairs that a cell passes on, times its rows; a cell with more is verified whole, in place.
DENSE = 2
#: Shingles in more than so many documents of a cell are compared as columns of a matrix, others pair by pair.
COMMON, COLUMNS = 32, 4_096
FACTORS, TERMS = (np.random.default_rng(SEED + k).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1 - k) for k in (0, 1))

#: Bits of every byte value; the eight bytes of a hash are counted in one histogram.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BYTE_OFFSETS = (256 * np.arange(8)).astype(np.uint16)


def _word(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of a shingle from its first one."""
    if k == 0:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(words: list[bytes], shingle: int = SHINGLE, width: int = 1) -> bytes:
    """SimHash of a sequence of words as ``width`` big-endian numbers; no words give zeros, few of them one shingle."""
    n = len(words)
    if n == 0:
        return bytes(8 * width)
    ones, total, step = np.zeros((width, 64), np.int64), max(1, n - shingle + 1), 16_384
    for at in range(0, total, step):
        part = words[at : min(at + step, total) + shingle - 1]
        columns = [part[k : len(part) - shingle + 1 + k] for k in range(shingle)] if n >= shingle else [[w] for w in part]
        h = np.fromiter([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*columns))], np.uint64)
        for k in range(width):
            places = _word(h, k).astype("<u8").view(np.uint8).reshape(-1, 8) + BYTE_OFFSETS
            ones[k] += (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS).ravel()
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view("<u8").astype(">u8").tobytes()


def words(data: bytes) -> list[bytes]:
    """The ASCII-lower-cased words of a UTF-8 text between ASCII white space."""
    return data.lower().split()


def fingerprints(docs: DataFrame, measures=(EXACT,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp0, fp1, ...): a binary fingerprint for each measure; a null text has no words and gives zeros."""
    names = [f"fp{k}" for k in range(len(measures))]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, T.BinaryType()) for n in names)])

    def run(batches):
        for b in batches:
            split = [words(t) for t in raw_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([fingerprint(w, m[0], m[1]) for w in split], pa.binary()) for m in measures)], schema.names)

    return docs.select(col(id_col), col(text_col)).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Fingerprints of one length as a matrix of words."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), ">u8").astype(np.uint64).reshape(len(rows), -1)


def _packed(matrix: np.ndarray) -> pa.Array:
    size = 8 * matrix.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(matrix), [None, pa.py_buffer(matrix.astype(">u8").tobytes())]).cast(pa.binary())


# -- the covering code -----------------------------------------------------------------------


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Xor of the positions 1..31 of the set bits among the lowest 31."""
    s = np.zeros(len(v), np.uint32)
    for p in range(1, 32):
        s ^= ((v >> np.uint32(p - 1)) & np.uint32(1)) * np.uint32(p)
    return s


def _bit(p: np.ndarray) -> np.ndarray:
    """The bit at position p of 1..31, none at 0."""
    return np.where(p > 0, np.uint32(1) << (np.maximum(p, 1) - 1).astype(np.uint32), np.uint32(0)).astype(np.uint32)


def home(v: np.ndarray) -> np.ndarray:
    """The anchor nearest to each 32-bit half; bit 32 is free and belongs to the anchor."""
    return v ^ _bit(_syndrome(v))


def anchors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within distance 2 of each half: (row, anchor)."""
    s = _syndrome(v)
    rows, found = [np.arange(len(v)), np.arange(len(v))], [home(v), home(v) ^ np.uint32(1 << 31)]
    off = np.flatnonzero(s)
    for i in range(1, 32):
        k = s[off] ^ np.uint32(i)  # flipping positions i and k corrects the syndrome
        use = off[k > i]
        rows.append(use)
        found.append(v[use] ^ np.uint32(1 << (i - 1)) ^ _bit(k[k > i]))
    return np.concatenate(rows), np.concatenate(found)


def _blocks(fp: np.ndarray):
    """(number, 32-bit values) of each block of a matrix of words."""
    for word in range(fp.shape[1]):
        for half in (0, 1):
            yield 2 * word + half, (fp[:, word] >> np.uint64(32 * half)).astype(np.uint32)


def home_anchors(distinct: DataFrame) -> DataFrame:
    """(anchor): the homes of each fingerprint, one for each block."""

    def run(batches):
        for b in batches:
            for number, v in _blocks(_matrix(b.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(home(v).astype(np.int64) | (number << 32))], ["anchor"])

    return distinct.select("fp").mapInArrow(run, "anchor long")


def replicas(distinct: DataFrame) -> DataFrame:
    """(anchor, home, fp, rep) for each anchor of each (fp, rep); the anchor's upper bits tell the block."""

    def run(batches):
        for b in batches:
            fp, rep = _matrix(b.column(0)), b.column(1).to_numpy()
            for at in range(0, len(fp), 4_096):
                f, r = fp[at : at + 4_096], rep[at : at + 4_096]
                for number, v in _blocks(f):
                    row, anchor = anchors(v)
                    key = anchor.astype(np.int64) | (number << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(anchor == home(v)[row]), _packed(f[row]), pa.array(r[row])], ["anchor", "home", "fp", "rep"])

    return distinct.select("fp", "rep").mapInArrow(run, "anchor long, home boolean, fp binary, rep long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _block_links(hf, hr, of, orr, limit) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between homes and others, as few pairs that connect the same ids."""
    out = []
    for at in range(0, len(of), 512):
        f, r = of[at : at + 512], orr[at : at + 512]
        near = sum(np.bitwise_count(hf[:, None, k] ^ f[None, :, k]).astype(np.int16) for k in range(f.shape[1])) <= limit
        i, j = np.nonzero(near & (hr[:, None] != r[None, :]))
        if len(i) == 0:
            continue
        # every other is tied to its first home, every home to the previous home of the same other
        order = np.lexsort((i, j))
        i, j = i[order], j[order]
        first = np.concatenate([[True], j[1:] != j[:-1]])
        again = np.flatnonzero(~first)
        out.append(forest(np.concatenate([r[j[first]], hr[i[again]]]), np.concatenate([hr[i[first]], hr[i[again - 1]]])))
    return out


def _compared(batches, limit: int):
    """Links within sorted rows (anchor, block, home first): streams, holding only the homes of one anchor."""
    held_key, homes_f, homes_r = None, None, np.zeros(0, np.int64)
    for b in batches:
        key = np.stack([b.column(k).to_numpy() for k in (0, 1, 2)], 1)
        is_home = b.column(3).to_numpy(zero_copy_only=False)
        fp, rep = _matrix(b.column(4)), b.column(5).to_numpy()
        at = runs(key[:, 0], key[:, 1], key[:, 2])
        start, length = at[:-1], np.diff(at)
        n_home = np.add.reduceat(is_home.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        a_out, b_out = [], []
        # runs inside this batch of a few rows: all home x other pairs at once
        inner = np.ones(len(start), bool)
        inner[[0, -1]] = False
        small = inner & (n_home > 0) & (length > 1) & (n_home * length <= 256)
        if small.any():
            s, h, m = start[small], n_home[small], length[small]
            pair_run = np.repeat(np.arange(len(s)), h * m)
            within = np.arange(len(pair_run)) - np.repeat(np.cumsum(h * m) - h * m, h * m)
            x, y = s[pair_run] + within // m[pair_run], s[pair_run] + within % m[pair_run]
            near = (_distance(fp[x], fp[y]) <= limit) & (rep[x] != rep[y])
            a_out.append(rep[x[near]])
            b_out.append(rep[y[near]])
        for k in np.flatnonzero(~small & ((length > 1) & (n_home > 0) | ~inner)):
            rows = slice(start[k], start[k] + length[k])
            this = tuple(key[start[k]])
            if this != held_key:
                held_key, homes_f, homes_r = this, fp[:0], np.zeros(0, np.int64)
            mine = is_home[rows]
            homes_f, homes_r = np.concatenate([homes_f, fp[rows][mine]]), np.concatenate([homes_r, rep[rows][mine]])
            if len(homes_f):
                for p, q in _block_links(homes_f, homes_r, fp[rows][~mine], rep[rows][~mine], limit):
                    a_out.append(p)
                    b_out.append(q)
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"])


def links(distinct: DataFrame, limit: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): ids that connect the fingerprints which differ in at most ``limit`` bits, as far as some block agrees up to one bit.

    ``distinct`` has one row (fp, rep) per different fingerprint. Where more than ``block`` fingerprints are at home at one anchor,
    homes and others are dealt over a grid of blocks, so no task holds an anchor whole.
    """
    placed = replicas(distinct)
    crowd = home_anchors(distinct).groupBy("anchor").count().filter(F.col("count") > block)
    crowd = stored(crowd.select("anchor", F.ceil(F.col("count") / block).cast("int").alias("parts")), "crowd")
    dealt = placed.withColumn("parts", F.lit(1))
    if crowd.limit(1).count():
        dealt = placed.join(crowd, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    # a row at home stands in its row of the grid as a home and, like any other, in its column as one to compare
    as_home = dealt.filter("home").select("anchor", part.alias("i"), F.explode(everywhere).alias("j"), F.lit(True).alias("home"), "fp", "rep")
    as_other = dealt.select("anchor", F.explode(everywhere).alias("i"), part.alias("j"), F.lit(False).alias("home"), "fp", "rep")
    rows = as_home.unionByName(as_other)
    ordered = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", F.desc("home"))
    return ordered.mapInArrow(lambda batches: _compared(batches, limit), "a long, b long")


def _distinct(prints: DataFrame, k: int) -> DataFrame:
    return stored(prints.filter("id IS NOT NULL").groupBy(F.col(f"fp{k}").alias("fp")).agg(F.min("id").alias("rep")), f"distinct{k}")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure=EXACT) -> DataFrame:
    """One row (id, fp, component) per document; component is the smallest id reachable by links, itself included.

    ``measure`` is (words of a shingle, words of the fingerprint, differing bits allowed). Null, empty and blank texts have a fingerprint
    of zeros and link like any other. A null id gets the component of its fingerprint, or null if no document with an id has that one.
    Repeated rows give repeated results, an empty table an empty one; other columns are not read. Ids must be whole numbers.
    """
    whole_ids(docs, id_col)
    prints = stored(fingerprints(docs, (measure,), id_col, text_col), "prints")
    distinct = _distinct(prints, 0)
    roots = components(stored(links(distinct, measure[2]), "links"), "simhash")
    groups = distinct.join(roots, distinct.rep == roots.node, "left").select(F.col("fp").alias("fp0"), F.coalesce("root", "rep").alias("component"))
    return prints.join(groups, "fp0", "left").select("id", F.col("fp0").alias("fp"), "component")


# -- near copies by their shingles ---------------------------------------------------------------


def shingles(split: list[bytes], shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The different shingles of a sequence of words as sorted 64-bit hashes; no words give none, few of them one."""
    if not split:
        return np.zeros(0, np.uint64)
    rows = zip(*(split[k : len(split) - shingle + 1 + k] for k in range(shingle))) if len(split) >= shingle else [split]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, rows)), np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """One byte of the least value under each of BANDS x ROWS hash functions; zeros for no hashes."""
    if len(hashes) == 0:
        return bytes(BANDS * ROWS)
    least = np.array([(hashes * m + a).min() for m, a in zip(FACTORS, TERMS)], np.uint64)
    return ((least ^ (least >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def _text_key(text_col: str):
    """A digest of a text, empty for null: with its id it tells a document."""
    return F.coalesce(F.md5(col(text_col)), F.lit(""))


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, same, fp, sketch): ``same`` is a digest of the set of shingles, ``fp`` the fingerprint of their sequence."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("key", T.StringType()), T.StructField("same", T.BinaryType()),
                           T.StructField("fp", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        for b in batches:
            split = [words(t) for t in raw_texts(b.column(2))]
            sets = [shingles(w) for w in split]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                                              pa.array([fingerprint(w, NEAR_SHINGLE) for w in split], pa.binary()),
                                              pa.array([sketch(s) for s in sets], pa.binary())], schema.names)

    return docs.select(col(id_col), _text_key(text_col), col(text_col)).mapInArrow(run, schema)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def banded(distinct: DataFrame) -> DataFrame:
    """(band, node, root, sketch): a row for each band of each (node, root, sketch); the band's number is in its upper bits."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = np.ascontiguousarray(_sketches(b.column(2))).view("<u4")
                for k in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, k].astype(np.int64) | (k << 32)), *b.columns], ["band", "node", "root", "sketch"])

    return distinct.select("node", "root", "sketch").mapInArrow(run, "band long, node long, root long, sketch binary")


def _groups(batches, keys: int):
    """The rows of each value of the first ``keys`` columns of sorted batches, as tables; holds one group and one batch."""
    held = None
    for b in batches:
        if b.num_rows == 0:
            continue
        now = pa.Table.from_batches([b])
        held = now if held is None else pa.concat_tables([held, now])
        at = runs(*(held.column(k).to_numpy() for k in range(keys)))
        for s, e in zip(at[:-2], at[1:-1]):
            yield held.slice(s, e - s)
        held = held.slice(at[-2])
    if held is not None:
        yield held


FOUND = "a long, b long, band long, score int"


def _near_in_parts(batches):
    """From sorted rows (band, part, node, sketch, parts): pairs (a, b) of neighbours, and of each row with the centre of its part.

    The centre is the row that agrees best with the commonest value in every place of the sketches: where texts are edited copies of one,
    that one. A part of a larger band also gives (centre, band, agreement) with a null b, so the band's own centre can be chosen.
    """
    for group in _groups(batches, 2):
        if group.num_rows < 2 and group.column(4)[0].as_py() < 2:
            continue
        band, node, sketches = group.column(0)[0].as_py(), group.column(2).to_numpy(), _sketches(group.column(3).combine_chunks())
        at = np.flatnonzero((sketches[1:] == sketches[:-1]).sum(1) >= AGREE)
        a, b, bands, scores = [node[at]], [node[at + 1]], [np.full(len(at), -1)], [np.zeros(len(at), int)]
        if len(node) >= CENTRE_ROWS or group.column(4)[0].as_py() > 1:
            places = sketches + (256 * np.arange(sketches.shape[1], dtype=np.int32))
            common = np.bincount(places.ravel(), minlength=256 * sketches.shape[1]).reshape(-1, 256).argmax(1)
            fit = (sketches == common).sum(1)
            centre = int(fit.argmax())
            others = np.flatnonzero(((sketches == sketches[centre]).sum(1) >= AGREE) & (node != node[centre]))
            a.append(node[others])
            b.append(np.full(len(others), node[centre]))
            bands.append(np.full(len(others), -1))
            scores.append(np.zeros(len(others), int))
            if group.column(4)[0].as_py() > 1:
                a.append(node[[centre]])
                b.append(np.array([-1]))
                bands.append(np.array([band]))
                scores.append(fit[[centre]])
        a, b, bands, scores = (np.concatenate(x) for x in (a, b, bands, scores))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(bands), pa.array(scores.astype(np.int32))], ["a", "b", "band", "score"])


def _cell_pairs(band: int, side: np.ndarray, node: np.ndarray, root: np.ndarray, sketches: np.ndarray, cross: bool):
    """Pairs (smaller node first) of one cell that are not connected yet, have like sketches, and share no band before this one."""
    bands = np.ascontiguousarray(sketches).view("<u4")
    for at in range(0, len(node), 64):
        part = slice(at, at + 64)
        like = root[part, None] != root[None, :]
        like &= (side[part, None] < side[None, :]) if cross else (node[part, None] < node[None, :])
        i, j = np.nonzero(like)
        i += at
        for step in range(0, len(i), 100_000):
            x, y = i[step : step + 100_000], j[step : step + 100_000]
            use = (sketches[x] == sketches[y]).sum(1) >= AGREE
            x, y = x[use], y[use]
            use = np.argmax(bands[x] == bands[y], axis=1) == band >> 32
            if use.any():
                yield x[use], y[use]


CANDIDATES = "a long, b long, band long, lo int, hi int, side int"


def _other_pairs(batches):
    """Candidates within sorted cells (band, lo, hi, side, node, root, sketch).

    A cell with at most ``DENSE`` pairs for each row gives these, (a, b); another gives its rows that are in a pair, (a, band, lo, hi, side).
    """
    names = ["a", "b", "band", "lo", "hi", "side"]
    for cell in _groups(batches, 3):
        side, node, root = (cell.column(k).to_numpy() for k in (3, 4, 5))
        if len(node) < 2 or (root == root[0]).all():
            continue
        band, lo, hi = (cell.column(k)[0].as_py() for k in range(3))
        sketches = _sketches(cell.column(6).combine_chunks())
        x, y, n = [], [], 0
        for i, j in _cell_pairs(band, side, node, root, sketches, lo != hi):
            n += len(i)
            if n <= DENSE * len(node):
                x.append(i)
                y.append(j)
            else:  # only who is in a pair is of interest from here on
                x, y = [np.unique(np.concatenate([*x, *y, i, j]))], []
        if n > DENSE * len(node):
            k = np.unique(np.concatenate(x))
            columns = [node[k], None, band, lo, hi, side[k]]
        elif n:
            i, j = node[np.concatenate(x)], node[np.concatenate(y)]
            columns = [np.minimum(i, j), np.maximum(i, j), None, None, None, None]
        else:
            continue
        size = len(columns[0])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(np.broadcast_to(c, size), t) for c, t in zip(columns, kinds)], names)


def similar_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets (sorted hashes without repeats) whose Jaccard similarity reaches the threshold, exactly.

    Shingles of many sets are columns of a matrix, multiplied a block of columns at a time; the others are counted pair by pair.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float32)
    order = np.argsort(inverse, kind="stable")
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for d in np.unique(count[(count > 1) & (count <= COMMON)]):
        rows = row[order[first[count == d][:, None] + np.arange(d)]]
        for i, j in zip(*np.triu_indices(d, 1)):
            np.add.at(both, (rows[:, i], rows[:, j]), 1)
    common = np.flatnonzero(count > COMMON)
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        m = np.zeros((n, len(part)), np.float32)
        for k, t in enumerate(part):
            m[row[order[first[t] : first[t] + count[t]]], k] = 1
        both += np.triu(m @ m.T, 1)
    size = np.array([len(s) for s in sets], np.float64)
    i, j = np.nonzero(both)
    shared = both[i, j].astype(np.float64)
    use = shared / (size[i] + size[j] - shared) >= threshold
    return i[use], j[use]


def _verified_cells(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) within cells (band, lo, hi) of many candidates, which are verified where they lie; few that connect the same."""

    def run(batches):
        for cell in _groups(batches, 3):
            node = cell.column(4).to_numpy()
            i, j = similar_pairs([np.frombuffer(x.as_py(), np.uint64) for x in cell.column(5)], threshold)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(node[i], node[j])], ["a", "b"])

    rows = members.select("band", "lo", "hi", "side", F.col("a").alias("node")).join(sets, "node").select("band", "lo", "hi", "side", "node", "hashes")
    return rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node").mapInArrow(run, "a long, b long")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of every node of the pairs."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).filter("node IS NOT NULL").distinct()
    keyed = nodes.select("id", "key", "node").join(wanted, "node")
    texts = docs.select(col(id_col).alias("id"), _text_key(text_col).alias("key"), col(text_col).alias("text")).join(keyed, ["id", "key"]).select("node", "text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(words(t)).tobytes() for t in raw_texts(b.column(1))], pa.binary())], ["node", "hashes"])

    return stored(texts.dropDuplicates(["node"]).mapInArrow(run, "node long, hashes binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``threshold`` or more.

    A pair goes to the task of that end which is in fewer pairs, so the centre of a large group is sent to its members, not they to it.
    """
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    degree = stored(ends.groupBy("node").count(), "degree")
    both = pairs.join(degree.select(F.col("node").alias("a"), F.col("count").alias("na")), "a").join(degree.select(F.col("node").alias("b"), F.col("count").alias("nb")), "b")
    swap = F.col("nb") < F.col("na")
    pairs = stored(both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")), "turned")
    first = pairs.select("a").distinct().join(sets, F.col("a") == F.col("node")).select("a", F.lit(None).cast("long").alias("b"), "hashes")
    other = pairs.join(sets, F.col("b") == F.col("node")).select("a", "b", "hashes")

    def run(batches):
        mine = None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                now = np.frombuffer(raw.as_py(), np.uint64)
                if b is None:
                    mine = now
                    continue
                both = len(np.intersect1d(mine, now, assume_unique=True))
                if both and both / (len(mine) + len(now) - both) >= threshold:
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    rows = first.unionByName(other).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b"))
    return rows.mapInArrow(run, "a long, b long")


def fingerprint_pairs(distinct: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): candidates among the rows (node, fp) by fingerprints that are equal or differ in at most ``limit`` bits."""
    prints = stored(distinct.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    equal = distinct.join(prints, "fp").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return equal.unionByName(stored(links(prints, limit), "links"))


def near_copies(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, threshold: float = NEAR, block: int = NEAR_BLOCK) -> DataFrame:
    """(a, b): links that connect the nodes whose sets of shingles have a Jaccard similarity of ``threshold`` or more.

    Candidates are linked by their fingerprints or share a band of their sketches, and each is verified by its sets. First come the pairs of the fingerprints, and
    in a band rows are only paired with their neighbours and its centre, a few pairs for each row. What these links connect is not compared again. Then all other pairs of a band are: bands
    of more than ``block`` rows are dealt over a grid of cells, and a cell passes on few pairs for each of its rows or is verified whole
    in its task, so the pairs of a large group never become rows.
    """
    distinct = stored(nodes.groupBy("same").agg(F.min("node").alias("node"), F.min_by("fp", "node").alias("fp"), F.first("sketch").alias("sketch")), "distinct")
    equal = nodes.join(distinct.select("same", F.col("node").alias("rep")), "same").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    rows = banded(distinct.withColumn("root", F.col("node")))
    parts = F.ceil(F.col("count") / block).cast("int").alias("parts")
    crowd = stored(rows.groupBy("band").count().filter(F.col("count") > block).select("band", parts), "crowd")
    dealt = rows.withColumn("parts", F.lit(1))
    crowded = crowd.limit(1).count()
    if crowded:
        dealt = rows.join(crowd, "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    chain = dealt.select("band", part.cast("long").alias("part"), "node", "sketch", "parts").repartition("band", "part").sortWithinPartitions("band", "part", "node")
    found = stored(chain.mapInArrow(_near_in_parts, FOUND), "found")
    beside = fingerprint_pairs(distinct).unionByName(found.filter("b >= 0").select("a", "b"))
    if crowded:
        centre = found.filter("b < 0").groupBy("band").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("b"))
        near_centre = rows.join(centre, "band").filter(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")
        beside = beside.unionByName(near_centre)
    beside = stored(beside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    near = stored(verified(beside, _shingle_sets(docs, nodes, beside, id_col, text_col), threshold), "near")

    roots = components(near, "simhash").withColumnRenamed("root", "low")
    rows = banded(stored(distinct.join(roots, "node", "left").select("node", F.coalesce("low", "node").alias("root"), "sketch"), "rooted"))
    mixed = rows.groupBy("band").agg(F.count(F.lit(1)).alias("count"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    mixed = stored(mixed.select("band", parts), "mixed")
    cells = rows.join(mixed, "band").withColumn("side", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("band", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "root", "sketch")
    ordered = cells.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    rest = stored(ordered.mapInArrow(_other_pairs, CANDIDATES), "candidates")
    sets = _shingle_sets(docs, nodes, rest, id_col, text_col)
    pairs = rest.filter("b IS NOT NULL").select("a", "b").join(beside, ["a", "b"], "left_anti")
    further = verified(stored(pairs, "pairs"), sets, threshold)
    return near.unionByName(further).unionByName(_verified_cells(rest.filter("b IS NULL"), sets, threshold)).unionByName(equal)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = NEAR, block: int = NEAR_BLOCK) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id, with all columns.

    Documents link if the Jaccard similarity of their five-word shingles is ``threshold`` or more, and a group is what links connect.
    A document is told by its id and text: of rows that agree in both one stays, and texts that share an id link like any others.
    Documents without an id cannot be told apart and all stay, and link nothing. An empty table gives an empty one.
    """
    known, rest = docs.filter(col(id_col).isNotNull()), docs.filter(col(id_col).isNull())
    each = described(known, id_col, text_col).groupBy("id", "key").agg(F.first("same").alias("same"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    # numbers that grow with the id, so the smallest of a group is the document with the smallest id
    nodes = stored(each.orderBy("id", "key").withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = stored(near_copies(known, nodes, id_col, text_col, threshold, block), "links")
    gone_id, gone_key, key = fresh(docs, "gone_id"), fresh(docs, "gone_key"), fresh(docs, "key")
    gone = components(found, "simhash").join(nodes, "node").select(F.col("id").alias(gone_id), F.col("key").alias(gone_key))
    chosen = known.withColumn(key, _text_key(text_col)).join(gone, (col(id_col) == col(gone_id)) & (col(key) == col(gone_key)), "left_anti")
    return chosen.dropDuplicates([id_col, key]).select(*[col(c) for c in docs.columns]).unionByName(rest)
