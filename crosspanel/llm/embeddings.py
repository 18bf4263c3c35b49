"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest reference points (pivots) in order. Vectors are posted to inverted lists, one for each
set of ``SHARED`` pivots among those nearest, so two vectors meet exactly if they share at least that many; the list of their smallest
shared pivots is the one that counts them. Pairs met there are verified by their cosine in double precision. Pivots are fitted on a
bounded sample; every vector is indexed. Equal vectors are one entry with a count.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import col, components, forest, runs, stored, whole_ids

THRESHOLD = 0.98
NEAREST = 6
SHARED = 3
#: Reference points, at most; the same at every size of the table.
PIVOTS = 512
#: Vectors looked at for each reference point.
SAMPLE = 4
#: Entries of one list compared in one block; longer lists are dealt over pairs of blocks.
BLOCK = 1_024


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None if it is null or zero or holds a null or non-finite component."""
    out = []
    for value in column.to_pylist():
        v = None if value is None or any(x is None for x in value) else np.array(value, np.float64)
        out.append(v if v is not None and len(v) and np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and v @ v > 0 else None)
    return out


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, key, vector): the key is a digest of the components; null for vectors that link with nothing."""

    def run(batches):
        for b in batches:
            ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys, packed = [], []
            for i, label, v in zip(ids, labels, _vectors(b.column(2))):
                data = (v + 0.0).tobytes() if v is not None and label is not None and i is not None else None
                packed.append(data)
                keys.append(hashlib.md5(data).digest() if data is not None else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                                             ["id", "label", "key", "vector"])

    return vectors.select(col(id_col).cast("long"), col(label_col).cast("string"), col(vector_col)).mapInArrow(run, "id long, label string, key binary, vector binary")


def choose_pivots(distinct: DataFrame, n_pivots: int = PIVOTS, threshold: float = THRESHOLD) -> dict[int, np.ndarray]:
    """Reference points of each dimension, at most ``n_pivots`` of all: in the order of their digests, vectors that are far apart.

    A vector within twice the angle of the threshold of a chosen one is left out, so a dense group of near copies holds a few at most.
    """
    rows = distinct.groupBy("key").agg(F.first("vector").alias("vector")).orderBy("key").limit(SAMPLE * n_pivots).collect()
    by_size: dict[int, list] = {}
    left = n_pivots
    for r in rows:
        v = np.frombuffer(r.vector)
        v = v / np.linalg.norm(v)
        chosen = by_size.setdefault(len(v), [])
        if left and (not chosen or (np.array(chosen) @ v).max() < 2 * threshold * threshold - 1):
            chosen.append(v)
            left -= 1
    return {size: np.array(v) for size, v in by_size.items()}


def postings(distinct: DataFrame, pivots: dict[int, np.ndarray], nearest: int, shared: int) -> DataFrame:
    """(label, list, rep, n, top, vector) for every list of each distinct vector."""
    context = distinct.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        sets = list(combinations(range(nearest), shared))
        for b in batches:
            labels, reps, counts, data = (b.column(k).to_pylist() for k in range(4))
            out = {"label": [], "list": [], "rep": [], "n": [], "top": [], "vector": []}
            for label, rep, n, raw in zip(labels, reps, counts, data):
                v = np.frombuffer(raw)
                points = context.value.get(len(v))
                # a vector of a size without enough reference points meets all others of its size in one list
                top = np.sort(np.argsort(-(points @ v), kind="stable")[:nearest]) if points is not None and len(points) >= nearest else np.arange(nearest)
                ids = top.astype("<i4").tobytes()
                for s in sets if points is not None and len(points) >= nearest else sets[:1]:
                    out["label"].append(label)
                    out["list"].append(np.append(top[list(s)], len(v)).astype("<i4").tobytes())
                    out["rep"].append(rep)
                    out["n"].append(n)
                    out["top"].append(ids)
                    out["vector"].append(raw)
                if len(out["rep"]) >= 20_000:
                    yield pa.RecordBatch.from_pydict(out, POSTING)
                    out = {k: [] for k in out}
            if out["rep"]:
                yield pa.RecordBatch.from_pydict(out, POSTING)

    return distinct.select("label", "rep", "n", "vector").mapInArrow(run, "label string, list binary, rep long, n long, top binary, vector binary")


POSTING = pa.schema([("label", pa.string()), ("list", pa.binary()), ("rep", pa.int64()), ("n", pa.int64()), ("top", pa.binary()), ("vector", pa.binary())])


def _owned(top_a: np.ndarray, top_b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether the smallest shared pivots of each pair are those of this list; top rows are sorted."""
    common = (top_a[:, :, None] == top_b[:, None, :]).any(axis=2)
    rank = np.cumsum(common, axis=1)
    ok = np.ones(len(top_a), bool)
    for k, pivot in enumerate(own):
        at = np.argmax(rank == k + 1, axis=1)
        ok &= top_a[np.arange(len(top_a)), at] == pivot
    return ok


def _list_links(rows: list[tuple], own: np.ndarray, cross: bool, threshold: float):
    """(ids, neighbours counted) and a forest of the links of one block of a list."""
    vector = np.array([np.frombuffer(r[0]) for r in rows])
    top = np.array([np.frombuffer(r[1], "<i4") for r in rows])
    rep, n, side = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    norm = np.sqrt((vector * vector).sum(axis=1))
    degree, a_out, b_out = np.zeros(len(rows), np.int64), [], []
    for at in range(0, len(rows), 256):
        cosine = vector[at : at + 256] @ vector.T / (norm[at : at + 256, None] * norm[None, :])
        i, j = np.nonzero(cosine >= threshold)
        i += at
        use = (side[i] < side[j]) if cross else (i < j)
        i, j = i[use], j[use]
        for part in range(0, len(i), 100_000):
            x, y = i[part : part + 100_000], j[part : part + 100_000]
            mine = _owned(top[x], top[y], own)
            x, y = x[mine], y[mine]
            degree += np.bincount(x, n[y], len(rows)).astype(np.int64) + np.bincount(y, n[x], len(rows)).astype(np.int64)
            a, b = forest(rep[x], rep[y])
            a_out.append(a)
            b_out.append(b)
    found = np.flatnonzero(degree)
    return rep[found], degree[found], np.concatenate(a_out or [found[:0]]), np.concatenate(b_out or [found[:0]])


def _compared(batches, threshold: float):
    """Sorted rows (label, list, lo, hi, side, rep, n, top, vector) to (a, b, links): links between a and b, or a's count."""

    def out(name, rows):
        own = np.frombuffer(name[1], "<i4")[:-1]
        rep, degree, a, b = _list_links(rows, own, name[2] != name[3], threshold)
        if len(rep):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep, a])), pa.array(np.concatenate([rep, b])),
                                              pa.array(np.concatenate([degree, np.zeros(len(a), np.int64)]))], ["a", "b", "links"])

    name, rows = None, []
    for batch in batches:
        labels, lists, lo, hi, side, rep, n, top, vector = (c.to_pylist() for c in batch.columns)
        for k in range(len(lo)):
            this = (labels[k], lists[k], lo[k], hi[k])
            if this != name:
                if len(rows) > 1:
                    yield from out(name, rows)
                name, rows = this, []
            rows.append((vector[k], top[k], rep[k], n[k], side[k]))
    if len(rows) > 1:
        yield from out(name, rows)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
                    nearest: int = NEAREST, shared: int = SHARED, n_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component (smallest id reachable), kept (id is that).

    Vectors link if their labels are equal and not null, they have one length, and their cosine reaches ``threshold``. Vectors without an
    id, null or zero ones and those with a null or non-finite component link with nothing and are kept. Rows that repeat an id are vectors
    of their own. An empty table gives an empty result; other columns are not read. Ids must be whole numbers.
    """
    whole_ids(vectors, id_col)
    rows = stored(prepared(vectors, id_col, vector_col, label_col), "vectors")
    distinct = stored(rows.filter("key IS NOT NULL").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")), "distinct")
    posted = stored(postings(distinct, choose_pivots(distinct, n_pivots, threshold), nearest, shared), "postings")
    crowd = stored(posted.groupBy("label", "list").count().filter(F.col("count") > block)
                   .select("label", "list", F.ceil(F.col("count") / block).cast("int").alias("parts")), "crowd")
    dealt = posted.withColumn("parts", F.lit(1))
    if crowd.limit(1).count():
        dealt = posted.join(crowd, ["label", "list"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    cells = dealt.withColumn("side", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("label", "list", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "rep", "n", "top", "vector")
    ordered = cells.repartition("label", "list", "lo", "hi").sortWithinPartitions("label", "list", "lo", "hi")
    found = stored(ordered.mapInArrow(lambda batches: _compared(batches, threshold), "a long, b long, links long"), "links")
    degree = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("links = 0").select("a", "b"), "embeddings")
    entries = distinct.select("label", "key", "rep", "n").join(degree, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    result = rows.select("id", "label", "key").join(entries, ["label", "key"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    return result.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
