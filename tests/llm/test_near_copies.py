"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline as P
import numpy as np
import pytest
from test_duplicates import closure, prose

from crosspanel.llm import simhash
from crosspanel.llm.common import prepare


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def planted(rng, groups):
    """Texts of 300 words and copies edited to a similarity of about 0.7 to 0.95."""
    rows = []
    for _ in range(groups):
        words = prose(rng, 300).split()
        rows.append(" ".join(words))
        for edits in (rng.randrange(2, 5), rng.randrange(5, 8), rng.randrange(9, 13)):
            copy = list(words)
            for at in rng.sample(range(10, 290, 6), edits):
                copy[at] = f"edit{rng.randrange(10**9)}"
            rows.append(" ".join(copy))
    return rows


@pytest.mark.parametrize("block", [simhash.NEAR_BLOCK, 2])
def test_all_copies_from_eight_tenths_go_and_none_below(spark, block):
    prepare(spark)
    rows = list(enumerate(planted(random.Random(31), 80)))
    sets = {i: shingle_set(t) for i, t in rows}
    values = {(a, b): jaccard(sets[a], sets[b]) for a in sets for b in sets if a < b}
    edited = [v for v in values.values() if 0.8 <= v < 0.95]
    assert len(edited) > 100 and sum(0.6 < v < 0.8 for v in values.values()) > 60
    roots = closure([p for p, v in values.items() if v >= 0.8])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stay = {r.doc_id for r in simhash.keep_one(docs, block=block).collect()}
    want = {i for i in sets if roots.get(i, i) == i}
    assert stay >= want
    assert len(sets) - len(stay) >= 0.99 * (len(sets) - len(want))


def test_stage_against_brute_force(spark):
    rows = list(enumerate(planted(random.Random(32), 40)))
    sets = {i: shingle_set(t) for i, t in rows}
    roots = closure([(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    want = {i for i in sets if roots.get(i, i) == i}
    stay = {r.doc_id for r in P.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert stay >= want and len(sets) - len(stay) >= 0.99 * (len(sets) - len(want))


@pytest.mark.parametrize("centre", [True, False])
def test_a_large_group_of_copies_of_one_text(spark, monkeypatch, centre):
    """Copies that are alike to 0.7 link only through their common source; without it they all stay, and no pair of them becomes a row."""
    rng, n = random.Random(33), 700
    words = prose(rng, 300).split()
    texts = []
    for _ in range(n):
        copy = list(words)
        for at in rng.sample(range(10, 290, 6), 5):
            copy[at] = f"edit{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + ([(n, " ".join(words))] if centre else []) + [(n + 1 + k, t) for k, t in enumerate(planted(rng, 3))]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
    written = []
    keep = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: written.append((name, keep(df, name))) or written[-1][1])
    stay = {r.doc_id for r in simhash.keep_one(docs, block=128).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    roots = closure(pairs)
    assert stay == {i for i in sets if roots.get(i, i) == i}
    sizes = [(name, df.count()) for name, df in written]
    assert max(c for name, c in sizes if name in ("found", "pairs", "candidates", "turned")) < 40 * n


def test_similar_pairs_are_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint64) for _ in range(90)] + [np.arange(50, dtype=np.uint64)] * 40
    i, j = simhash.similar_pairs(sets, 0.6)
    want = {(a, b) for a in range(len(sets)) for b in range(a) if len(x := np.intersect1d(sets[a], sets[b])) / (len(sets[a]) + len(sets[b]) - len(x)) >= 0.6}
    assert {(max(a, b), min(a, b)) for a, b in zip(i, j)} == want and len(i) == len(want)


def test_fingerprints_find_copies_without_any_band(spark, monkeypatch):
    """Candidates of the fingerprints alone: equal shingles in another number, and one word changed in many; the shingles decide."""
    prepare(spark)
    rng = random.Random(34)
    long, other = prose(rng, 3_000).split(), prose(rng, 300)
    edited = [*long[:1_500], "changed", *long[1_501:]]
    assert (simhash._distance(*(np.frombuffer(simhash.fingerprint([w.encode() for w in t], simhash.NEAR_SHINGLE), ">u8").astype(np.uint64) for t in (long, edited)))) <= simhash.MAX_DISTANCE
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (3, other), (4, "the the the"), (5, None), (6, " ")]
    monkeypatch.setattr(simhash, "banded", lambda d: d.select(*[simhash.F.lit(0).cast("long").alias("band"), "node", "root", "sketch"]).filter("false"))
    stay = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert stay == {1, 3, 4, 5}
