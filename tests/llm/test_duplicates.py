"""Near and exact duplicates: components, SimHash, repeated strings, repeated lines, embeddings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from crosspanel.llm import embeddings, lines, repeats, simhash
from crosspanel.llm.common import components, forest, prepare, runs

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def closure(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


# -- components ------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty", "same"])
def test_components_are_the_closure(session, kind):
    rng = random.Random(3)
    pairs = {
        "chain": [(k, k + 1) for k in range(200)], "star": [(500, k) for k in range(40)], "empty": [], "same": [(4, 4), (2, 1), (1, 2)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
    }[kind]
    df = session.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: r for x, r in closure(pairs).items() if x != r}


def test_forest_and_runs():
    node, root = forest(np.array([5, 9, 7]), np.array([3, 5, 7]))
    assert dict(zip(node.tolist(), root.tolist())) == {5: 3, 9: 3}
    assert runs(np.array([1, 1, 2, 2, 2, 5])).tolist() == [0, 2, 5, 6]
    assert runs(np.array([])).tolist() == [0]


# -- SimHash ---------------------------------------------------------------------------------


def test_covering_code():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 1 << 32, 400, dtype=np.uint32), np.array([0, 1, 1 << 31, (1 << 32) - 1], np.uint32)])
    at_home = simhash.home(v)
    assert (simhash._syndrome(at_home) == 0).all() and (np.bitwise_count(at_home ^ v) <= 1).all()
    row, anchor = simhash.anchors(v)
    assert (simhash._syndrome(anchor) == 0).all() and (np.bitwise_count(anchor ^ v[row]) <= 2).all()
    assert len(set(zip(row.tolist(), anchor.tolist()))) == len(row)
    for k in range(0, len(v), 37):  # values up to one bit away are at home at one of the anchors
        mine = set(anchor[row == k].tolist())
        for bit in range(32):
            assert int(simhash.home(np.array([v[k] ^ np.uint32(1 << bit)], np.uint32))[0]) in mine


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


EDGE_TEXTS = [None, "", "  \t\n", "one", "one two", "ÀÉ One TWO three", "a\x00b c d", "\x1c x y z"]


def documents(seed=0):
    rng = random.Random(seed)
    rows = [(k, t) for k, t in enumerate(EDGE_TEXTS)]
    for k in range(20, 60):
        rows.append((k, prose(rng, rng.randrange(30, 250))))
    for k in range(60, 140):  # near copies: one word changed, at times one more
        words = rows[rng.randrange(10, len(rows))][1].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        rows.append((k, " ".join(words)))
    rows += [(None, rows[30][1]), (None, "no id"), rows[25], (200, prose(rng, 20_000))]
    return rows


def expected_components(rows, limit=3):
    prints = {t: plain_fingerprint(t) for _, t in rows}
    ids = [(i, prints[t]) for i, t in rows if i is not None]
    pairs = [(a, b) for a, x in ids for b, y in ids if a < b and bin(x ^ y).count("1") <= limit]
    close = closure(pairs)
    smallest = {}
    for i, f in ids:
        smallest[f] = min(smallest.get(f, i), close.get(i, i))
    return Counter((i, f"{prints[t]:016x}", close.get(i, i) if i is not None else smallest.get(prints[t])) for i, t in rows)


def test_simhash_equals_brute_force(session):
    rows = documents()
    df = session.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component int").repartition(4)
    got = Counter((r.id, bytes(r.fp).hex(), r.component) for r in simhash.simhash_groups(df).collect())
    assert got == expected_components(rows)
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_crowded_anchors_are_dealt_over_blocks(session):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = {0} | {int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(120)}
    values = sorted(values)
    distinct = session.createDataFrame([(bytearray(v.to_bytes(8, "big")), k) for k, v in enumerate(values)], "fp binary, rep long").repartition(3)
    want = closure([(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= 3])
    for block in (4, 2_048):
        got = closure([(r.a, r.b) for r in simhash.links(distinct, block=block).collect()])
        assert got == want, block


def test_keep_one(session):
    rng = random.Random(8)
    text = prose(rng, 400)
    other = prose(rng, 400)
    near = text.replace(text.split()[7], "changed", 1)
    rows = [(3, text), (1, text), (2, near), (9, other), (9, other), (None, text), (None, None), (10, None), (11, "")]
    df = session.createDataFrame([(i, t, "a", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, rep string, gone_id int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, text), (9, other), (None, text), (None, None), (10, None)], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


# -- repeated strings --------------------------------------------------------------------------


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if starts[d[k : k + length]] > 1:
                gone[k : k + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(2)
    shared = [prose(rng, 60) for _ in range(4)]
    texts = [None, "", "short", "x" * 1200, "ab" * 700, "é" * 300, prose(rng, 4000)]
    for _ in range(30):
        parts = [prose(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 40)
            parts += [s[cut:], prose(rng, rng.randrange(1, 30))]
        texts.append(" ".join(parts))
    return texts + [texts[12], texts[12] + " end", "y" + texts[13], texts[14][5:], shared[0], "\x00" * 500, "\x00" * 401 + "z"]


@pytest.mark.parametrize("length,block", [(400, 2_000), (100, 2_000), (100, 1)])
def test_repeats_equal_brute_force(session, length, block):
    texts = repeat_texts()
    df = session.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(3)
    rows = {r.id: r for r in repeats.remove_repeats(df, length=length, block=block).collect()}
    want = plain_repeats(texts, length)
    assert [(rows[k].n_bytes, rows[k].n_removed, rows[k].n_spans, rows[k].kept_sha256) for k in range(len(texts))] == want
    for k, t in enumerate(texts):
        r, data = rows[k], (t or "").encode()
        gone = sum(e - s for s, e in r.spans)
        assert gone == r.n_removed and (r.kept is None) == (gone == 0)
        assert r.kept is None or hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert all(0 <= s < e <= len(data) for s, e in r.spans)


def test_repeats_of_nothing(session):
    df = session.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).count() == 0
    with pytest.raises(ValueError):
        repeats.find_repeats(df, length=64)


def test_interval_tree_and_repeat_groups():
    prefix = np.array([-1, 3, 5, 5, 3, -1, 2])
    assert sorted(repeats.intervals(prefix, 1)) == [(2, 5, 6), (3, 0, 4), (5, 1, 3)]
    # three occurrences, two of which share more to either side
    left, right = [b"ab", b"ab", b"zb"], [b"g" * 65 + b"t", b"g" * 65 + b"t", b"g" * 65 + b"l"]
    groups = {(a, b, tuple(sorted(m.tolist()))) for a, b, m, _ in repeats.maximal_repeats(np.zeros(3, int), left, right, 66)}
    assert groups == {(1, 65, (0, 1, 2)), (2, 66, (0, 1))}


# -- repeated lines ----------------------------------------------------------------------------


def plain_lines(rows):
    """Kept text by document: lines of windows that stand before go, comparing whole windows; rows come in the order of ids."""
    seen, out = set(), []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        ls = t.split("\n")
        places = [k for k, x in enumerate(ls) if x.strip(lines.BLANK)]
        gone = set()
        for a, b in zip(places, places[1:]):
            if len(ls[a]) + len(ls[b]) >= lines.MIN_CHARS:
                if (ls[a], ls[b]) in seen:
                    gone |= {a, b}
                seen.add((ls[a], ls[b]))
        out.append((i, "\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone)))
    return out


def test_line_dedup_equals_a_plain_pass(session):
    rng = random.Random(4)
    block = [prose(rng, 5) for _ in range(30)]
    rows = [(0, None), (1, ""), (2, "\n\n\n\n"), (3, "\n".join(block))]
    for k in range(4, 40):
        cut = rng.randrange(20)
        rows.append((k, "\n".join([prose(rng, 4) for _ in range(rng.randrange(4))] + block[cut : cut + rng.randrange(10)] + [prose(rng, 3)] * rng.randrange(3))))
    df = session.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_lines int, ends_ string").repartition(4)
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "ends_", "n_lines_", "n_chunks", "n_removed"]
    got = sorted((r.doc_id, r.text, r.n_lines_, r.n_removed) for r in out.collect())
    assert got == plain_lines(rows) and any(r[3] for r in got)
    assert {r.n_lines for r in out.collect()} == {7}


def test_passages_of_two_and_more_lines_go(session):
    """Runs of lines (60 code points or more) that stand in an earlier document, by brute force: each goes, whatever surrounds it."""
    docs = [(r.doc_id, r.text) for r in session.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(8)
    passages = ["\n".join(prose(rng, rng.randrange(6, 12)) for _ in range(n)) for n in (2, 2, 3, 4, 6)]
    docs += [(10_000 + k, f"{prose(rng, 7)}\n{passages[k % 5]}\n{prose(rng, 9)}") for k in range(60)]
    df = session.createDataFrame(docs, "doc_id long, text string").repartition(4)
    kept = {r.doc_id: (r.text or "").split("\n") for r in lines.dedup_lines(df).collect()}
    before, want, hit, clean = set(), 0, 0, 0
    texts = set()
    for i, t in docs:
        ls = [x for x in (t or "").split("\n") if x.strip()]
        pairs = list(zip(ls, ls[1:]))
        if t not in texts:
            for a, b in pairs:
                if len(a) + len(b) >= 60 and (a, b) in before:
                    want += 2
                    hit += (a not in kept[i]) + (b not in kept[i])
            if not any(p in before for p in pairs) and len(set(pairs)) == len(pairs):
                clean += 1
                assert [x for x in kept[i] if x.strip()] == ls
        texts.add(t)
        before |= set(pairs)
    assert want > 200 and hit >= 0.95 * want and clean > 500


def test_line_dedup_of_repeated_rows_and_null_ids(session):
    rng = random.Random(6)
    text = "\n".join(prose(rng, 6) for _ in range(12))
    df = session.createDataFrame([(5, text), (5, text), (None, text), (2, None), (2, "")], "doc_id long, text string")
    rows = lines.dedup_lines(df).collect()
    assert len(rows) == 5
    by_id = {i: [r for r in rows if r.doc_id == i] for i in (5, None, 2)}
    assert [r.n_removed for r in by_id[None]] == [0]  # a null id sorts first
    assert len({(r.text, r.n_removed) for r in by_id[5]}) == 1 and by_id[5][0].n_removed > 0
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_runs_no_python(session):
    df = session.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in (plan := lines.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan


# -- embeddings --------------------------------------------------------------------------------


@pytest.mark.parametrize("block,n_pivots", [(1_024, 512), (3, 512), (1_024, 2)])
def test_embeddings_equal_brute_force(session, block, n_pivots):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(k, [float(np.float32(x)) for x in base[k % 30] + 0.04 * rng.normal(size=16)], int(k % 2)) for k in range(150)]
    rows += [(200, rows[3][1], 1), (201, rows[3][1], 1), (202, [2 * x for x in rows[3][1]], 1), (203, rows[3][1], None), (204, None, 1), (205, [0.0] * 16, 1),
             (206, [float("nan")] * 16, 1), (207, [None] + rows[3][1][1:], 1), (208, [1.0, 2.0], 1), (209, [1.0, 2.0], 1), (210, [], 1), (None, rows[3][1], 1)]
    df = session.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    out = embeddings.near_duplicates(df, block=block, n_pivots=n_pivots).collect()
    good = [(i, np.array(v), label) for i, v, label in rows if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / np.sqrt(a[1] @ a[1]) / np.sqrt(b[1] @ b[1]) >= 0.98]
    degree, close = Counter(x for p in pairs for x in p), closure(pairs)
    want = sorted([(i, degree[i], close.get(i, i), close.get(i, i) == i) for i, *_ in rows if i is not None])
    got = sorted([(r.id, r.n_links, r.component, r.kept) for r in out if r.id is not None])
    found = sum(x[1] for x in got) / sum(x[1] for x in want)
    assert found >= 0.9
    if found == 1:
        assert got == want
    assert [(r.n_links, r.component, r.kept) for r in out if r.id is None] == [(0, None, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_ids_must_be_whole_numbers(session):
    with pytest.raises(TypeError, match="whole numbers"):
        simhash.simhash_groups(session.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(TypeError, match="whole numbers"):
        embeddings.near_duplicates(session.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<double>, label int"))


@pytest.mark.parametrize("n_pivots", [512, 1_024])
def test_recall_of_links(session, n_pivots):
    """2,000 vectors of the given table with four noisy copies each: thousands of links, found against all pairs of a label."""
    rng = np.random.default_rng(7)
    given = [r for r in session.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(1_500).collect() if r.label is not None and r.embedding is not None]
    base = np.array([r.embedding for r in given], np.float64)
    noise = lambda: base + 0.07 * np.linalg.norm(base, axis=1, keepdims=True) / np.sqrt(base.shape[1]) * rng.normal(size=base.shape)
    vectors = np.concatenate([base, *(noise() for _ in range(4))])
    labels = [r.label for r in given] * 5
    df = session.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<double>, label int").repartition(4)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    want = near.sum(1) - 1
    got = {r.id: r.n_links for r in embeddings.near_duplicates(df, n_pivots=n_pivots).select("id", "n_links").collect()}
    assert want.sum() > 10_000 and all(got[k] <= n for k, n in enumerate(want))
    assert sum(got.values()) >= 0.99 * want.sum()
