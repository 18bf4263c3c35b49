"""Importance resampling and the prefix trie against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from crosspanel.llm import prefix_trie, resampling
from crosspanel.llm.common import prepare
from crosspanel.llm.ranges import numbered


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


# -- resampling --------------------------------------------------------------------------------


def plain_runs(text, most):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_draw(docs, target, percent, min_words, most, buckets):
    def count(texts):
        return Counter(zlib.crc32(r.encode()) % buckets for t in texts for r in plain_runs(t, most)[1])

    s, t = count(x for _, x in docs), count(target)
    ws, wt = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = {b: math.floor(1000.0 * math.log(((t[b] + 1.0) * ws) / ((s[b] + 1.0) * wt))) for b in range(buckets)}
    rows = []
    for at, (i, text) in enumerate(docs):
        words, runs = plain_runs(text, most)
        weight = sum(gain[zlib.crc32(r.encode()) % buckets] for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(runs), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0))), len(words), None])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(((r[0], r[1], r[2], r[3], r[5]) for r in rows), key=repr)


def drawn_rows(df):
    return sorted(((r.id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most,percent,pivots", [(1, 10, 31), (3, 50, 2), (2, 100, 1), (1, 0, 5)])
def test_draw_equals_a_plain_one(session, monkeypatch, most, percent, pivots):
    rng = random.Random(most)
    letters = "a B c Dd É 1x ÄB zz q_r -".split()
    docs = [(k, " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for k in range(150)]
    docs += [(7, docs[7][1]), (None, "a b c " * 9), (None, "a b c " * 9), (900, None), (901, ""), (902, "a " * 30_000)]
    docs += [(1000, "b c d " * 8)] * 60  # a third of the rows agree in id and text, so in score
    target = ["dd é 1x " * 5, None, "", "ÄB Äb"]
    made = session.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, rank string, score int").repartition(3)
    aims = session.createDataFrame([(t,) for t in target], "text string")
    scored = resampling.score(made, resampling.fit(made, aims, max_run=most, buckets=97))
    got = drawn_rows(resampling.draw(scored, percent, 6, pivots))
    assert got == plain_draw(docs, target, percent, 6, most, 97)


def test_draw_of_odd_tables(session):
    docs = session.createDataFrame([("b", "one two"), ("a", "one two"), (None, None)], "name string, body string")
    none = session.createDataFrame([], "text string")
    got = drawn_rows(resampling.resample(docs, none, "name", "body", percent=50, min_words=2))
    assert [(r[0], r[4]) for r in got if r[4]] and {r[1] for r in got} == {0, 2}
    assert resampling.resample(docs.limit(0), none, "name", "body").count() == 0


def test_numbers_go_on_over_ranges(session):
    rows = session.range(1000).select((F.col("id") % 3).alias("range_no"), (-F.col("id")).alias("v"))
    got = numbered(rows, [F.col("v")], "n").orderBy("n").collect()
    assert [(r.n, r.v, r.range_no) for r in got] == [(k + 1, k - 999, (999 - k) % 3) for k in range(1000)]


# -- prefix trie -------------------------------------------------------------------------------


def plain_trie(sequences):
    """sequences: {conv: [(role, text), ...]}."""
    members = defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        todo, out = [p], []
        while todo:
            out.append(todo.pop())
            todo += kids[out[-1]]
        return out

    rows = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(sequences[c]) == len(p))
        tree = below(p)
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[x] for x in tree),
                     sum((len(members[x]) - 1) * len(x[-1][1]) for x in tree if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ordered(rows):
    found = defaultdict(list)
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    return {c: [(x[2], x[4]) for x in sorted(v)] for c, v in found.items()}


def some_rows(rng):
    rows = []
    for c in list(range(-3, 60)) + [1_000_000_007, 150, 151]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yo 😀", "no\nway"])))
    rows += [(5, None, None, None), (5, None, "user", "x"), (6, 2, "user", "hi"), (6, 2, "user", "hi"), (None, 0, "user", "hi")]
    rows += [(70, t, "user", "long " * t) for t in range(40)] + [(71, t, "user", "long " * t) for t in range(30)]
    rows += [(5000 + c, 0, "user", "alone") for c in range(1, 20)]  # the first of their block is absent
    rows += [(c, t, "user", "the same") for c in range(200, 260) for t in range(3)]  # a third of the conversations agree
    return rows


def frame(session, rows):
    made = session.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    return made.repartition(3)


@pytest.mark.parametrize("width,band", [(1024, 64), (4, 2), (16, 1)])
def test_trie_equals_a_plain_one(session, width, band):
    rows = some_rows(random.Random(5))
    turns = prefix_trie.turns_of(frame(session, rows))
    members = turns.filter("pos = 1").select("conv")
    assert trie_rows(prefix_trie.trie(members, turns, width, band)) == plain_trie(ordered(rows))


def test_rebuilt_conversations(session):
    rows = some_rows(random.Random(6))
    own, want = ordered(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        want[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not v for v in want.values())  # some have no turn left
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(frame(session, rows))))
    assert trie_rows(got) == plain_trie(want)


def test_tries_without_turns(session):
    turns = prefix_trie.turns_of(frame(session, [(1, 0, "a", "b")])).limit(0)
    assert trie_rows(prefix_trie.trie(turns.select("conv"), turns)) == []
    silent = session.createDataFrame([(4,), (2000,), (-1,)], "conv long")
    assert trie_rows(prefix_trie.trie(silent, turns)) == plain_trie({4: [], 2000: [], -1: []})
