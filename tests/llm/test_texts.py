"""Decontamination, BPE, language, quality, chat and WARC."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import random
import re
import tempfile
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crosspanel.llm import bpe, chat, decontaminate, language, quality, warc
from crosspanel.llm.common import prepare

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


# -- decontamination ---------------------------------------------------------------------------


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items, window):
    w, hit, found = plain_words(text), set(), set()
    for i, t in items:
        v = plain_words(t)
        for k in range(max(1, len(v) - window + 1) if v else 0):
            phrase = v[k : k + window]
            for at in range(len(w) - len(phrase) + 1):
                if w[at : at + len(phrase)] == phrase:
                    hit |= set(range(at, at + len(phrase)))
                    if i is not None:
                        found.add(str(i))
    return len(w), sorted(hit), sorted(found)


def bench_rows(rng, n):
    letters = "a b c d É 1".split()
    return [(k, " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 9)))) for k in range(n)] + [(2, "a b c"), (None, "d d d"), (77, None), (78, "..!"), (79, "Zebra-crossing")]


@pytest.mark.parametrize("block_words", [2_000_000, 5])
def test_find_equals_brute_force(session, block_words):
    rng = random.Random(1)
    items = bench_rows(rng, 12)
    texts = [None, "", "...", "A b C", "zebra  CROSSING zebra", "dddd d d"] + [" ".join(rng.choice("a b c d e é É 1 2 X".split()) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    docs = session.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    bench = session.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs, bench, window=4, block_words=block_words)
    rows = {r.id: r for r in found.collect()}
    verdict = {r.id: r for r in decontaminate.verdicts(found).collect()}
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, bench, window=4, block_words=block_words).collect()}
    for k, t in enumerate(texts):
        n, hit, names = plain_hits(t, items, 4)
        r = rows[k]
        assert (r.n_words, [x for s, e in r.hit_spans for x in range(s, e)], r["items"]) == (n, hit, names), t
        assert all(a[1] < b[0] for a, b in zip(r.hit_spans, r.hit_spans[1:]))
        v = verdict[k]
        assert (v.n_hit, v.n_items, v.items_sha256) == (len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
        assert v.contaminated == (len(hit) > 0 and 20 * len(hit) >= n) == (k not in clean)


def test_decontaminate_edges(session):
    docs = session.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None)], "doc_id long, text string")
    none = session.createDataFrame([], "item_id long, text string")
    assert sorted(r.n_words for r in decontaminate.find(docs, none).collect()) == [0, 1, 2, 2]
    assert decontaminate.keep_clean(docs, none).count() == 4
    one = session.createDataFrame([(5, "a")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.keep_clean(docs, one).collect()] == [2]
    assert decontaminate.find(docs.limit(0), one).count() == 0
    assert decontaminate.find(docs, session.createDataFrame([(5, "a"), (6, "b")], "item_id long, text string"), block_words=1).count() == 4


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 400)
    index = decontaminate.FMIndex(text, sample=5)
    phrases = [text[a : a + n].tolist() for a, n in [(0, 1), (3, 2), (10, 5), (395, 5), (7, 9)]] + [[9, 1], [4, 4, 4, 4, 4, 4, 4]]
    matrix = np.zeros((len(phrases), 9), np.int64)
    for k, p in enumerate(phrases):
        matrix[k, : len(p)] = p
    low, high = index.search(matrix, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [k for k in range(400) if text[k : k + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# -- BPE ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codecs():
    ranks = bpe.read_ranks(RANKS)
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = st.sampled_from(["a", "b", "the", " ", "  ", "\n", " \n ", "\t", "é", "日本", "'", "'ll", "'s", "12", "!", "ion", "x", "ß", "👍🏽", " ", "\x1c", "²", "<|endoftext|>", "ZZ", "​", "़"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=60).map("".join), st.tuples(PIECES, st.integers(1, 300)).map(lambda x: x[0] * x[1])), st.sampled_from([1, 2, 5, 17, 1 << 14]))
def test_bpe_equals_tiktoken(codecs, text, leaf):
    mine, other = codecs
    ids = mine.encode(text, leaf)
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert mine.decode(ids, 3) == text.encode()


def test_bpe_table(session, codecs):
    texts = [None, "", " ", "Hello wörld", "Hello wörld", "a" * 5_000, "the theth ethe " * 9_000, "x\n\n  y <|endoftext|>"]
    df = session.createDataFrame([(k, t, "i") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    rows = {r.id: r for r in encoded.collect()}
    for k, t in enumerate(texts):
        want = np.array(codecs[1].encode_ordinary(t or ""), "<u4").tobytes()
        assert (bytes(rows[k].ids), rows[k].n_tokens, rows[k].ids_sha256) == (want, len(want) // 4, hashlib.sha256(want).hexdigest())
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.id: r.text for r in bpe.decode(encoded, RANKS).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# -- language ----------------------------------------------------------------------------------

SOUNDS = {"xx": "ba be bi bo bu".split(), "yy": "kar tor zur mir".split(), "zz": "ñé lü çà ôê".split()}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_language(session):
    rng = random.Random(3)
    rows = [(k, say(rng, lang, rng.randrange(5, 60)), lang) for k in range(240) for lang in [rng.choice(list(SOUNDS))]]
    train = session.createDataFrame([*rows[:160], (900, None, "xx"), (901, "kar tor", None), (902, "", "zz")], "doc_id long, text string, lang string")
    model = language.fit(train, per_language=40)
    assert model.languages == ["xx", "yy", "zz"] and (model.weights == 0).mean() > 0.5
    texts = [(k, t) for k, t, _ in rows[160:]] + [(1000, None), (1001, ""), (1002, "123 ... !"), (1003, say(rng, "yy", 30_000)), (None, "ba be")]
    df = session.createDataFrame([(k, t, "x") for k, t in texts], "doc_id long, text string, score string")
    got = {r.id: r for r in language.identify(df, model).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows[160:]) >= 78
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "yy"]
    assert language.identify(df.limit(0), model).count() == 0
    empty = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}


def test_n_grams_do_not_depend_on_chunks(monkeypatch):
    text = say(random.Random(1), "zz", 500)
    whole = language.counts(text)
    monkeypatch.setattr(language, "CHUNK_CHARS", 17)
    parts = language.counts(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_sample_of_a_language_is_never_empty_and_never_more(session):
    one = session.range(3_000).select(F.lit(7).cast("long").alias("id"), F.lit("xx").alias("lang"), F.lit("kar tor").alias("text"))
    none = session.range(2_000).select(F.lit(None).cast("long").alias("id"), F.lit("yy").alias("lang"), F.concat(F.lit("ba"), F.col("id").cast("string")).alias("text"))
    few = session.range(5).select("id", F.lit("zz").alias("lang"), F.lit("zu").alias("text"))
    rows = one.unionByName(none).unionByName(few)
    found = Counter(r.lang for r in language.sample(rows, 100))
    assert found == {"xx": 100, "yy": 100, "zz": 5}
    model = language.fit(rows.withColumnsRenamed({"id": "doc_id"}), per_language=20)
    assert model.languages == ["xx", "yy", "zz"]


def test_ftrl_equals_a_plain_one():
    rng = np.random.default_rng(3)
    examples = [(np.unique(rng.integers(0, 12, 4)), None, int(rng.integers(0, 3))) for _ in range(40)]
    examples = [(b, rng.uniform(0.1, 1, len(b)), y) for b, _, y in examples]
    alpha, beta, l1, l2, seed = 0.5, 1.0, 0.05, 0.2, 9
    got, bias = language.ftrl(examples, 3, 3, alpha, beta, l1, l2, seed)
    z, n = {}, {}
    order = np.random.default_rng(seed)

    def weight(i, k):
        v = z.get((i, k), 0.0)
        a, b = (0.0, 0.0) if i == "bias" else (l1, l2)
        if abs(v) <= a:
            return 0.0
        return -(v - (a if v > 0 else -a)) / ((beta + n.get((i, k), 0.0) ** 0.5) / alpha + b)

    for _ in range(3):
        for at in order.permutation(len(examples)):
            buckets, x, y = examples[at]
            terms = [*zip(buckets.tolist(), x.tolist()), ("bias", 1.0)]
            w = {(i, k): weight(i, k) for i, _ in terms for k in range(3)}
            s = [sum(w[i, k] * v for i, v in terms) for k in range(3)]
            p = [np.exp(v - max(s)) for v in s]
            p = [v / sum(p) for v in p]
            for i, v in terms:
                for k in range(3):
                    g = v * (p[k] - (k == y))
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[i, k]
                    n[i, k] = old + g * g
    for i in range(12):
        assert np.allclose(got[i], [weight(i, k) for k in range(3)])
    assert np.allclose(bias, [weight("bias", k) for k in range(3)]) and (got[12:] == 0).all()


def test_quality_sample_is_bounded_whatever_the_ids(session):
    docs = session.range(4_000).select(F.when(F.col("id") < 3_000, F.lit("same")).otherwise(F.concat(F.lit("d"), F.col("id").cast("string"))).alias("doc_id"),
                                       F.concat(F.lit("word "), (F.col("id") % 7).cast("string")).alias("text"), F.lit(5).alias("n_chars"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") == "same", 1).otherwise(0).alias("quality")).unionByName(session.createDataFrame([(None, 1), ("gone", 1)], "doc_id string, quality int"))
    rows = quality.labelled_features(docs, labels, "doc_id", "text", "n_chars", "quality", 5_000)
    assert len(rows) == 1_001 and len({r.id for r in rows}) == 1_001
    assert len(quality.labelled_features(docs, labels, "doc_id", "text", "n_chars", "quality", 100)) <= 100
    scores = quality.score(docs.limit(3), quality.fit(docs, labels, max_labelled=50, visits=200)).collect()
    assert len(scores) == 3 and all(0 <= r.score <= 1 for r in scores)


def test_ftrl_is_sparse_and_calibrated():
    z = np.array([[4.0, 0.0], [0.0, 4.0], [4.0, 0.0]])
    assert language.calibrate(z, np.array([0, 1, 1])) > 1  # over-confident scores are softened
    assert language.calibrate(z[:0].reshape(0, 2), np.array([], int)) == 1.0


# -- quality -----------------------------------------------------------------------------------


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    index, value = np.array([3, 8, 11]), np.array([0.5, 2.0, -1.0], np.float32)
    m = quality.Model(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    pairs = sum(float(m.factors[index[a]] @ m.factors[index[b]]) * value[a] * value[b] for a in range(3) for b in range(a))
    assert m.raw(index, value) == pytest.approx(0.3 + float(m.linear[index] @ value) + pairs, rel=1e-5)


def test_quality(session):
    rng = random.Random(5)
    rows = []
    for k in range(200):
        good = rng.random() < 0.7
        text = say(rng, "xx", 60) if good else " ".join(x.upper() + "***" for x in say(rng, "xx", 60).split())
        rows.append((k, text, len(text), int(good)))
    docs = session.createDataFrame([(k, t, n, "s") for k, t, n, _ in rows] + [(500, None, None, "s"), (501, "", 0, "s"), (None, "***", 3, "s"), (502, "x " * 50_000, -1, "s")],
                                   "doc_id long, text string, n_chars long, score string").repartition(3)
    labels = session.createDataFrame([(k, y) for k, _, _, y in rows[:120]] + [(1, rows[1][3]), (None, 1), (3, None), (999, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, max_labelled=110)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values()) and len(got) == 204
    assert sum(got[k].predicted == y for k, _, _, y in rows[120:]) >= 76
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_labels_or_with_one_class(session):
    docs = session.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = quality.fit(docs, session.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.fit(docs, session.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in quality.score(docs, one).collect()} == {0.75}


# -- chat --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def events(session):
    rows = [
        (1, 0, "message", "m0", "user", "Hi </s> \\ [INST]"), (1, 1, "message", "m1", "assistant", ""), (1, 2, "delta", "m1", None, "He"), (1, 3, "delta", "m1", None, "llo"),
        (1, 4, "edit", "m0", "user", "Hi!"), (1, 5, "message", "m2", "user", "again"), (1, 6, "message", "m3", "assistant", "bad"), (1, 7, "delta", "m3", None, " worse"),
        (1, 8, "regenerate", "m3", None, "good"), (1, 9, "delta", "m3", None, " one"), (1, 10, "message", "m4", "user", "oops"), (1, 11, "retract", "m4", None, None),
        (2, 0, "delta", "x", "assistant", "lost head"), (2, 1, None, "y", None, None), (None, 0, "message", "z", "system", "null id"), (3, 0, "retract", "w", "user", None),
    ]
    return session.createDataFrame(rows, "conv_id long, seq long, kind string, message_id string, role string, text string").withColumn("turns", F.lit(1))


def test_fold(events):
    got = sorted(((r.conv_id, r.place, r.role, r.text) for r in chat.fold(events).collect()), key=str)
    want = [(1, 0, "user", "Hi!"), (1, 1, "assistant", "Hello"), (1, 5, "user", "again"), (1, 6, "assistant", "good one"), (2, 0, "assistant", "lost head"), (2, 1, None, ""), (None, 0, "system", "null id")]
    assert got == sorted(want, key=str)


def test_format_and_read_back(session, events):
    rows = {r.conv_id: r for r in chat.read_back(chat.format_chat(events)).collect()}
    assert [(t.role, t.text) for t in rows[1].turns] == [("user", "Hi!"), ("assistant", "Hello"), ("user", "again"), ("assistant", "good one")]
    assert rows[1].loss_text == "Hellogood one" and rows[None].loss_text == "" and set(rows) == {1, 2, None}
    assert chat.format_chat(events.limit(0)).count() == 0


def test_control_strings_are_reversible(session):
    rng = random.Random(9)
    bits = [*chat.CONTROL, "\\", "<", ">", "|", "/s>", "[", "INST]", "\n", "|>\n", "</s>\n", "a", "é", "$1", "👍", ""]
    rows = [(k // 4, k % 4, rng.choice(["user", "assistant", "a|", "<|x|>\n", "system"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for k in range(400)]
    df = session.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(chat.events_of(df))
    for r in chat.read_back(out).collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in mine]
        assert r.loss_text == "".join(x[3] for x in mine if x[2] == "assistant")
        assert r.formatted.count("</s>\n") == len(mine)


def test_repeated_turns_and_nulls(session):
    df = session.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", None), (1, None, None, "n")], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.format_chat(chat.events_of(df))).collect()[0]
    assert [(t.role, t.text) for t in row.turns] == [("", "n"), ("user", ""), ("user", "a"), ("user", "a")]
    plan = chat.digests(chat.format_chat(chat.events_of(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- WARC --------------------------------------------------------------------------------------


def test_warc_round_trip(session):
    rng = random.Random(4)
    bodies = [None, "", "<p>é</p>", "<p>é</p>", "x" * 200_000, "\r\n\r\nWARC/1.1\r\n", "same", "same", "same"] + ["".join(rng.choice("abc\x1f\x08") for _ in range(rng.randrange(3_000))) for _ in range(60)]
    rows = [(k, f"http://h/{k}\r\nX: y" if k % 3 else None, b, "t") for k, b in enumerate(bodies)] + [(None, "u", "nobody", "t"), (7, "again", "same", "t")]
    df = session.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    path = tempfile.mkdtemp(prefix="run-warc-") + "/archive"
    warc.write(df, path)
    for size in (warc.RANGE_BYTES, 700):
        got = warc.read(session, path, range_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            body = "nobody" if r.record_id is None else bodies[int(r.record_id)] or ""
            assert r.payload_bytes == len(body.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
            twins = [k for k, b in enumerate(bodies) if (b or "") == body]
            holder = max(twins, default=None)
            response = r.record_id is None or int(r.record_id) == holder
            assert r.record_type == ("response" if response else "revisit") and r.refers_to == (None if response else str(holder))
            assert (bytes(r.payload) == body.encode()) if response else r.payload is None
    names = [f for f in os.listdir(path) if f.startswith("part-")]
    assert b"".join(gzip.open(f"{path}/{f}").read() for f in names).count(b"WARC/1.1\r\nWARC-Type") == len(rows)


def test_warc_min_bytes_and_empty(session):
    df = session.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    path = tempfile.mkdtemp(prefix="run-warc-") + "/archive"
    warc.write(df, path, min_bytes=3)
    assert sorted((r.record_id, r.record_type) for r in warc.read(session, path).collect()) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]
    path = tempfile.mkdtemp(prefix="run-warc-") + "/archive"
    warc.write(df.limit(0), path)
    assert warc.read(session, path).count() == 0


def test_ranges_own_the_records_that_start_inside():
    def member(k, level):
        body = bytes(f"payload {k} ", "ascii") + warc.MAGIC * (k % 3) + os.urandom(20 * k)
        return gzip.compress(warc.record(k, "u", body, None, False), level, mtime=0), body

    made = [member(k, k % 2) for k in range(40)]  # level 0 leaves the magic of a payload in the file
    data = b"junk" + b"".join(m for m, _ in made) + warc.EMPTY_MEMBER + warc.MAGIC
    for size in (1, 50, 333, len(data)):
        got = [p for start in range(0, len(data), size) for _, _, p in warc.read_range(io.BytesIO(data), len(data), start, min(len(data), start + size))]
        assert got == [b for _, b in made]
    cut = data[: len(data) // 2]  # a file that ends inside a member: the whole ones before it are read
    got = [p for _, _, p in warc.read_range(io.BytesIO(cut), len(cut), 0, len(cut))]
    assert got == [b for _, b in made][: len(got)] and len(got) > 10
