"""The pipeline against brute force, stage by stage, on tables with every awkward row."""

from __future__ import annotations

import hashlib
import random
import tempfile

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_duplicates import closure, plain_lines, prose
from test_near_copies import jaccard, shingle_set
from test_texts import plain_hits

from crosspanel.llm import bpe, quality
from crosspanel.llm.common import prepare

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_removed int"


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(12)
    items = [(k, prose(rng, 25)) for k in range(4)]
    rows, labels = [], []
    shared = "\n".join(prose(rng, 8) for _ in range(14))
    for k in range(90):
        bad = k % 9 == 0
        text = prose(rng, rng.randrange(60, 200))
        if k % 7 == 1:
            text += "\n" + shared
        if k % 11 == 2:
            text += " " + items[k % 4][1]
        if k % 13 == 3 and not bad and (k - 1) % 9:
            text = rows[-1][1]
        if k % 13 == 5 and not bad and (k - 1) % 9:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if bad:
            text = " ".join(w.upper() + "!!" for w in prose(rng, 80).split())
        rows.append((k, text, "en", "src0", len(text), 0.5, 1))
        labels.append((k, 0 if bad else 1, 0))
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "s", 0, 0.0, 0), (None, prose(rng, 90), "en", "s", 9, 0.0, 0), rows[20], (202, prose(rng, 9_000), "de", "s", -3, 1.0, 2)]
    out = tempfile.mkdtemp(prefix="run-pipeline-")
    prepare(spark)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels[:70], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "simhash", "decontaminate", "bpe"] and P.ORACLE_SQL is None

    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = stages["quality"](spark, docs, folder)
    assert good.schema == docs.schema
    want = [r for r in collected(docs) if model.score((r[1] or "").encode(), r[4]) >= 0.3]
    assert collected(good) == want and 60 < len(want) < 95
    assert not any("!!" in (r[1] or "") for r in want)

    unique = stages["lines"](spark, good, folder)
    assert unique.schema.names == docs.schema.names
    once = sorted({(r[0], r[1]) for r in want}, key=lambda x: (x[0] is not None, x[0]))  # rows that agree in id and text are one document
    kept = {(i, t): k for (i, t), (_, k, _, _) in zip(once, plain_lines(once))}
    assert sorted(((r[0], r[1]) for r in collected(unique)), key=str) == sorted(((r[0], kept[r[0], r[1]]) for r in want), key=str)
    assert all(r[4] in (old[4], len(r[1] or "")) for r in collected(unique) for old in want if old[0] == r[0])

    one = stages["simhash"](spark, unique, folder)
    rows, left = collected(unique), collected(one)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    text = {r[0]: r[1] for r in rows}
    sets = {i: shingle_set(text[i]) for i in ids}
    linked = closure([(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    stay = {r[0] for r in left if r[0] is not None}
    assert stay == {i for i in ids if linked.get(i, i) == i}
    assert len(left) == len(stay) + sum(r[0] is None for r in rows) and len(stay) < len(ids)

    clean = stages["decontaminate"](spark, one, folder)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    verdict = []
    for r in left:
        n, hit, _ = plain_hits(r[1], items, 13)
        verdict.append(not (hit and 20 * len(hit) >= n))
    assert collected(clean) == [r for r, ok in zip(left, verdict) if ok] and not all(verdict)
    assert clean.schema.names == docs.schema.names

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = stages["bpe"](spark, clean, folder)
    for r, row in zip(sorted(final.collect(), key=lambda r: str(r.doc_id)), sorted(clean.collect(), key=lambda r: str(r.doc_id))):
        want = np.array(other.encode_ordinary(row.text or ""), "<u4").tobytes()
        assert (bytes(r.ids), r.n_tokens, r.decoded_sha256) == (want, len(want) // 4, hashlib.sha256((row.text or "").encode()).hexdigest())
    assert sorted(map(str, (r.doc_id for r in P.run(spark, folder).select("doc_id").collect()))) == sorted(str(r[0]) for r in collected(clean))


def test_empty_tables(spark, folder):
    out = tempfile.mkdtemp(prefix="run-pipeline-")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{out}/{name}.parquet")
    assert P.run(spark, out).count() == 0
