"""Documents that share an id."""

from __future__ import annotations

import random

from test_duplicates import prose

from crosspanel.llm import simhash
from crosspanel.llm.common import prepare


def test_different_texts_with_one_id_stay(spark):
    rng = random.Random(4)
    a, b = prose(rng, 90), prose(rng, 90)
    docs = prepare(spark).createDataFrame([(1, a), (1, b), (1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(1, a), (1, b)])
