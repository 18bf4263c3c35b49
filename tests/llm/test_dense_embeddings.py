"""Embeddings of which a third lie in one dense group, against brute force."""

from __future__ import annotations

import numpy as np

from crosspanel.llm import embeddings
from crosspanel.llm.common import prepare


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_links_inside_a_dense_group(spark):
    rng = np.random.default_rng(5)
    group = unit(unit(rng.normal(size=(1, 64))) + rng.normal(size=(1_000, 64)) * 0.0175)
    x = np.concatenate([group, unit(rng.normal(size=(2_000, 64)))])
    cosine = unit(x) @ unit(x).T
    want = (cosine >= 0.98).sum(1) - 1
    assert want.sum() > 100_000
    rows = [(k, [float(c) for c in v], "a") for k, v in enumerate(x)]
    df = prepare(spark).createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    got = {r.id: r.n_links for r in embeddings.near_duplicates(df, n_pivots=1_024).collect()}
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.9 * want.sum()
    print("RECALL", sum(got.values()) / want.sum())
