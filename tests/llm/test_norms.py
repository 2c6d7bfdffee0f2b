"""Neighbours by inner product whatever the norms: spread, outliers, overflowing squares, several shards and query blocks."""

import numpy as np
import pytest

from siftline.llm import ann


def recall(spark, x, rows, every=10, k=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.top_neighbours(df, df.where(f"vec_id % {every} = 0"), k=k).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:k]
        assert np.allclose(g.sort_values("rank").score, s[g.sort_values("rank").vec_id], rtol=1e-9, atol=0) and len(g) == k
        hits, total = hits + len(set(want) & set(g.vec_id)), total + k
    assert got.query_id.nunique() == -(-len(x) // every)
    return hits / total


def drawn(seed, n=4000, d=32):
    return np.random.default_rng(seed).normal(size=(n, d))


@pytest.mark.parametrize("case", ["one", "spread", "tiny", "two", "vast", "axis"])
def test_recall_whatever_the_norms(spark, case):
    x = drawn(1)
    if case == "one":
        x[7] *= 1e4
    if case == "spread":
        x *= 10 ** np.random.default_rng(2).uniform(-3, 3, (len(x), 1))
    if case == "tiny":
        x *= 1e-120
        x[3] = 1e-9
    if case == "two":
        x[::2] *= 1e6
    if case == "vast":
        x = np.concatenate([x[:2000] * 1e140, x[2000:] * 1e120])
    if case == "axis":
        x[:, 0] += 50  # a common part that all share
    assert recall(spark, x, len(x)) >= 0.9


def test_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    x = drawn(3, 2500, 16)
    x[::3] *= 1e5
    x[5] *= 1e9
    assert recall(spark, x, len(x)) >= 0.9
