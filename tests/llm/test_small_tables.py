"""Neighbours in tables so small that no graph links their clusters."""

import numpy as np
import pytest

from siftline.llm import ann


@pytest.mark.parametrize("n", [36, 64, 300])
def test_two_far_clusters(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 0.01, (n, 8))
    x[: n // 2, 0] += 1
    x[n // 2 :, 0] -= 1
    x = x[rng.permutation(n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.top_neighbours(df, df, k=10).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = np.sort(s, 1)[:, ::-1][:, 9]
    assert len(got) == 10 * n and (got.score >= want[got.query_id] - 1e-9).mean() >= 0.95
