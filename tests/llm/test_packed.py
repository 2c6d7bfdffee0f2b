"""Packed integers come back as they were."""

import numpy as np
import pytest

from siftline.llm import packed

RARE = np.zeros(5000, np.int64)
RARE[[7, 4000]] = 300, 70000
CASES = [[], [0], [0, 0, 0], [1], [255], [256], [0, 256], [1 << 63, 0], [(1 << 64) - 1], RARE, np.arange(100000), np.random.default_rng(1).geometric(1e-6, 3000), np.random.default_rng(2).integers(0, 1 << 63, 500)]


@pytest.mark.parametrize("values", CASES, ids=range(len(CASES)))
def test_integers(values):
    x = np.array(values, np.uint64)
    assert np.array_equal(packed.unpack_ints(packed.pack_ints(x)), x)


def test_many_shapes():
    rng = np.random.default_rng(3)
    for _ in range(400):
        x = rng.integers(0, 1 << int(rng.integers(1, 63)), int(rng.integers(0, 60)), np.uint64) * (rng.random() < 0.5 or rng.integers(0, 2, 1, np.uint64)[0])
        if len(x) and rng.random() < 0.5:
            x[rng.integers(0, len(x))] = rng.integers(0, 1 << 62)
        assert np.array_equal(packed.unpack_ints(packed.pack_ints(x)), x)
        s = np.unique(x)
        if len(s):
            assert np.array_equal(packed.unpack_sorted(packed.pack_sorted(s)), s)
