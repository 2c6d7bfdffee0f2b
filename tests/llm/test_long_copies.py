"""Mixing where a long copy is in service when virtual time ends."""

import math
import random
import time
from collections import Counter

import pytest

from siftline.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def corpus(seed, long):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 3, 40])), r.choice(["a", "b", "c", None])) for i in range(60)]
    return rows + [(100, "x " * long, "a"), (101, "y " * (long // 2), None), (None, "z z", "b"), (None, "z z", "b")]


def taken(rows):
    total = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        total[r.source] += r.taken
    return total


@pytest.mark.parametrize("seed,ranges,word_rows", [(1, 1 << 12, 4096), (1, 8, 5), (2, 4, 1), (3, 2, 7), (4, 64, 100)])
def test_every_source_is_served_to_its_target(spark, monkeypatch, seed, ranges, word_rows):
    """Also where the range in which the budget ends is parted again and again."""
    monkeypatch.setattr(mixing, "RANGES", ranges)
    monkeypatch.setattr(mixing, "WORD_ROWS", word_rows)
    got = mixing.mix(spark.createDataFrame(corpus(seed, 5000), SCHEMA).repartition(3)).collect()
    target = {r.source: r.target for r in got}
    assert taken(got) == {s: math.floor(t) for s, t in target.items()}
    assert any(0 < r.taken % r.size for r in got if r.size)  # a copy is cut


def test_a_long_copy_is_cut_without_a_row_a_word(spark, monkeypatch):
    made = []
    ranged = mixing.in_ranges
    monkeypatch.setattr(mixing, "in_ranges", lambda *a: (x := ranged(*a), made.append(x.count()))[0])
    began = time.time()
    got = mixing.mix(spark.createDataFrame(corpus(9, 3_000_000), SCHEMA)).collect()
    assert taken(got) == {r.source: math.floor(r.target) for r in got}
    assert max(made) < 20_000 and time.time() - began < 120
