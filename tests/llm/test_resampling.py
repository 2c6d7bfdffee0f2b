"""Importance resampling against plain loops, and suffix arrays against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftline.llm import resampling

SCHEMA = "doc_id long, text string, score double, range int, doc string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, most, buckets, percent, least, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in rows for g in grams(x, most)), Counter(bucket(g) for x in target for g in grams(x, most))
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in range(buckets)]
    out = []
    for i, x in rows:
        g = grams(x, most)
        weight = sum(gain[bucket(k)] for k in g)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), 0])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[5] = k + 1
    return sorted((str(i), *rest) for i, *rest in out)


def corpus(seed=2):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(70)] + ["É", "ß9", "Abc", "日本"]
    out = [r.choice([" ", ", ", "\n", "_"]).join(r.choices(vocabulary, k=r.choice([1, 5, 19, 20, 40, 200]))) for _ in range(120)]
    return out + [None, "", " .,;", "x", "same " * 50, "A-b_c" * 30]


@pytest.mark.parametrize("most,buckets,percent,chunk", [(1, 10_000, 10, 2 << 20), (2, 50, 33, 2 << 20), (3, 1000, 100, 64), (5, 97, 50, 10)])
def test_against_loops(spark, monkeypatch, most, buckets, percent, chunk):
    """Also with texts cut into parts of a few bytes, and ranges of few documents."""
    monkeypatch.setattr(resampling, "CHUNK_BYTES", chunk)
    given = list(enumerate(corpus()))
    given += [given[7], given[7], (None, given[9][1]), (None, None)]
    target = corpus(5)[:15] + [None, ""]
    df = spark.createDataFrame([(i, t, 0.5, 3, "z") for i, t in given], SCHEMA).repartition(4)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = sorted((str(r.doc_id), r.n_words, r.n_features, r.weight, r.score, r["rank"] or 0) for r in resampling.resample(df, bench, most=most, buckets=buckets, percent=percent).collect())
    assert got == brute(given, target, most, buckets, percent, 20, 2024)


def test_prefers_the_target(spark):
    r = random.Random(9)
    like, other = ["t%d" % i for i in range(40)], ["o%d" % i for i in range(40)]
    rows = [(i, " ".join(r.choices(like if i % 10 == 0 else other, k=60))) for i in range(300)]
    bench = spark.createDataFrame([(" ".join(r.choices(like, k=200)),)], "text string")
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), bench).where("rank IS NOT NULL").collect()
    assert len(got) == 30 and all(x.doc_id % 10 == 0 for x in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "a " * 30, None, None, None)], SCHEMA)
    assert resampling.resample(none, one).count() == 0
    got = resampling.resample(one, none, percent=100).collect()
    assert [(r.doc_id, r.n_words, r["rank"]) for r in got] == [(1, 30, 1)]


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 7])
def test_suffix_array(depth):
    r = random.Random(depth)
    docs = [[r.choice([b"a", b"b", b"c"]) for _ in range(k)] for k in (0, 1, 2, 9, 40)]
    flat = [w for d in docs for w in d]
    left = np.array([len(d) - i for d in docs for i in range(len(d))])
    s = resampling.Suffixes(flat, left, depth)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    suffix = [[numbers[w] for w in flat[i : i + min(left[i], depth)]] for i in range(len(flat))]
    assert sorted(s.order.tolist()) == list(range(len(flat)))
    in_order = [suffix[i] for i in s.order]
    assert in_order == sorted(suffix)
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert s.lcp.tolist() == [0] + [shared(a, b) for a, b in zip(in_order, in_order[1:])]
    place, bucket = s.buckets(depth, 10**6)
    assert dict(zip(place.tolist(), bucket.tolist())) == {i: zlib.crc32(b" ".join(flat[i : i + depth])) % 10**6 for i in range(len(flat)) if left[i] >= depth}
