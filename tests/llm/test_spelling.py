"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from siftline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, length int"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def texts():
    r = random.Random(4)
    stems = ["".join(r.choices("abé", k=r.choice([4, 5, 6, 7]))) for _ in range(60)]
    out = []
    for _ in range(40):
        words = []
        for w in r.choices(stems, k=r.choice([1, 30, 120])):
            if r.random() < 0.3:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :], w[:i] + "a" + w[i:]])
            words.append(r.choice([w, w.upper().replace("É", "é"), w.capitalize().replace("É", "é")]))
        out.append(r.choice([" ", "-", "1", "’"]).join(words))
    return out + [None, "", "12 !?", "É" * 5 + " ×÷×÷× " * 3, "aaaaa", "mañana " * 4, "manana " * 9]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, misspell):
    n = Counter()
    for name, text in rows:
        for w in RUN.findall(text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if name is None else name}:{w}".encode())
            if misspell and h % misspell == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.mark.parametrize("misspell,rows_a_segment,piece,held", [(None, 4096, 4 << 20, 10**6), (5, 4096, 4 << 20, 10**6), (5, 3, 7, 4)])
def test_against_all_pairs(spark, monkeypatch, misspell, rows_a_segment, piece, held):
    """Also where nearly every segment is hot, and texts come in parts of a few bytes."""
    monkeypatch.setattr(spelling, "SEGMENT_ROWS", rows_a_segment)
    given = list(enumerate(texts()))
    given += [given[3], given[3], (None, given[5][1]), (None, None)]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in given], SCHEMA).repartition(3)
    if piece < 100:  # sizes that tasks read are set where the functions are pickled
        monkeypatch.setattr(spelling, "PIECE_BYTES", piece)
        monkeypatch.setattr(spelling, "HELD_WORDS", held)
    got, want = found(spelling.spelling_variants(df, misspell=misspell)), brute(given, misspell)
    assert got == want
    if misspell is None:
        assert any(f and f != r for _, f, r, *_ in want) and any(not f and k for _, f, _, _, k, _ in want)


def test_other_limits(spark):
    df = spark.createDataFrame([(1, "abc abd abd abcd ab ab ab ab")], "doc_id long, text string")
    got = found(spelling.spelling_variants(df, least_length=2, least_count=1, ratio=1))
    assert got == [("ab", "", "ab", 4, 2, 0), ("abc", "ab", "ab", 1, 3, 4), ("abcd", "abd", "ab", 1, 2, 2), ("abd", "ab", "ab", 2, 3, 4)]


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).count() == 0
