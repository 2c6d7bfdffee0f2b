"""The two learned operators against plain loops: context vectors, pooling, convolution, averaging."""

import re

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import kernel, langid, quality

TEXTS = ["The cat, the dog; the cat", None, "", "  \n", "a", "### $$ a-b a-b", "É été là " * 30, "one two three four five six " * 40, "one two three four five six " * 40, "x" * 700]
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0d0-9A-Za-z\x80-\xff]+")


def hashed(words):
    """The operator's hash of each word, by itself."""
    out = []
    for w in words:
        buf = np.frombuffer(w, np.uint8)
        out.append(kernel.Hasher(True).hash_spans(buf, np.array([0]), np.array([len(w)]))[0])
    return out


def context_table(texts):
    table = {}
    for t in texts:
        words = TOKEN.findall((t or "").encode())
        rows = [int(h) >> 50 for h in hashed(words)]
        for i, row in enumerate(rows):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    for at, sign in quality.index_vectors(np.array(hashed(words[j : j + 1]), np.uint64)):
                        table.setdefault(row, np.zeros(quality.DIM))[at[0]] += sign[0]
    return {r: v / np.sqrt((v**2).sum()) for r, v in table.items() if v.any()}


def test_context_vectors(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, row string").repartition(3)
    got, want = quality.word_vectors(df), context_table(TEXTS)
    assert got.shape == (quality.ROWS, quality.DIM) and set(np.flatnonzero(got.any(1))) == set(want)
    for r, v in want.items():
        assert np.allclose(got[r], v, atol=1e-6)
    assert not quality.word_vectors(df.limit(0)).any()


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_pooled(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    vectors = np.random.default_rng(3).normal(size=(quality.ROWS, quality.DIM)).astype(np.float32)
    _, buf, offsets = next(kernel.chunks(pa.array(TEXTS)))
    got = quality.pooled(kernel.Hasher(True), buf, offsets, vectors)
    for t, row in zip(TEXTS, got):
        v = [vectors[int(h) >> 50].astype(float) for h in hashed(TOKEN.findall((t or "").encode()))]
        mean = sum(v, np.zeros(quality.DIM)) / max(len(v), 1)
        beside = sum((a * b for a, b in zip(v, v[1:])), np.zeros(quality.DIM)) / max(len(v) - 1, 1)
        assert np.allclose(row, [*mean, *(8 * beside), beside.sum(), np.sqrt((mean**2).sum()), np.log1p(len(v))], atol=1e-4)


def test_scores_with_a_fitted_scorer(spark):
    rows = [(i, ("good words here %d" if i % 2 else "bad ### junk $$$ %d") % i, float(i % 2), "s", 5) for i in range(400)] + [(900, None, None, "s", 5), (901, " ", 1.0, "s", 5), (902, None, None, None, None), (903, "good words here 7", 1.0, "s", 5), (903, "good words here 7", 1.0, "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y double, score string, vectors int")
    scorer = quality.train(df, "text", "y", quality.word_vectors(df))
    got = quality.score(df, scorer)
    assert got.columns == ["doc_id", "text", "y", "vectors", "score"] and got.count() == len(rows)
    found = {r.doc_id: r.score for r in got.collect()}
    assert all(0 <= s <= 1 for s in found.values()) and found[900] == found[901] == found[902]
    assert all((found[i] > 0.5) == bool(i % 2) for i in range(400)) and found[903] == pytest.approx(found[7], abs=0.2)


def test_convolution(spark):
    net = langid.Network(["aa", "bb", "cc"], np.random.default_rng(5))
    net.shift += np.random.default_rng(6).normal(0, 0.3, len(net.shift)).astype(np.float32)
    texts = ["Été à la mer", "PLAIN", "a", "123", None, "", "word " * 300, "ab" * 128, "ab" * 128, "x" * 257]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, net).collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        data = langid.lower(np.frombuffer(t.encode(), np.uint8)).tobytes()
        total = np.zeros(3)
        for at in range(0, len(data), langid.WINDOW):
            piece = data[at : at + langid.WINDOW]
            x = piece.ljust(langid.WINDOW, b"\0")
            pooled = [max(sum(float(table[x[p + j]][f]) for j, table in enumerate(tables)) for p in range(langid.WINDOW - len(tables) + 1)) for tables in net.tables for f in range(langid.FILTERS)]
            z = np.maximum(np.array(pooled) + net.shift, 0) @ net.out + net.bias
            e = np.exp(z - z.max())
            total += e / e.sum() * len(piece)
        total /= len(data)
        assert got[i].lang_pred == net.langs[int(total.argmax())] and got[i].score == pytest.approx(total.max(), abs=1e-4)
    assert langid.identify(df.limit(0), net).count() == 0


def test_copies_and_ties_of_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 150)
    rows = [("aa", "alpha beta gamma %d" % (i % 5)) for i in range(3000)] + [("bb", "zwölf übel größe %d" % i) for i in range(40)] + [(None, "zz"), ("aa", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    net = langid.train(df, "text", "lang")
    got = langid.identify(df, net).where("lang is not null and text is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.99
    assert got.groupby("text").score.nunique().max() == 1
