"""Texts of several chunks through operators that read them in chunks, and odd rows through the pipeline's stages."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import kernel, langid, ngram_join, quality, resampling, spelling


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["w%d" % r.randrange(90_000) for _ in range(420_000)]
    near = list(words)
    for i in range(0, len(near), 4000):
        near[i] = "changed"
    far = ["v%d" % r.randrange(90_000) for _ in range(420_000)]
    out = {1: " ".join(words), 2: " ".join(near), 3: " ".join(far), 4: "w1 w2 w3 w4 w5 w6"}
    assert len(out[1]) > kernel.CHUNK_BYTES
    return out


def test_near_copies(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, k=3, num=90, den=100).collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in texts.items())}
    assert got == {1: (len(sets[1]), 1), 2: (len(sets[2]), 1), 3: (len(sets[3]), 3), 4: (len(sets[4]), 4)}


def test_words_and_weights(spark, texts):
    df = spark.createDataFrame([(i, t.replace("w1", "wordone").replace("v1", "wordtwo")) for i, t in texts.items()], "doc_id long, text string")
    total = {}
    for r in df.collect():
        for w in r.text.split():
            letters = "".join(c for c in w if c.isalpha())
            total[letters] = total.get(letters, 0) + 1
    got = {r.word: r.n for r in spelling.spelling_variants(df).collect()}
    assert got == {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    bench = spark.createDataFrame([("w1 w2",)], "text string")
    sizes = {r.doc_id: (r.n_words, r.n_features) for r in resampling.resample(df, bench, most=3).collect()}
    assert sizes == {i: (n, 3 * n - 3) for i, n in ((1, 420_000), (2, 420_000), (3, 420_000), (4, 6))}


def test_language_and_quality(spark, texts):
    net = langid.Network(["aa", "bb"], np.random.default_rng(5))
    df = spark.createDataFrame([*texts.items(), (5, texts[1][:2000])], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, net).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(r.lang_pred in ("aa", "bb") and 0 <= r.score <= 1 for r in got.values())
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(["good", "fine", "text"] if i % 2 else ["spam", "buy", "now"], k=30)), i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("lot", quality.lot(F.col("text")))
    scorer = quality.train(labelled, "text", "quality", quality.word_vectors(labelled), "lot")
    many = spark.createDataFrame([(1, "good fine text " * 300_000), (2, "spam buy now " * 300_000), (3, "good fine text"), (4, None)], "doc_id long, text string")
    found = {x.doc_id: x.score for x in quality.score(many, scorer).collect()}
    assert found[1] > 0.8 and found[2] < 0.2 and all(0 <= s <= 1 for s in found.values()) and len(found) == 4


def test_odd_rows_through_the_stages(spark, tmp_path):
    """Nulls in any column, blank and repeated rows: each stage keeps or drops them as its docstring says, and none crashes."""
    r = random.Random(2)
    line = lambda: " ".join(r.choices(["the", "house", "with", "bright", "shore"], k=9)) + " %d" % r.randrange(10**6)
    rows = [(i, "\n".join(line() for _ in range(6)), "en", "s", 1) for i in range(40)]
    rows += [rows[3], rows[3], (None, rows[5][1] + "\nmore", None, None, None), (None, None, None, None, None), (50, " \n\t", "en", None, 3), (50, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, "nothing of the kind at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        ids = [x.doc_id for x in docs.collect()]
        assert set(range(40)) <= set(ids) and 50 not in ids, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
