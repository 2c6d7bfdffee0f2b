"""The pipeline's stages on a small corpus, each against what it must decide."""

import random

import corpus_pipeline
from siftline.llm.common import word_count
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(spark, folder):
    r = random.Random(8)
    vocabulary = {"en": ["the", "house", "with", "thing", "shore", "bright"], "fr": ["été", "maison", "quelque", "aujourd", "çà", "étoile"]}
    item = " ".join("bench%d" % r.randrange(99) for _ in range(30))

    def text(lang, n=60):
        w = [r.choice(vocabulary[lang]) + str(r.randrange(10**6)) for _ in range(n)]
        return "\n".join(" ".join(w[i : i + 10]) for i in range(0, n, 10))

    rows = [(i, text("en" if i % 2 else "fr"), "en" if i % 2 else "fr", "s%d" % (i % 3)) for i in range(60)]
    shared = "\n".join(text("en", 30).split("\n"))
    rows += [(100, rows[1][1], "en", "s0")]  # exact copy: line dedup empties it
    rows += [(101, rows[3][1].replace("\n", " "), "en", "s0")]  # copy in other lines: near-duplicate stage
    rows += [(102, text("en") + "\n" + shared, "en", "s1"), (103, text("en") + "\n" + shared, "en", "s1")]
    rows += [(104, text("en") + "\n" + item, "en", "s1"), (105, None, "en", "s1"), (106, "123 456", "en", None)]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return shared


def test_stages(spark, tmp_path):
    shared = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = set(range(60)) | set(range(100, 107))
    for k, ((name, stage), gone) in enumerate(zip(corpus_pipeline.STAGES[:-1], ({105, 106}, {100}, {101}, {104}))):
        docs = stage(spark, docs, str(tmp_path)).persist()
        want -= gone
        rows = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == COLUMNS and set(rows) == want, name
        if k == 1:
            assert rows[102].text.endswith(shared) and shared not in rows[103].text and rows[103].n_chars == len(rows[103].text)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    total = docs.select(F.sum(word_count(F.col("text")))).first()[0]
    assert abs(mixed.agg(F.sum("taken")).first()[0] - 1.5 * total) <= 3
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "taken").collect())) == sorted(map(str, mixed.select("doc_id", "taken").collect()))


def test_empty_and_extra_columns(spark, tmp_path):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as score", "2 as text_hash", "3 as kept", "4 as lang_pred", "5 as root")
    for name, stage in corpus_pipeline.STAGES:
        for x in (docs, docs.limit(0)):
            out = stage(spark, x, str(tmp_path))
            assert out.count() <= x.count() and (name.startswith("mixing") or out.columns == docs.columns), name
