"""The near-duplicate stage on null and repeated ids."""

import corpus_pipeline


def test_null_and_repeated_ids(spark, tmp_path):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (1, text("a")), (None, text("a") + " x"), (None, text("a")),  # near copies without id
        (5, text("b")), (5, text("b")),  # a repeated row
        (7, text("c")), (7, text("a") + " y"),  # one id, one of its rows a near copy
        (None, text("d")), (None, text("d") + " x"),  # no id at all
        (8, text("e")), (9, ""), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:1]) for r in got) == [("1", "a"), ("5", "b"), ("7", "c"), ("8", "e"), ("9", ""), ("None", ""), ("None", "d")]
