"""Very long texts through the operators, against the same work done plainly."""

import random
import time
from collections import Counter

import pytest

from siftline.llm import decontaminate, licenses, lines, lm, mixing, substring


def test_decontaminate_in_pieces(spark, monkeypatch):
    r = random.Random(4)
    item = ["q%d" % r.randrange(300) for _ in range(30)]
    words = ["w%d" % r.randrange(5000) for _ in range(900)]
    for at in (0, 85, 190, 300, 395, 870):
        words[at : at + 30] = item
    words[500:530] = item[:28] + ["x", "y"]
    texts = {1: " ".join(words), 2: " ".join(item), 3: " ".join(item[:27]), 4: " ".join(words[:100]), 5: " ".join(words[:129] + item[:26])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "q tiny"), (3, " ".join(words[600:612]))], "item_id long, text string")
    run = lambda: sorted(map(str, decontaminate.decontaminate(df, bench).collect()))
    want = run()
    assert len(want) >= 5
    monkeypatch.setattr(decontaminate, "LONG", 100)
    for step in (100, 37, 30):
        monkeypatch.setattr(decontaminate, "STEP", step)
        assert run() == want
    monkeypatch.setattr(decontaminate, "INLINE", 3)
    assert run() == want


def test_decontaminate_grows_with_the_length(spark):
    item = ["q%d" % i for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(item * 800))], "doc_id long, text string")
    start = time.time()
    got = decontaminate.decontaminate(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert len(got) == 1 and got[0].similarity == 1.0 and got[0].at == 0 and time.time() - start < 90


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(6)
    words = ["v%d" % r.randrange(60000) for _ in range(1_500_000)]
    words[1_000_000:1_000_040] = words[40:80]
    text = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    return words, spark.createDataFrame([(1, text), (2, " ".join(words[700_000:700_050])), (3, "Licensed under the MIT License.")], "doc_id long, text string").withColumn("source", __import__("pyspark").sql.functions.lit("s"))


def test_one_long_text(long):
    words, df = long
    got = {x.doc_id: x for x in substring.substring_dedup(df).collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed) == (1_500_000, 130, 50)
    scores = {x.doc_id: x for x in lm.lm_scores(df).collect()}
    assert scores[1].n_tokens == 1_500_000 and scores[2].lm_score > scores[1].lm_score
    assert {x.doc_id: x.n_lines for x in lines.line_dedup(df).collect()} == {1: 125_000, 2: 1, 3: 1}
    assert {x.doc_id: x.size for x in mixing.mix(df).collect()} == {1: 1_500_000, 2: 50, 3: 5}
    assert {x.doc_id: x.licences for x in licenses.scan(df).collect()} == {1: [], 2: [], 3: ["MIT"]}
    assert Counter(words)[words[0]] > 0
