"""Clashing column names, repeated rows and ids, ties, and plans that small tables don't take."""

import random

import numpy as np

from siftline.llm import ann, decontaminate, licenses, lines, lm, mixing, ngram_join, substring


def near_copies():
    r = random.Random(12)
    rows = []
    for g in range(12):
        words = ["g%dw%d" % (g, r.randrange(400)) for _ in range(60)]
        for i in range(r.choice([1, 2, 5])):
            copy = list(words)
            copy[r.randrange(60)] = "x%d" % i
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows), None), (len(rows) + 1, "")]


def test_join_without_broadcast(spark, monkeypatch):
    rows = near_copies()
    run = lambda df, **names: sorted(map(tuple, ngram_join.ngram_join(df, **names).select(names.get("id", "doc_id"), "n_shingles", "component_id").collect()))
    want = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(want) == len(rows) and len({c for *_, c in want}) < len(rows)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want
    clash = spark.createDataFrame([(i, t, 1, 2, "x", None) for i, t in rows], "cls long, token string, n int, th int, block string, places string")
    assert run(clash, id="cls", text="token") == want


def test_licences_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "Released under the MIT License.", "old", 3, "p")] * 3 + [(2, "nothing", "old", 4, "q"), (None, "Licensed under the MIT License.", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences string, sentence_ids int, parts string")
    got = licenses.scan(df)
    assert sorted(got.columns) == sorted(df.columns)
    assert sorted((str(r.doc_id), r.licences, r.parts) for r in got.collect()) == [("1", ["MIT"], "p")] * 3 + [("2", [], "q"), ("None", ["MIT"], None)]


def test_neighbours_of_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    rows = [(i, 0, "s", 1.0, 9, v.tolist()) for i, v in enumerate(x)] + [(5, 1, "s", 2.0, 9, (x[5] + 1).tolist())]
    df = spark.createDataFrame(rows, "id long, d int, shard string, score double, rank int, v array<double>")
    got = ann.top_neighbours(df, df.where("id % 20 = 0"), "id", "v", k=59).toPandas()
    x[5] = min(x[5].tolist(), (x[5] + 1).tolist())
    assert list(got.columns) == ["query_id", "rank", "vec_id", "score"] and len(got) == 3 * 59
    for q, g in got.sort_values("rank").groupby("query_id"):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(60), -s)) if i != q]
        assert list(g.vec_id) == want and np.allclose(g.score, s[want])


def test_lines_of_null_ids(spark):
    shared = "one\ntwo\nthree"
    rows = [(None, "n\n" + shared), (7, shared + "\nseven"), (3, "three first\n" + shared), (3, shared)]
    df = spark.createDataFrame([(i, t, 1, "h", 0) for i, t in rows], "doc_id long, text string, a int, at string, place int")
    got = [(r.doc_id, r.kept, r.n_removed) for r in lines.line_dedup(df).collect()]
    held = [(i, k) for i, k, n in got if n == 0]
    assert len(got) == 4 and len(held) == 1 and held[0][0] == 3
    assert (None, "n", 3) in got and (7, "seven", 3) in got


def test_first_of_equal_windows(spark):
    r = random.Random(2)
    item = " ".join("q%d" % r.randrange(90) for _ in range(30))
    rest = " ".join("w%d" % r.randrange(900) for _ in range(40))
    df = spark.createDataFrame([(1, f"{rest} {item} {rest} {item}", 1), (1, f"{rest} {item} {rest} {item}", 1), (2, rest, 1), (None, item, 2)], "doc_id long, text string, at int")
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, hits string")
    got = {(x.doc_id, x.item_id, x.at, x.similarity) for x in decontaminate.decontaminate(df, bench).collect()}
    assert got == {(1, 1, 40, 1.0), (None, 1, 0, 1.0)}
    assert [x.doc_id for x in decontaminate.drop_contaminated(df, bench).collect()] == [2]


def test_replaced_columns(spark):
    rows = [(1, "a b c d", 0, "k", 5), (2, "a b c e", 0, "k", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, KEPT string, block int")
    assert {r.doc_id: r.n_tokens for r in lm.lm_scores(df).collect()} == {1: 4, 2: 4, None: 0}
    got = {r.doc_id: (r.kept, r.block) for r in substring.substring_dedup(df, length=3).collect()}
    assert got == {1: ("d", 5), 2: ("e", 5), None: (None, None)}
    sizes = spark.createDataFrame([(1, "a b", "s", 1.0, 9), (1, "a b", "s", 1.0, 9), (None, None, None, None, None)], "doc_id long, text string, source string, finish double, bucket int")
    assert sorted(r.size for r in mixing.mix(sizes).collect()) == [0, 2, 2]
