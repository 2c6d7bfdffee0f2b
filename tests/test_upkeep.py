"""Graphs in one plan, JSON of unknown shape, logs and files within bounds, an index in segments."""

import datetime
import decimal
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import graphs as G
from siftline.operators import history as H
from siftline.operators import upkeep as U
from siftline.operators import variants as J


def graph(spark, nodes, edges):
    return spark.createDataFrame(nodes, "node long, fails boolean"), spark.createDataFrame(edges, "src long, dst long")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_a_chain_of_500_in_one_plan(spark):
    nodes, edges = graph(spark, [(i, False) for i in range(500)], [(i, i + 1) for i in range(600)])
    got = G.levels(nodes, edges)
    assert "UnionLoop" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.node: r.level for r in got.collect()} == {i: i for i in range(500)}


@pytest.mark.parametrize("edges", [[(0, 1), (1, 0)], [(0, 1), (1, 2), (2, 1)], [(3, 3)]])
def test_cycles(spark, edges):
    with pytest.raises(Exception, match="cycle"):
        G.levels(*graph(spark, [(i, False) for i in range(4)], edges)).collect()


def test_too_deep(spark):
    nodes, edges = graph(spark, [(i, False) for i in range(9)], [(i, i + 1) for i in range(8)])
    assert G.levels(nodes, edges, deepest=8).count() == 9
    with pytest.raises(Exception, match="too long"):
        G.levels(nodes, edges, deepest=7).collect()


def test_runs(spark):
    r = random.Random(5)
    nodes = [(i, r.random() < 0.08) for i in range(60)] + [(None, True), (4, False)]
    edges = [(a, b) for b in range(1, 60) for a in r.sample(range(b), min(b, r.choice([0, 1, 2])))]
    fails = {n for n, f in nodes if f and n is not None}
    level, status = {}, {}
    for i in range(60):
        deps = [a for a, b in edges if b == i]
        level[i] = max((level[a] + 1 for a in deps), default=0)
        status[i] = "blocked" if any(status[a] != "success" for a in deps) else "failed" if i in fails else "success"
    got = {x.node: (x.wave, x.status) for x in G.run_graph(*graph(spark, nodes, edges + edges[:5] + [(999, 3), (3, 999)])).collect()}
    assert got == {i: (None if status[i] == "blocked" else level[i], status[i]) for i in range(60)}
    assert len(set(status.values())) == 3
    none = graph(spark, [], [])
    assert G.run_graph(*none).count() == 0 and G.levels(*none).count() == 0


def test_candidates(spark):
    deep = "[" * 40 + "]" * 40
    texts = [
        '{"candidates":[{"replacement":"a","line_range":[1,2],"confidence":0.9,"explanation":"e"},{"replacement":"b"},"x",null,{"replacement":"c \\"NaN\\", Infinity","line_range":[3,4]}]}',
        ' [{"replacement":"a","line_range":[5,6],"confidence":NaN}] ',
        '{"candidates":[{"replacement":"-Infinity","line_range":[7,8],"confidence":-Infinity,"explanation":{"d":"2024-01-02","z":' + deep + "}}]}",
        '{"candidates":{"replacement":"a","line_range":[1,2]}}', '{"other":1}', "broken {", "7", "null", "", None, '{"candidates":[]}', "[]",
        '[{"replacement":["l1","l2"],"line_range":"3-4","confidence":"0.7"}]',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = [(r.k, r.n, r.first, r.last, r.replacement, r.confidence) for r in J.candidates(df, "text").orderBy("k", "n").collect()]
    assert got == [(0, 0, 1, 2, "a", 0.9), (0, 1, 3, 4, 'c "NaN", Infinity', 0.5), (1, 0, 5, 6, "a", 0.5), (2, 0, 7, 8, "-Infinity", 0.5), (12, 0, None, None, '["l1","l2"]', 0.7)]
    assert json.loads(J.candidates(df, "text").where("k = 2").first().explanation)["d"] == "2024-01-02"


def test_json_safe(spark):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5, 6)
    schema = "d double, f float, t timestamp, day date, b binary, m map<int,double>, s struct<x:double,y:array<timestamp>>, a array<array<double>>, n string, dec decimal(10,2), nt timestamp_ntz, iv interval day to second"
    row = (float("nan"), float("-inf"), when, datetime.date(2024, 2, 1), b"\x00a", {1: float("inf"), 2: 0.5}, (float("nan"), [when, None]), [[1.5, None], None], None, decimal.Decimal(3), when, datetime.timedelta(1))
    df = spark.createDataFrame([row, (None,) * 12], schema)
    one, two = [json.loads(r.j) for r in df.select(J.json_safe(df).alias("j")).collect()]
    at = "2024-01-02T03:04:05.000006"
    assert {k: one[k] for k in "d f t day b m s a n dec".split()} == {"d": None, "f": None, "t": at, "day": "2024-02-01", "b": "AGE=", "m": {"1": None, "2": 0.5}, "s": {"x": None, "y": [at, None]}, "a": [[1.5, None], None], "n": None, "dec": 3.0}
    assert isinstance(one["nt"], str) and isinstance(one["iv"], str) and set(two.values()) == {None} and len(two) == 12


FILES = [("b", 100, 10), ("a", 100, 20), ("c", 86_400 * 3, 30), ("d", 86_400 * 9, 40), ("e", None, 50), ("f", 86_400 * 9, 60)]


@pytest.mark.parametrize("free,all_old,want", [(1000, True, []), (10, True, [("a", 30), ("b", 40), ("c", 70)]), (10, False, [("a", 30), ("b", 40)]), (39, False, [("a", 59)])])
def test_retention(spark, free, all_old, want):
    files = spark.createDataFrame(FILES, "path string, mtime long, size long")
    got = sorted((r.path, r.free_after) for r in U.droppable(files, free, 86_400 * 11, need=40, all_old=all_old).collect())
    assert got == want


def test_newest(spark):
    files = spark.createDataFrame(FILES, "path string, mtime long, size long")
    assert tuple(U.newest(files, 86_400 * 11).first()) == ("f", 86_400 * 9, "d")
    assert tuple(U.newest(files.limit(0), 5).first()) == (None, None, None)


def test_files_are_listed_without_their_content(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.log").write_text("x" * (i + 1))
        os.utime(tmp_path / f"f{i}.log", (1000 + i, 1000 + i))
    files = U.file_table(spark, str(tmp_path))
    plan = U.newest(files, 2000)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert sorted((os.path.basename(r.path), r.mtime, r.size) for r in files.collect()) == [(f"f{i}.log", 1000 + i, i + 1) for i in range(3)]


def test_sized_log(spark, tmp_path):
    log, text, r = U.SizedLog(spark, f"{tmp_path}/log", 100, 2), [], random.Random(1)
    assert log.read().count() == 0
    for run in range(5):
        lines = [("é" * r.randrange(20), i) for i in range(30)]
        log.append(spark.createDataFrame([*lines, (None, 3)], "line string, i int"), "line", ["i"], F.floor(F.col("i") / 7))
        text += [x for x, _ in lines]
        start, want = 0, []
        for x in text:
            want.append((start // 100, start, x))
            start += len(x.encode()) + 1
        last = want[-1][0]
        assert [(x.segment, x.start, x.line) for x in log.read().orderBy("start").collect()] == [w for w in want if w[0] >= last - 2]
        sizes = [x.n for x in log.read().groupBy("segment").agg(F.sum("bytes").alias("n")).collect()]
        assert len(sizes) <= 3 and max(sizes) < 100 + 41
    assert len(log.table.epochs()) < 5
    log.append(spark.createDataFrame([], "line string, i int"), "line", ["i"], F.col("i"))


def test_index(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    v = lambda: [r.uniform(-1, 1) for _ in range(4)]
    rows, index, held = {i: v() for i in range(60)}, U.VectorIndex(spark, f"{tmp_path}/index"), {}
    df = lambda x: spark.createDataFrame(list(x.items()), "id long, v array<double>")
    state = lambda: {x.id: list(x.v) for x in index.live().collect()}
    assert state() == {}
    index.append(df({k: rows[k] for k in range(40)}))
    index.append(df({k: rows[k] for k in range(32, 60)}))
    new = {3: v(), 50: v()}
    index.append(df(new))
    index.remove(df({k: v() for k in (4, 50, 999)}))
    held = {k: x for k, x in {**rows, **new}.items() if k not in (4, 50)}
    assert state() == held and len(index.segments()) == 4
    asked = df({k: rows[k] for k in (0, 7)}).withColumnRenamed("id", "vec_id")
    search = lambda: sorted(map(tuple, H.top_inner_products(index.live().withColumnRenamed("id", "vec_id"), asked, "vec_id", "v").collect()))
    before = search()
    with monkeypatch.context() as m:  # a compaction that breaks off before its list is replaced
        m.setattr(index.state, "replace", lambda df: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.compact()
    assert state() == held
    index.compact()
    assert state() == held and search() == before and len(index.segments()) == 1 and len(index.table.epochs()) <= 2
    index.append(df({50: new[50]}))
    assert state() == {**held, 50: new[50]}
    index.rebuild(df({1: rows[1]}))
    assert state() == {1: rows[1]} and len(index.segments()) == 1
