"""Operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import scalars as S
from siftline.operators import findings as O
from siftline.operators import graphs as G
from siftline.operators import history as H
from siftline.operators.responses import issues, parse_responses
from siftline.operators.syntax import syntax_rules
from siftline.sources import readers

CODE = '''import os
import json
def load(q):
    cur.execute(f"select {q}")
    password = "hunter2hunter2"
    try:
        x = 1
    except:
        pass
    # TODO later
async def go():
    time.sleep(1)
    return eval("1")
def plain():
    time.sleep(2)
ip = "10.1.2.3:80"
requests.get(url)
requests.get(url, timeout=3)
'''


@pytest.fixture(scope="module")
def lines(spark):
    df = spark.createDataFrame([("a.py", CODE), ("test_b.py", "# TODO\nip = '1.2.3.4'"), ("c.py", None), ("d.py", "")], "file string, text string")
    return O.source_lines(df, "file", "text").persist()


def test_line_rules(lines):
    got = sorted((r.file, r.line, r.type) for r in O.scan_lines(lines).collect())
    assert got == [("a.py", 4, "sql_injection"), ("a.py", 5, "secret_leak"), ("a.py", 10, "todo_fixme"), ("a.py", 13, "dangerous_eval"), ("a.py", 16, "hardcoded_ip"), ("a.py", 17, "missing_timeout")]


def test_context_rules(lines):
    assert [r.line for r in O.after_header(lines, r"^async def ", r"time\.sleep\s*\(", "sync_sleep_in_async", "high").collect()] == [12]
    assert [r.line for r in O.empty_except(lines).collect()] == [8]
    assert sorted(r.line for r in O.missing_nearby(lines, r"^def ", '"""', 1, 3, "missing_docstring", "low").collect()) == [3, 14]


def test_syntax_rules(spark):
    df = spark.createDataFrame([("a.py", CODE), ("bad.py", "def ("), ("loop.py", "s = ''\nfor i in x:\n    s += 'a'\n"), ("n.py", None), ("deep.py", "(" * 10000 + "x")], "file string, text string")
    got = {(r.type, r.file, r.line) for r in syntax_rules(df).collect()}
    assert got == {("unused_import", "a.py", 1), ("unused_import", "a.py", 2), ("bare_except", "a.py", 8), ("swallowed_exception", "a.py", 8), ("loop_string_concat", "loop.py", 3)}


FIELDS = "type string, file string, line int, dimension string, severity string, ord long"


@pytest.mark.parametrize(
    "rows,n",
    [
        ([("a", "x.py", 1, "quality", "low", 1), ("b", "y.py", 2, "security", "low", 2)], 2),
        ([("bare_except", "a.py", 10, "quality", "low", i) for i in range(3)], 1),
        ([("e", "a.py", 10, "quality", "low", 1), ("e", "a.py", 11, "quality", "low", 2)], 1),
        ([("e", "a.py", 10, "quality", "low", 1), ("e", "b.py", 10, "quality", "low", 2)], 2),
        ([], 0),
        ([("e", "a.py", k, "quality", "low", k) for k in (10, 13, 16)], 1),
    ],
)
def test_clusters(spark, rows, n):
    assert O.clusters(spark.createDataFrame(rows, FIELDS)).count() == n


def test_cluster_of_line_zero(spark):
    rows = [("e", "a", k, "q", "low", k) for k in (0, 1, 2, 10, 14)]
    got = sorted((r.line, r.n) for r in O.clusters(spark.createDataFrame(rows, FIELDS), most=9).collect())
    assert got == [(0, 1), (1, 2), (10, 1), (14, 1)]


def test_buckets(spark):
    got = [r.b for r in spark.createDataFrame([(i,) for i in range(7)], "n int").select(S.bucket(F.col("n")).alias("b")).collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2]


@pytest.mark.parametrize("success,confidence,want", [(True, 0.8, "auto_apply"), (True, 0.79, "pending_review"), (True, 0.5, "pending_review"), (True, 0.49, "rejected"), (False, 0.9, "rejected")])
def test_gate(spark, success, confidence, want):
    assert spark.range(1).select(S.gate(F.lit(success), F.lit(confidence)).alias("g")).first().g == want


@pytest.mark.parametrize("cost,want", [(1.99, "green"), (2.0, "yellow"), (4.49, "yellow"), (4.5, "red")])
def test_tiers(spark, cost, want):
    assert spark.range(1).select(S.cost_tier(F.lit(cost)).alias("g")).first().g == want


@pytest.mark.parametrize(
    "text,n",
    [
        ('[{"type": "a", "line": 1}, {"type": "b"}]', 2), ('{"issues": [{"type": "a"}]}', 1), ('{"findings": []}', 0), ('{"type": "a"}', 1), ('[{"type": "a",}, {"type": "b"},]', 2),
        ('[{"type": "a"}] // done', 1), ('Look:\n```json\n[{"type": "a"}]\n```', 1), ('[{"type": "a"}, {"type": "b"}, {"ty', 2), ('{"type": "a"}\n{"type": "b"}', 2), ("no issues", 0), ("", 0), (None, 0),
    ],
)
def test_responses(spark, text, n):
    assert len(issues(text)) == n
    assert parse_responses(spark.createDataFrame([(1, text)], "response_id long, text string")).count() == n


def test_approvals_and_feedback(spark):
    ev = [("a", "queue", 1), ("a", "approve", 2), ("a", "reject", 3), ("b", "queue", 1), ("b", "reply", 2), ("b", "approve", 3), ("c", "approve", 1), ("d", "queue", 1), ("d", "reply", 2), ("d", "expire", 3)]
    df = spark.createDataFrame([(*e, e[2]) for e in ev], "id string, op string, at long, ord long")
    assert {r.id: r.status for r in H.approvals(df).collect()} == {"a": "approved", "b": "replied", "c": None, "d": "expired"}
    fb = [("k", "mark", 1), ("k", "mark", 2), ("j", "mark", 1), ("j", "mark", 2), ("j", "unmark", 3), ("j", "mark", 4), ("i", "mark", 1)]
    assert [r.key for r in H.suppressed(spark.createDataFrame([(*e, e[2]) for e in fb], "key string, op string, at long, ord long"), ["key"]).collect()] == ["k"]


def test_levels(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node int")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (9, 4)], "src int, dst int")
    assert {r.node: r.level for r in G.levels(nodes, edges).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 0}
    with pytest.raises(Exception, match="cycle"):
        G.levels(nodes, spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int")).collect()


def test_calibration_needs_samples(spark):
    df = spark.createDataFrame([("t", "f", True)] * 3 + [("t", "g", False)] * 2, "type string, fixer string, ok boolean")
    assert [(r.fixer, r.calibrated) for r in H.calibrate(df, ["type", "fixer"], "ok").collect()] == [("f", 0.99)]


def test_sources(spark, tmp_path):
    (tmp_path / "2024-01-02").mkdir()
    (tmp_path / "2024-01-02" / "r.jsonl").write_text('{"timestamp": "t", "level": "INFO"}\nnot json\n\n')
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "r.jsonl").write_text('{"timestamp": "u"}\n')
    got = readers.json_lines(spark, str(tmp_path)).collect()
    assert [(r.timestamp, str(r.date)) for r in got] == [("t", "2024-01-02")]
    src = tmp_path / "src" / "node_modules"
    src.mkdir(parents=True)
    (src / "x.py").write_text("a")
    (tmp_path / "src" / "y.py").write_text("b")
    assert [r.text for r in readers.source_files(spark, str(tmp_path / "src"), [".py"]).collect()] == ["b"]
    assert readers.json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0
    out = readers.mypy_lines(spark.createDataFrame([("a.py:3: error: Bad thing  [arg-type]",), ("a.py:4: note: x",)], "value string")).first()
    assert (out.file, out.line, out.message, out.code) == ("a.py", 3, "Bad thing", "arg-type")


def test_stream_matches_batch(spark, tmp_path):
    from siftline.streaming.windows import windowed_counts

    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0)]
    df = spark.createDataFrame(rows, "ts string, kind string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "kind")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, windowed_counts(df, "ts", "kind").collect()))
