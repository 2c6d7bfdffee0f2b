"""Lookups and chosen scans on small fixtures."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import findings as O
from siftline.operators import lookups as L


@pytest.mark.parametrize("line,want", [(1, "a\nb\nc\nd"), (4, "a\nb\nc\nd\ne\nf\ng"), (5, "b\nc\nd\ne\nf\ng\nh"), (8, "e\nf\ng\nh"), (11, "h"), (12, ""), (40, "")])
def test_code_window(spark, line, want):
    text = "a\nb\nc\nd\ne\nf\ng\nh"
    assert text.split("\n")[max(0, line - 4) : min(8, line + 3)] == (want.split("\n") if want else [])
    assert spark.range(1).select(L.code_window(F.lit(text), F.lit(line)).alias("w")).first().w == want
    assert spark.range(1).select(L.code_window(F.lit(None).cast("string"), F.lit(line)).alias("w")).first().w == ""


def test_severity_order_keeps_what_is_equal(spark):
    rows = [("low", 1), ("odd", 2), ("critical", 3), ("low", 0), (None, 5), ("high", 4)]
    assert [r.ord for r in L.by_severity(spark.createDataFrame(rows, "severity string, ord int")).collect()] == [3, 4, 0, 1, 2, 5]


CODE = "eval(x)\nip = '10.1.2.3'\n# TODO\nrequests.get(u)"


def test_chosen_scans(spark):
    files = spark.createDataFrame([("a", CODE), ("b", CODE), ("c", None)], "file string, text string")
    one = L.scan_one(files, "a")
    assert {r.file for r in one.collect()} == {"a"} and L.scan_one(files, "zz").count() == 0
    lines = O.source_lines(files, "file", "text")
    got = lambda dims: sorted((r.type, r.scanner) for r in L.scan_phase(lines, dims).where("file = 'a'").collect())
    assert got(["security"]) == [("dangerous_eval", "security_scanner")]
    assert got(None) == got([]) and len(got(None)) == 4
    assert got(["configuration"]) == [("hardcoded_ip", "configuration_scanner"), ("missing_timeout", "configuration_scanner")]
    plan = L.scan_phase(lines, ["security"])._jdf.queryExecution().optimizedPlan().toString()
    assert "requests" not in plan


def test_single_fixes(spark):
    issues = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "a")], "id int, type string")
    fixers = spark.createDataFrame([("f1", "a", 2), ("f0", "a", 5), ("g", "b", 0)], "fixer string, type string, reg int")
    results = spark.createDataFrame([(1, "f1", True, 0.9), (2, "f1", True, 0.6), (2, "f0", True, 1.0), (3, "g", True, 0.1), (5, "f1", False, 0.95)], "id int, fixer string, success boolean, confidence double")
    known = spark.createDataFrame([("b", "g", 9, 0.85), ("a", "f1", 2, 0.99)], "type string, fixer string, samples long, calibrated double")
    got = {r.id: (r.fixer, r.confidence, r.decision, r.applied) for r in L.single_fixes(issues, fixers, results, known).collect()}
    assert got == {1: ("f1", 0.9, "auto_apply", True), 2: ("f1", 0.6, "pending_review", False), 3: ("g", 0.85, "auto_apply", True), 4: (None, None, "no_fixer", False), 5: ("f1", 0.95, "rejected", False)}
    wild = fixers.union(spark.createDataFrame([("any", "*", 1), ("other", "*", 0)], fixers.schema))
    assert {r.id: r.fixer for r in L.single_fixes(issues, wild, results, known).collect()}[4] == "other"


def test_lookups(spark):
    bugs = spark.createDataFrame([("x", 2, "late"), ("x", 1, "first"), ("y", 0, "other")], "id string, ord int, note string")
    assert [r.note for r in L.bug(bugs, "x").collect()] == ["first"] and L.bug(bugs, "z").count() == 0
    tasks = spark.createDataFrame([("a",), ("b",), (None,)], "task_id string")
    assert sorted(str(r.task_id) for r in L.without(tasks, tasks.where("task_id = 'a'")).collect()) == ["None", "b"]


def test_metrics_files(spark, tmp_path):
    files = {"round-1.json": '{"timer": {"round_num": 4}, "summary": {"generated_at": "t", "last_round": 9},\n "tasks": {"summary": {"total": 3}}}', "round-2.json": '{"summary": {"last_round": 9}}', "round-3.json": "{broken", "other.json": "{}"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = [(r.path.rpartition("/")[2], r.round_num, r.timestamp, r.task_count) for r in L.metrics_files(spark, str(tmp_path)).collect()]
    assert got == [("round-1.json", 4, "t", 3), ("round-2.json", 9, None, 0)]
