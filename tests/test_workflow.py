"""Operators of rounds, experience, issues and sources on small fixtures, with the odd cases."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from siftline.operators import experience as E
from siftline.operators import findings as O
from siftline.operators import issues as I
from siftline.operators import rounds as R
from siftline.plans import bindings, workflow
from siftline.sources import readers, tools


def test_rules_that_look_ahead(spark):
    text = "def test_a():\n    # later\n    pass\nx = 1\ndef test_b():\n    f()\n    return\n        y()\nclass C:\n    z = 1\ndef _hidden():\n    a = 1\ndef shown():\n    '''doc'''\nimport os, sys\nfrom m import thing\nthing()\nthing()\n"
    lines = O.source_lines(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "file string, text string"), "file", "text")
    at = lambda df: sorted(r.line for r in df.where("file = 'a'").collect())
    assert at(O.empty_tests(lines)) == [1] and at(O.missing_asserts(lines)) == [1, 5] and at(O.missing_docstrings(lines)) == [1, 5, 9]
    assert at(O.unreachable(lines)) == [8] and at(O.unused_import_lines(lines)) == [15]
    assert O.all_dimensions(lines.limit(0)).count() == 0


def test_patterns_and_keys(spark):
    rows = [(1, "t", "a/b/c/d.py", "line 5 of /x/y.py", "f1", True, 0.9, "abc", "z", 1), (2, "t", "a/b/e.py", "other", "f2", True, 0.5, "abc", None, 2), (3, "t", None, "", "f", True, 0.9, "", "", 3), (4, "t", "q", "act", "f", False, 0.9, "", "", 4), (5, "u", "", "in line 77", None, True, 0.7, None, None, 5)]
    x = spark.createDataFrame(rows, "id long, type string, file string, action string, fixer string, success boolean, confidence double, code_before string, code_after string, ord long")
    got = {(r.type, r.pattern): r for r in E.fix_patterns(x).collect()}
    a = got["t", "__code__abc"]
    assert (a.successes, a.mean_confidence, a.fixer, a.code_after, a.files) == (2, 0.7, "f2", "z", "a/b/*") and got["u", "in line N"].fixer == "unknown" and len(got) == 2
    keys = x.select("id", E.file_pattern(F.col("file")).alias("p"), E.action_key(F.col("action")).alias("k")).collect()
    assert [r.p for r in keys] == ["b/c/*.py", "a/b/*.py", None, "**", "**"] and keys[0].k == "line N of <FILE>"
    files = spark.createDataFrame([("a", "x = 1\nx = 1", "x = 1", "x = 2"), ("b", "x", "x", "("), ("c", "x", "y", "z"), ("d", None, "x", "y"), ("e", "x", "", "y")], "file string, text string, code_before string, code_after string")
    assert {r.file: (r.text, r.applied) for r in E.apply_patterns(files).collect()} == {"a": ("x = 2\nx = 1", True), "b": ("x", False), "c": ("x", False), "d": (None, False), "e": ("x", False)}


def test_similar_items_by_rare_words(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the the the"), (3, None), (4, "a b c d e f"), (5, "cat sat")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the cat"), (2, "e f g"), (3, ""), (4, "the cat")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, round(r.score, 3)) for r in E.most_similar(docs, items, 0.3).collect()} == {(1, 1, 0.667), (2, 1, 0.5), (5, 1, 0.333)}


def test_best_candidates(spark):
    seven = "\n".join(["v = 1"] * 7)
    rows = [
        ("tie", 2, seven, 1, 3, "x = 1", 0.2), ("tie", 1, seven.replace("v", "w") + "\nw = 2\nw = 3", 1, 1, "x = 1", None), ("tie", 3, seven, 1, 1, "x = 1", -0.1),
        ("near", 1, "v = 1\nv = 1\nv = 1", 1, 1, "x = 1", 0.3), ("near", 2, "v = 1\nv = 1\nv = 1\nv = 1\nv = 1\nv = 1", 1, 2, "x = 1", 0.3),
        ("odd", 1, "v = 1", None, 1, "x = 1", 0.9), ("odd", 2, "v = 1", 1, 2, "x = 1", 0.9), ("odd", 3, "v = 1", 1, 1, "f(", 0.9), ("odd", 4, "v = 1", 1, 1, "v = 1", 0.9), ("odd", 5, "v = 1", 1, 1, "", 0.9),
        ("odd", 6, "v = 1", 1, 1, None, 0.9), ("odd", 7, None, 1, 1, "x = 1", float("nan")), ("odd", 8, "v = 1\n", 2, 2, "x = 1", None), ("none", 1, "v = 1", 0, 1, "x = 1", 0.9),
    ]
    x = spark.createDataFrame(rows, "issue string, ord long, text string, first int, last int, replacement string, confidence double")
    assert {r.issue: (r.ord, round(r.score, 6)) for r in I.best_candidates(x).collect()} == {"tie": (1, 0.694444), "near": (1, 0.483333), "odd": (8, 0.5)}


def test_best_candidates_that_tie(spark):
    # two equal scores whose doubles differ in the last bit, the smaller one first
    found = [(c, n, k) for n in (3, 4, 5, 6, 7) for k in (1, 2, 3) for c in range(1, 9) if k <= n]
    score = lambda c, n, k: 0.5 * (c / 10) + 0.5 * (1 - k / n)
    pair = next((a, b) for a in found for b in found if score(*a) < score(*b) and abs(score(*a) - score(*b)) < 1e-12)
    rows = [("bits", i, "\n".join(["v = 1"] * n), 1, k, "x = 1", c / 10) for i, (c, n, k) in enumerate(pair)]
    assert I.best_candidates(spark.createDataFrame(rows, "issue string, ord long, text string, first int, last int, replacement string, confidence double")).first().ord == 0


def test_chains_and_guards(spark):
    rows = [("a", "syntax", False, -0.3, 0), ("a", "rescan", True, 0.15, 1), ("b", "syntax", True, 0.05, 0), ("b", "rescan", False, -0.2, 1), ("b", "import", True, 0.1, 2)]
    got = {r.fix: (r.total_delta, r.passed, r.rollback, r.checks) for r in I.chain(spark.createDataFrame(rows, "fix string, name string, passed boolean, delta double, ord int"), ["fix"]).collect()}
    assert got == {"a": (-0.3, False, True, 1), "b": (-0.05, False, False, 3)}
    long = "x\n" * 12
    pairs = spark.createDataFrame([(1, long, ""), (2, "import a\nb", "b\nimport a"), (3, "import a", "import b"), (4, "x", None)], "id int, before string, after string")
    assert [r.w for r in pairs.orderBy("id").select(I.over_modified(F.col("before"), F.col("after")).alias("w")).collect()] == ["shrunk", None, "imports lost", None]
    assert [r.path for r in I.targets(spark.createDataFrame([], "path string, ord long")).collect()] == ["."]
    assert [r.path for r in I.targets(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "path string, ord long")).collect()] == ["b", "a"]


def test_rounds_without_rows(spark):
    none = spark.createDataFrame([], "round long, ord long, task string, approach string, result string, waste string")
    assert R.round_stats(none).first().overall_success_rate == 0 and R.delegation_diagnosis(none).first().delegate_success_rate == 1
    assert I.project_review(spark.createDataFrame([], "score int")).first().score == 100


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "z", 5), (2, "c", 7), (3, "d", 1), (3, "d", 1)], "id int, v string, at int")
    assert sorted((r.id, r.v) for r in readers.upsert(old, new, "id", "at").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_lint_output_that_is_broken(spark):
    x = spark.createDataFrame([(1, "not json"), (2, None), (3, "[]"), (4, '[{"code": "F401", "filename": "a.py", "row": 3}]')], "id int, text string")
    assert [(r.id, r.type, r.line) for r in tools.lint_findings(x).collect()] == [(4, "unused_import", 3)]


def test_written_state_is_replaced(spark, tmp_path):
    path = str(tmp_path / "state")
    readers.write_state(spark.createDataFrame([(1, "a")], "id int, v string"), path)
    readers.write_state(spark.createDataFrame([(2, "b")], "id int, v string"), path)
    assert [(r.id, r.v) for r in readers.json_or_empty(spark, path, "id int, v string").collect()] == [(2, "b")]


def test_entry_tells_missing_modules_from_broken_ones():
    import __spark_entry__ as entry

    assert not entry.present("siftline.nothing") and entry.present("siftline.plans")


def test_mean_of_rounds_in_any_order(spark, tmp_path):
    """A mean halfway between two thousandths, whose sum's last bits hang on the order of the rows in the files."""
    values = [70.51, 177.9, 153.65, 116.59, 84.89, 60.03, 177.47, 68.1]
    rows = [(i, datetime(2024, 1, 1, 0, 0, i), 7, "purchase", v) for i, v in enumerate(values)]
    got = {}
    for name, xs in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(xs, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        got[name] = workflow.text_reports(spark, f"{tmp_path}/{name}").first().digest
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/up/events.parquet/*.parquet')")
    assert got["up"] == got["down"] == con.execute(workflow.REPORT).fetchone()[1]
    timer = R.timer_totals(spark.createDataFrame([(1, 1, 0, None), (1, 2, 0, 0.5), (2, 1, 0, None)], "k int, round long, start int, seconds double"), "k").orderBy("k").collect()
    assert [tuple(r) for r in timer] == [(1, 2, 0.5, 0.5), (2, 1, None, None)]


def test_whole_snippets(spark, tmp_path):
    lines = [f"{i} " + "x" * 300 for i in range(9)]
    lines[4] = "print('a')" + " " * 700 + "# b"
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.line: r.snippet for r in bindings.context_snippets(spark, str(tmp_path)).collect()}
    assert got[5] == "\n".join(lines[1:8])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {(r[1], r[3]) for r in con.execute(bindings.ORACLES["context_snippets"]).fetchall()} == set(got.items())
