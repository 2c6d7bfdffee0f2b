"""Fixes, projects, comments and run states on small cases."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import fixers as X
from siftline.operators import projects as P


@pytest.mark.parametrize(
    "kind,line,before,after",
    [
        ("swallowed_exception", 3, "try:\n    a()\nexcept E:\n    # why\n    pass\nb()", "import logging\ntry:\n    a()\nexcept E:\n    logging.exception('异常捕获: ')\n    # why\nb()"),
        ("bare_except", 3, "try:\n    a()\nexcept:\n    b()", "try:\n    a()\nexcept Exception:\n    b()"),
        ("print_used", 3, "import os\ndef f():\n    print(os.x, 1)", "import os\nimport logging\ndef f():\n    logging.info(os.x, 1)"),
        ("resource_not_managed", 1, "data = open(p).read()", "with open(p) as data:\n    data = data.read()"),
        ("missing_timeout_config", 2, "if a:\n    r = requests.get(u).json()", "if a:\n    r = requests.get(u, timeout=30).json()"),
        ("resource_not_managed", 2, "def g():\n    h = open(p, 'w')", "def g():\n    with open(p, 'w') as h:\n        pass"),
        ("resource_not_managed", 1, "use(open(p))", "with open(p) as f:\n    use(f)"),
        ("missing_return_type", 1, "def f(a,\n      b):\n    def g():\n        return 1\n    g()", "def f(a,\n      b) -> None:\n    def g():\n        return 1\n    g()"),
        ("missing_return_type", 2, "class C:\n    def f(self):\n        return 1", "from typing import Any\nclass C:\n    def f(self) -> Any:\n        return 1"),
        ("missing_return_type", 1, "def f(a): pass", "def f(a) -> None: pass"),
        ("missing_param_type", 2, "from typing import List\ndef f(self, a, b: int, c=(1, 2), *d): pass", "from typing import List, Any\ndef f(self, a: Any, b: int, c=(1, 2), *d): pass"),
        ("sync_sleep_in_async", 3, "import time\nasync def f():\n    time.sleep(2)", "import time\nimport asyncio\nasync def f():\n    await asyncio.sleep(2)"),
        ("unused_import", 1, "from a import b, c\nc()", "from a import c\nc()"),
        ("unused_import", 2, "import x\nimport y\nx()", "import x\nx()"),
        ("dead_code", 3, "def f():\n    return 1\n    a()\n    b()\nc()", "def f():\n    return 1\nc()"),
    ],
)
def test_fix(kind, line, before, after):
    text, done = X.fix_text(before, [(0, kind, line)])
    assert text == after and done[0][1]


@pytest.mark.parametrize("kind,line,text", [("bare_except", 1, "a = 1"), ("print_used", 9, "print(1)"), ("print_used", None, "print(1)"), ("sync_sleep_in_async", 2, "def f():\n    time.sleep(1)"), ("missing_timeout_config", 1, "requests.get()"), ("other", 1, "a"), ("dead_code", 1, "def ("), ("unused_import", 1, ""), ("print_used", 1, "print(1)\n" + "(" * 10000)])
def test_no_fix(kind, line, text):
    got, done = X.fix_text(text, [(0, kind, line)])
    assert got == text and not done[0][1]


def test_fix_files(spark):
    files = spark.createDataFrame([("a", "print(1)\nx = 1\nprint(2)"), ("b", None), ("c", "print(3)")], "file string, text string")
    issues = spark.createDataFrame([("a", "print_used", 1, 1), ("a", "print_used", 3, 2), ("a", "bare_except", 2, 3), ("b", "print_used", 1, 4)], "file string, type string, line int, ord int")
    row, = X.fix_files(files, issues).collect()
    assert (row.file, row.text, [r.success for r in row.results]) == ("a", "import logging\nlogging.info(1)\nx = 1\nlogging.info(2)", [True, True, False])


def test_lines_and_attempts(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("a",), (None,)], "t string")
    added, removed = X.lines_changed(F.col("t"), F.lit("x\ny"))
    assert [tuple(r) for r in df.select(X.replace_lines(F.col("t"), 2, 3, F.lit("z")), added, removed).collect()] == [("a\nz", 0, 1), ("a", 1, 0), (None, None, None)]
    tries = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, None), (2, 2, False)], "k int, o int, success boolean")
    assert sorted(map(tuple, X.first_success(tries, ["k"], ["o"]).select("k", "tried").collect())) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_blueprint(spark):
    rows = [("p", "src/a.py", "async def f(): pass"), ("p", "tests/test_a.py", "import flask"), ("p", "app.py", None), ("p", "node_modules/x.js", ""), ("p", ".hidden/y.js", ""), ("p", "web/z.ts", ""), ("p", "requirements.txt", "Flask"), ("p", "config.yaml", ""), ("q", "README.md", ""), (None, "m.c", "")]
    got = {r.project: r for r in P.blueprint(spark.createDataFrame(rows, "project string, path string, text string")).collect()}
    p, q = got["p"], got["q"]
    assert (p.primary, p.file_counts, p.total_files, p.frameworks, p.package_managers, p.has_tests) == ("python", {"python": 3, "typescript": 1}, 4, ["fastapi", "asyncio"], ["pip"], True)
    assert p.dimensions == ["asyncification", "configuration", "deadcode", "performance", "quality", "security", "testing"]
    assert (q.primary, q.total_files, q.file_counts, q.dimensions) == ("unknown", 0, {}, ["documentation"]) and got[None].primary == "other"


def test_batches(spark):
    paths = ["b.py", "a.py", "src/x.py", "src/Tests/y.py", "src/__pycache__/z.py", ".git/h.py", "src/n.txt", None]
    got = {r.module_dir: (r.files, r.is_test) for r in P.module_batches(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"(root)": (["a.py", "b.py"], False), "src": (["src/x.py"], False), "src/Tests": (["src/Tests/y.py"], True)}


def test_comment(spark):
    rows = [(1, "a", "low", 3, "d", "s", "x = 1", 1), (1, "b", "medium", 4, "e", "t", None, 2), (1, "a", "high", 5, "f", "u", "", 3), (2, "a", None, None, None, None, None, 4)]
    df = spark.createDataFrame(rows, "pr int, type string, severity string, line int, description string, suggestion string, code string, ord int")
    got = dict(map(tuple, P.review_comment(df, ["pr"], "# T").collect()))
    assert got[1] == "# T\n\n### ⚪ a\n\n- **L3** [low]: d\n  - 💡 s\n  - ```x = 1```\n- **L5** [high]: f\n  - 💡 u\n\n### 🟡 b\n\n- **L4** [medium]: e\n  - 💡 t\n"
    assert got[2].startswith("# T\n\n### ⚪ a\n\n- **L0** [low]: ") and "---" in got[2]


def test_run_states(spark):
    rows = [(1, "start", 0), (1, "phase", 1), (1, "phase", 2), (1, "succeed", 5), (1, "fail", 6), (2, "succeed", 0), (2, "cancel", 1), (2, "check", 2), (3, "start", 0), (3, "check", 1), (4, "start", 0), (4, "fail", 2)]
    df = spark.createDataFrame(rows, "run_id int, event string, n int").selectExpr("run_id", "event", "timestamp_seconds(n) AS at", "n AS ord", "CASE WHEN event = 'phase' THEN 'scan' END AS phase", "CAST(n AS DOUBLE) AS seconds", "'oops' AS error")
    got = {r.run_id: (r.state, r.duration_seconds, r.error, r.illegal, r.phase_timings) for r in P.run_states(df).collect()}
    assert got == {1: ("succeeded", 5.0, None, 1, {"scan": 2.0}), 2: ("cancelled", None, None, 1, {}), 3: ("running", None, None, 0, {}), 4: ("failed", 2.0, "oops", 0, {})}
