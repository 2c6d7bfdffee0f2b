"""Operators that avoid pairing or collecting whole groups, against plain versions of themselves."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import scalars as S
from siftline.operators import experience as E
from siftline.operators import findings as O
from siftline.operators import history as H
from siftline.operators import rounds as R


@pytest.mark.parametrize("seed", range(3))
def test_best_patterns_of_all_pairs(spark, seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(14)]
    path = lambda: "/".join([*r.choices(["a", "b", "c"], k=r.choice([0, 1, 2])), r.choice(["x.py", "y.js", "z"])])
    some = lambda: r.choice([None, "", " ".join(r.choices(words, k=r.choice([1, 3, 8])))])
    patterns = [(r.choice("pq"), f"k{i}", some(), path(), i) for i in range(25)]
    issues = [(i, r.choice("pqr"), path(), some()) for i in range(60)]
    p = spark.createDataFrame(patterns, "type string, pattern string, code_before string, files string, place int")
    x = spark.createDataFrame(issues, "id int, type string, file string, description string")
    every = x.join(p, "type").withColumn("a", S.tokens(F.coalesce("description", F.lit("")))).withColumn("b", S.tokens(F.coalesce("code_before", F.lit(""))))
    shared = F.size(F.array_intersect("a", "b"))
    code = F.when((F.size("a") > 0) & (F.size("b") > 0), shared / (F.size("a") + F.size("b") - shared)).otherwise(0.0)
    every = every.withColumn("score", 0.4 * E.path_share(F.col("files"), F.col("file")) + 0.6 * code)
    want = {}
    for row in every.select("id", "pattern", "place", "score").collect():
        if row.score >= 0.3 and (row.id not in want or (row.score, -row.place) > want[row.id][:2]):
            want[row.id] = (row.score, -row.place, row.pattern)
    got = {row.id: (row.pattern, row.score) for row in E.best_patterns(x, p).collect()}
    assert got == {k: (v[2], v[0]) for k, v in want.items()} and len(got) > 20


def test_last_rows_of_each_key_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("ord"))
    plan = H.tail(df, 5, ["ord"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [k" in plan and "Partial" in plan


def test_running_sums(spark):
    rows = [(k, i, None if i % 7 == 0 else i) for k in ("a", None) for i in range(30)]
    got = H.running_sum(spark.createDataFrame(rows, "k string, ord long, v long"), ["k"], "v", "ord", width=4).where("k = 'a'").orderBy("ord").collect()
    total = n = 0
    for r in got:
        total, n = total + (r.v or 0), n + (r.v is not None)
        assert (r.total, r.samples) == (total, n)
    assert len(got) == 30


def test_failures_and_missing_agents(spark):
    rows = [("a", False, 5, "late", 3), ("a", False, None, "early", 1), ("a", False, 5, "late", 0), ("a", None, 5, "", 9), ("b", True, 7, "no", 2), (None, False, 1, "x", 1)]
    got = {r.agent: (r.tasks, r.successes, r.failures) for r in R.capabilities(spark.createDataFrame(rows, "agent string, success boolean, tokens int, failure string, ord int")).collect()}
    assert got == {"a": (4, 0, "late, early"), "b": (1, 1, ""), None: (1, 0, "x")}


def test_bodies_of_headers(spark):
    text = "def test_a():\n    x\n\n    y\nz\ndef test_b():\ndef test_c():\n  pass"
    lines = O.source_lines(spark.createDataFrame([("f", text), ("g", "def test_d():"), ("h", None)], "file string, text string"), "file", "text")
    got = {(r.file, r.line_no): list(r.body) for r in O.opening(lines, r"^def test_", 51).collect()}
    assert got == {("f", 1): ["x"], ("f", 6): ["def test_c():", "pass"], ("f", 7): ["pass"], ("g", 1): []}
