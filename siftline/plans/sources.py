"""Code rules, taint folds and what other tools leave behind, bound to the driver's tables, each with its SQL."""

from pyspark.sql import functions as F

from .. import values as V
from ..operators import findings as O
from ..operators import issues as I
from ..sources import readers, tools
from . import bindings as B
from .bindings import query, t
from .workflow import choose, choose_sql

# ---- line rules over generated code: events play the lines of a user's file

SHAPES = [
    "def test_a():", "    pass", "    # later", "    assert x", "    x = 1", "", "def load(a):", '    """Loads."""', "class A:", "    return", "        y = 2", "    raise", "z = 3", "async def go():", "    time.sleep(3)", "    requests.post(u)",
    "for i in xs:", "    re.compile(p)", "except:", "import os", "from a import b", "    os.getcwd()", "    b()", "except Exception as e:", "    else:",
]
LINES = rf"""cl AS (SELECT 'u' || user_id AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS line_no, {choose_sql(SHAPES, 'event_id * 7919 + event_id // 13')} AS line FROM events),
lines AS (SELECT *, trim(line) AS stripped, length(line) - length(ltrim(line)) AS indent FROM cl)"""


def shaped_files(s, d):
    x = t(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", choose(SHAPES, "event_id * 7919 + event_id DIV 13").alias("line")))).alias("ls"))
    return x.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.array_join(F.col("ls.line"), "\n").alias("text"))


def shaped(s, d):
    return O.source_lines(shaped_files(s, d), "file", "text")


def body_sql(most: int) -> str:
    return f"""h AS (SELECT * FROM lines WHERE regexp_matches(stripped, '^def test_\\w+\\s*\\(')), n AS (SELECT h.file, h.line_no AS top, l.line_no, l.stripped, l.line_no > h.line_no + 1 AND l.indent <= h.indent AS ends FROM h JOIN lines l ON l.file = h.file AND l.line_no > h.line_no AND l.line_no <= h.line_no + {most}),
b AS (SELECT *, coalesce(max(ends) OVER (PARTITION BY file, top ORDER BY line_no), false) AS gone FROM n)"""


@query("empty_tests", f"WITH {LINES}, {body_sql(50)} SELECT 'empty_test' AS type, 'high' AS severity, file, line_no AS line FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file = h.file AND b.top = h.line_no AND NOT gone AND b.stripped NOT IN ('', 'pass') AND b.stripped NOT LIKE '#%')")
def empty_tests(s, d):
    return O.empty_tests(shaped(s, d))


@query("missing_asserts", f"WITH {LINES}, {body_sql(20)} SELECT 'missing_assert' AS type, 'medium' AS severity, file, line_no AS line FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file = h.file AND b.top = h.line_no AND NOT gone AND contains(b.stripped, 'assert'))")
def missing_asserts(s, d):
    return O.missing_asserts(shaped(s, d))


@query("missing_docstrings", f"WITH {LINES} SELECT 'missing_docstring' AS type, 'low' AS severity, file, line_no AS line FROM lines h WHERE stripped IN ('def test_a():', 'def load(a):', 'class A:') AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.file = h.file AND l.line_no BETWEEN h.line_no + 1 AND h.line_no + 3 AND contains(l.line, '\"\"\"'))")
def missing_docstrings(s, d):
    return O.missing_docstrings(shaped(s, d))


@query("unreachable_lines", f"""WITH {LINES}, n AS (SELECT h.file, h.line_no AS top, h.indent AS depth, l.line_no, l.indent, row_number() OVER (PARTITION BY h.file, h.line_no ORDER BY l.line_no) AS r FROM lines h JOIN lines l ON l.file = h.file AND l.line_no BETWEEN h.line_no + 1 AND h.line_no + 5
  WHERE h.stripped IN ('return', 'raise') AND l.stripped <> '' AND l.stripped NOT LIKE '#%' AND NOT (l.indent > h.indent AND l.stripped = 'else:')) SELECT 'unreachable_code' AS type, 'medium' AS severity, file, line_no AS line FROM n WHERE r = 1 AND indent > depth""")
def unreachable_lines(s, d):
    return O.unreachable(shaped(s, d))


@query("unused_import_lines", f"""WITH {LINES}, i AS (SELECT file, line_no, line, CASE stripped WHEN 'import os' THEN 'os' ELSE 'b' END AS name FROM lines WHERE stripped IN ('import os', 'from a import b')),
c AS (SELECT i.file, i.line_no, sum(len(l.line) - len(replace(l.line, name, ''))) / any_value(len(name)) AS n FROM i JOIN lines l ON l.file = i.file AND l.line_no <> i.line_no GROUP BY ALL) SELECT 'unused_import' AS type, 'medium' AS severity, file, line_no AS line FROM i LEFT JOIN c USING (file, line_no) WHERE coalesce(n, 0) <= 1""")
def unused_import_lines(s, d):
    return O.unused_import_lines(shaped(s, d))


def scoped_sql() -> str:
    tests = {r"^async def ": "starts_with(stripped, 'async def ')", r"^(for|while)\b.*:$": "regexp_matches(stripped, '^(for|while)\\b.*:$')"}
    parts, out = [], []
    for i, (kind, severity, header, call) in enumerate(O.SCOPED):
        parts.append(f"""h{i} AS (SELECT *, {tests[header]} AS head FROM lines WHERE stripped <> ''), g{i} AS (SELECT *, max(CASE WHEN head THEN line_no END) OVER (PARTITION BY file ORDER BY line_no) AS top FROM h{i}),
k{i} AS (SELECT g.*, count_if(NOT g.head AND g.indent <= h.indent) OVER (PARTITION BY g.file, g.top ORDER BY g.line_no) AS ended FROM g{i} g JOIN h{i} h ON h.file = g.file AND h.line_no = g.top)""")
        out.append(f"SELECT '{kind}' AS type, '{severity}' AS severity, file, line_no AS line FROM k{i} WHERE ended = 0 AND NOT head AND regexp_matches(stripped, '{call}')")
    return f"WITH {LINES}, {', '.join(parts)} " + " UNION ALL ".join(out)


@query("scoped_calls", scoped_sql())
def scoped_calls(s, d):
    out = None
    for kind, severity, header, call in O.SCOPED:
        x = O.after_header(shaped(s, d), header, call, kind, severity)
        out = x if out is None else out.unionByName(x)
    return out


@query("empty_excepts", f"WITH {LINES}, n AS (SELECT *, lead(stripped) OVER (PARTITION BY file ORDER BY line_no) AS next FROM lines) SELECT 'empty_except' AS type, 'high' AS severity, file, line_no AS line FROM n WHERE (stripped = 'except:' OR starts_with(stripped, 'except Exception')) AND next IN ('', 'pass', '...')")
def empty_excepts(s, d):
    return O.empty_except(shaped(s, d))


ALL = ["empty_tests", "missing_asserts", "missing_docstrings", "unreachable_lines", "unused_import_lines", "scoped_calls", "empty_excepts"]


@query("dimension_scan", " UNION ALL ".join(f"SELECT type, severity, count(*) AS n FROM ({B.ORACLES[q]}) GROUP BY ALL" for q in ALL) + f" UNION ALL (WITH {LINES} SELECT 'missing_timeout', 'medium', count(*) FROM lines WHERE stripped = 'requests.post(u)' HAVING count(*) > 0)")
def dimension_scan(s, d):
    return O.all_dimensions(shaped(s, d)).groupBy("type", "severity").agg(F.count("*").alias("n"))


@query("review_order", f"WITH u AS (SELECT * FROM ({B.ORACLES['empty_tests']}) UNION ALL SELECT * FROM ({B.ORACLES['missing_docstrings']})) SELECT type, severity, file, line FROM u ORDER BY {B.RANK}, file, line LIMIT 40")
def review_order(s, d):
    x = O.empty_tests(shaped(s, d)).unionByName(O.missing_docstrings(shaped(s, d)))
    return x.orderBy(B.S.rank(F.col("severity"), 9), "file", "line").limit(40)


# ---- all line rules: lines of thirty-two events make a file

CODE_LINES = [
    'cur.execute(f"select {x} # ")', 'cur.execute("select %s # " % q)', "cur.execute(a + b)", "cur.execute(query)", "    os.system(cmd)", "run(c, shell=True)", 'password = "hunter # "', "key = 'sk-0123456789abcdefghijABCDEFGHIJ # '", "    eval(x)", " " * 24 + "deep = 1",
    "# TODO later", "x = 1  # fixme", "y = '" + "z" * 120 + "'", 'host = "10.0.0.7:80"', 'host = "127.0.0.1"', "requests.get(u)", "requests.post(u, timeout=3)", 'v = os.environ["K"]', 'v = os.getenv("K") or "d"', 'password = "test_x"', "# eval(x)", "plain = 1", "",
]
CODE_TEXT = f"""cl AS (SELECT event_id // 32 AS k, event_id, replace({choose_sql(CODE_LINES, 'event_id * 7919 + event_id // 11')}, ' # ', CAST(event_id AS VARCHAR)) AS line FROM events),
lines AS (SELECT CASE WHEN k % 9 = 0 THEN 'test_' ELSE 'f' END || k || '.py' AS file, CAST(row_number() OVER (PARTITION BY k ORDER BY event_id) AS INTEGER) AS line_no, line, trim(line) AS stripped FROM cl)"""
CODE_FOUND = f"WITH {CODE_TEXT}, {B.rules_sql()}"


def code_lines(s, d):
    line = F.replace(choose(CODE_LINES, "event_id * 7919 + event_id DIV 11"), F.lit(" # "), F.col("event_id").cast("string"))
    x = t(s, d, "events").groupBy(F.expr("event_id DIV 32").alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("ls"))
    x = x.select(F.concat(F.when(F.col("k") % 9 == 0, "test_").otherwise("f"), F.col("k").cast("string"), F.lit(".py")).alias("file"), F.array_join("ls.line", "\n").alias("text"))
    return O.source_lines(x, "file", "text")


def code_findings(s, d):
    return O.scan_lines(code_lines(s, d))


@query("code_rules", f"{CODE_FOUND} SELECT * FROM found")
def code_rules(s, d):
    return code_findings(s, d)


@query("code_project_score", f"{CODE_FOUND}, c AS (SELECT {B.COUNTS} FROM found) SELECT *, {B.SCORE} AS score FROM c")
def code_project_score(s, d):
    return O.project_score(code_findings(s, d))


@query("code_file_scores", f"{CODE_FOUND}, c AS (SELECT file, {B.COUNTS} FROM found GROUP BY file) SELECT c.file, {', '.join(V.SEVERITIES)}, r.score FROM c JOIN (SELECT file, CAST(greatest(0, 100 - sum({B.sql_map(V.REVIEW_WEIGHTS, 'severity', '2')})) AS INTEGER) AS score FROM found GROUP BY file) r USING (file)")
def code_file_scores(s, d):
    f = code_findings(s, d)
    counts = f.groupBy("file").agg(*(F.count_if(F.col("severity") == x).alias(x) for x in V.SEVERITIES))
    return counts.join(O.review(f).select("file", "score"), "file")


@query("code_dimension_scores", f"{CODE_FOUND}, {B.DIMENSIONS} SELECT * FROM dd")
def code_dimension_scores(s, d):
    return O.dimension_scores(code_findings(s, d))


@query("code_overall_score", f"{CODE_FOUND}, {B.DIMENSIONS}, w(dimension, weight) AS (VALUES {', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in V.DIMENSION_WEIGHTS.items())}) SELECT CAST(trunc(sum(coalesce(score, 100) * weight) / sum(weight)) AS INTEGER) AS overall, count_if(score < 100) AS below FROM w LEFT JOIN dd USING (dimension)")
def code_overall_score(s, d):
    return O.overall(O.dimension_scores(code_findings(s, d)))


# ---- taint and syntax over code

FLOW = [
    "x = input('n')", "x = int(x)", "y = f'{x}'", "y = escape(y)", "    z = 'a' + y", "os.system(x)", "# eval(x)", "    eval(y)", "", "logger.info('%s' % y)", 'cur.execute(f"{z}")', "x = y", "os.popen(y)", "self.w = z", "print(w)",
    "subprocess.call(w)",
]


def flow_files(s, d):
    x = t(s, d, "events").withColumn("k", F.expr("event_id DIV 24")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("event_id", choose(FLOW, "(event_id * 40503 % 65536) DIV 64").alias("line")))).alias("ls"))
    return x.select(F.col("k").alias("file"), F.array_join(F.col("ls.line"), "\n").alias("text"))


# Variables hand on taint in a ring (x to y, y to x and z, z to w), so lines are folded one by one: each is a level of the recursion.
@query("taint_candidates", f"""WITH RECURSIVE l AS (SELECT event_id // 24 AS k, CAST(row_number() OVER (PARTITION BY event_id // 24 ORDER BY event_id) AS INTEGER) AS n, {choose_sql(FLOW, '(event_id * 40503 % 65536) // 64')} AS line FROM events),
s(k, n, line, x, y, z, w) AS (SELECT DISTINCT k, 0, '', NULL::STRUCT(src INTEGER, hops VARCHAR[]), NULL::STRUCT(src INTEGER, hops VARCHAR[]), NULL::STRUCT(src INTEGER, hops VARCHAR[]), NULL::STRUCT(src INTEGER, hops VARCHAR[]) FROM l
  UNION ALL SELECT s.k, l.n, trim(l.line),
    CASE WHEN l.line LIKE 'x = input%' THEN {{'src': l.n, 'hops': CAST([] AS VARCHAR[])}} WHEN l.line = 'x = int(x)' THEN NULL WHEN l.line = 'x = y' AND y IS NOT NULL THEN {{'src': y.src, 'hops': list_append(y.hops, 'assign')}} ELSE x END,
    CASE WHEN l.line = 'y = escape(y)' THEN NULL WHEN l.line LIKE 'y = f%' AND x IS NOT NULL THEN {{'src': x.src, 'hops': list_append(x.hops, 'fstring')}} ELSE y END,
    CASE WHEN trim(l.line) LIKE 'z = %' AND y IS NOT NULL THEN {{'src': y.src, 'hops': list_append(y.hops, 'concat')}} ELSE z END,
    CASE WHEN l.line LIKE 'self.w%' AND z IS NOT NULL THEN {{'src': z.src, 'hops': list_append(z.hops, 'assign')}} ELSE w END
  FROM s JOIN l ON s.k = l.k AND l.n = s.n + 1),
c(line, copy, kind, critical, variable) AS (VALUES ('os.system(x)', 1, 'shell_exec', 1, 'x'), ('eval(y)', 1, 'code_exec', 1, 'y'), ('logger.info(''%s'' % y)', 1, 'log_inject', 0, 'y'), ('cur.execute(f"{{z}}")', 1, 'sql_query', 1, 'z'), ('cur.execute(f"{{z}}")', 2, 'sql_query', 1, 'z'), ('os.popen(y)', 1, 'shell_exec', 1, 'y'), ('subprocess.call(w)', 1, 'shell_exec', 1, 'w')),
f AS (SELECT s.*, c.*, CASE variable WHEN 'x' THEN x WHEN 'y' THEN y WHEN 'z' THEN z ELSE w END AS v FROM s JOIN c ON s.line = c.line),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, copy) - 1 AS ord FROM f WHERE v IS NOT NULL)
SELECT CAST(k AS VARCHAR) AS file, CAST(ord AS INTEGER) AS ord, 'user_input' AS source_kind, v.src AS source_line, kind AS sink_kind, n AS sink_line, CAST(len(v.hops) AS INTEGER) AS hops, array_to_string(v.hops, ',') AS hop_types, variable,
  least(1.0::DOUBLE, round(CASE len(v.hops) WHEN 0 THEN 0.8 WHEN 1 THEN 0.7 ELSE 0.5 END::DOUBLE + 0.1 * critical + 0.1, 6)) AS confidence FROM r WHERE ord < 20""")
def taint_candidates(s, d):
    from ..operators.taint import taint

    return taint(flow_files(s, d)).select("file", "ord", "source_kind", "source_line", "sink_kind", "sink_line", "hops", "hop_types", "variable", F.round("confidence", 6).alias("confidence"))


TREES = ["import os\nimport re\nre.x()\n", "try:\n    a()\nexcept:\n    pass\n", "try:\n    a()\nexcept E:\n    b()\n", "for x in y:\n    s += 'a'\n", "def f(:\n", "def g(a):\n" + "".join(f"    if a == {i}:\n        pass\n" for i in range(21))]


@query("syntax_findings", """WITH f AS (SELECT event_id, event_id % 6 AS k FROM events), r(k, type, severity, line, confidence) AS (VALUES (0, 'unused_import', 'low', 1, 0.9::DOUBLE), (1, 'bare_except', 'high', 3, 0.98), (1, 'swallowed_exception', 'high', 3, 0.95), (3, 'loop_string_concat', 'high', 2, 0.9), (5, 'high_cyclomatic_complexity', 'medium', 1, 0.95))
SELECT type, severity, CAST(event_id AS VARCHAR) AS file, line, confidence FROM f JOIN r USING (k)""")
def syntax_findings(s, d):
    from ..operators.syntax import syntax_rules

    return syntax_rules(t(s, d, "events").select(F.col("event_id").alias("file"), choose(TREES, "event_id").alias("text")))


@query("imports_changed", """WITH x AS (SELECT event_id, ['import m' || event_id % 5, 'import k'] AS old, CASE WHEN event_id % 3 = 0 THEN ['import m' || user_id % 5, 'from p' || event_id % 4 || ' import q'] ELSE ['import m' || user_id % 5, 'import k'] END AS new FROM events)
SELECT event_id, array_to_string(list_filter(new, lambda i: NOT list_contains(old, i)), ',') AS added, array_to_string(list_filter(old, lambda i: NOT list_contains(new, i)), ',') AS removed FROM x""")
def imports_changed(s, d):
    n, u = F.col("event_id"), F.col("user_id")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    before = I.imports_of(text("import m", n % 5, "\nimport k\nx = import_all(", n, ")"))
    after = I.imports_of(text("import m", u % 5, "\n", F.when(n % 3 == 0, text("  from p", n % 4, " import q\n")).otherwise("import k\n"), "y = from_(", n, ")"))
    trimmed = lambda xs: F.transform(xs, lambda x: F.trim(x))
    return t(s, d, "events").select("event_id", F.array_join(F.array_except(trimmed(after), trimmed(before)), ",").alias("added"), F.array_join(F.array_except(trimmed(before), trimmed(after)), ",").alias("removed"))


@query("signatures_kept", "SELECT event_id, event_id % 7 = 0 OR event_id % 3 = user_id % 3 AS kept FROM events")
def signatures_kept(s, d):
    head = lambda n, rest: F.concat(F.lit("def f(a"), n.cast("string"), F.lit(f"):\n    {rest}"))
    n, u = F.col("event_id"), F.col("user_id")
    return t(s, d, "events").select("event_id", I.signature_kept(head(n % 3, "pass"), F.when(n % 7 == 0, F.concat(F.lit("def g"), n.cast("string"), F.lit("():\n    pass"))).otherwise(head(u % 3, "return 1")), "f").alias("kept"))


# ---- tool output, logs, task lists and caches

CODES = ["F401", "E501", "S105", "C901", "W0702", "I001"]


@query("lint_findings", f"""WITH x AS (SELECT event_id, {choose_sql(CODES, 'event_id')} AS code FROM events), r(code, type, severity, dimension) AS (VALUES {', '.join(f"('{k}', '{a}', '{b}', '{c}')" for k, (a, b, c) in V.LINT_RULES.items())})
SELECT event_id, type, severity, dimension, 'f.py' AS file, CAST(event_id % 90 AS INTEGER) AS line, CASE WHEN event_id % 2 = 0 THEN 'drop it' ELSE '' END AS suggestion, 'ruff/' || code AS scanner FROM x JOIN r USING (code)""")
def lint_findings(s, d):
    n = F.col("event_id")
    item = F.to_json(F.struct(choose(CODES, "event_id").alias("code"), F.lit("f.py").alias("filename"), F.lit("m").alias("message"), F.struct((n % 90).alias("row")).alias("location"), F.when(n % 2 == 0, F.struct(F.lit("drop it").alias("message"))).alias("fix")))
    x = tools.lint_findings(t(s, d, "events").select(n, F.concat(F.lit("["), item, F.lit("]")).alias("text")))
    return x.select("event_id", "type", "severity", "dimension", "file", "line", "suggestion", "scanner")


def todo_lists(s, d):
    """Task lists of sixteen events each: done or open, with what an entry waits for, its tokens and its words, or without them."""
    n = F.col("event_id")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    words = F.when(n % 7 == 0, "").when(n % 3 == 0, text("  描述: old\n  描述: do ", F.col("event_type"), "\n")).otherwise(text("  描述: do ", n, " \n"))
    waits = F.when(n % 4 == 0, "  依赖: 无\n").when(n % 4 == 1, text("  依赖: t", n - 1, "\n")).when(n % 4 == 2, text("  依赖: t", n - 1, ",  t", n - 2, "\n")).otherwise("")
    entry = F.when(n % 6 == 5, text("- [x] 任务ID: t", n, "\n")).otherwise(text("- [ ] 任务ID: t", n, "\n", words, waits, F.when(n % 5 == 0, text("  预估 token 量: ", 100 + n % 900, "\n")).otherwise("")))
    x = t(s, d, "events").groupBy(F.expr("event_id DIV 16").alias("list")).agg(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))).alias("es"))
    return x.select("list", F.concat(F.lit("# tasks\n"), F.array_join("es.e", "")).alias("text"))


TODO = """td AS (SELECT event_id // 16 AS list, event_id, 't' || event_id AS task_id, CASE event_id % 4 WHEN 1 THEN 't' || (event_id - 1) WHEN 2 THEN 't' || (event_id - 1) || ',t' || (event_id - 2) ELSE '' END AS depends,
  CASE WHEN event_id % 5 = 0 THEN 100 + event_id % 900 ELSE 2000 END AS token_est, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'do ' || event_type ELSE 'do ' || event_id END AS description FROM events WHERE event_id % 6 <> 5)"""


@query("todo_tasks", f"WITH {TODO} SELECT list, task_id, depends, CAST(token_est AS INTEGER) AS token_est, description FROM td")
def todo_tasks(s, d):
    return tools.todo_tasks(todo_lists(s, d), ["list"]).withColumn("depends", F.array_join("depends", ","))


@query("pending_tasks", f"WITH {TODO} SELECT event_id, 't' || event_id AS task_id, coalesce(depends, '') AS depends, CAST(coalesce(token_est, 2000) AS INTEGER) AS token_est, coalesce(description, '') AS description FROM (SELECT event_id FROM events WHERE event_id % 2 = 1) e LEFT JOIN td USING (event_id)")
def pending_tasks(s, d):
    ids = t(s, d, "events").where("event_id % 2 = 1").select(F.expr("event_id DIV 16").alias("list"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("task_id"), F.col("event_id").alias("ord"))
    x = tools.pending(ids, tools.todo_tasks(todo_lists(s, d), ["list"]), ["list"])
    return x.select(F.col("ord").alias("event_id"), "task_id", F.array_join("depends", ",").alias("depends"), "token_est", "description")


@query("top_level_settings", """WITH u AS (SELECT user_id, count(*) AS n, max(event_id) AS top FROM events GROUP BY user_id)
SELECT user_id, 'name' AS key, 'last' || n AS value, '' AS items FROM u UNION ALL SELECT user_id, 'paths', NULL, array_to_string(list_transform(range(user_id % 4), lambda i: 'p' || (user_id + i)), ',') FROM u
UNION ALL SELECT user_id, 'level', NULL, '' FROM u UNION ALL SELECT user_id, 'size', CAST(top AS VARCHAR), '' FROM u""")
def top_level_settings(s, d):
    u = t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("top"))
    k = F.col("user_id")
    items = F.when(k % 4 == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(k % 4 - 1, F.lit(0))), lambda i: F.concat(F.lit("  - '"), F.lit("p"), (k + i).cast("string"), F.lit("'\n"))), ""))
    text = F.concat(F.lit("# of "), k.cast("string"), F.lit("\nname: 'first'\npaths:\n"), items, F.lit("\nlevel:\n  deep: 1\nsize: "), F.col("top").cast("string"), F.lit('\nname: "last'), F.col("n").cast("string"), F.lit('"\n'))
    return tools.top_level(u.select("user_id", text.alias("text")), ["user_id"]).withColumn("items", F.array_join("items", ","))


@query("number_settings", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 100 / 100 WHEN 1 THEN user_id ELSE 0.8 END::DOUBLE AS auto FROM events")
def number_settings(s, d):
    n = F.col("event_id")
    text = F.when(n % 4 == 0, F.concat(F.lit("gate:\n  auto: 0."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("\n"))).when(n % 4 == 1, F.concat(F.lit("auto = "), F.col("user_id").cast("string"))).when(n % 4 == 2, F.concat(F.lit("semiauto: "), n.cast("string"))).otherwise(F.concat(F.lit("auto: "), F.col("event_type")))
    return t(s, d, "events").select("event_id", tools.number_setting(text, "auto", 0.8).alias("auto"))


@query("run_rows", """WITH x AS (SELECT event_id, event_id % 3 AS k FROM events WHERE event_id % 5 <> 0), o AS (SELECT *, lpad(CAST(event_id AS VARCHAR), 9, '0') AS n FROM x ORDER BY event_id DESC LIMIT 60)
SELECT CASE k WHEN 0 THEN 'id' || event_id ELSE 'run-' || n END AS run_id, CASE k WHEN 2 THEN 'unknown' ELSE 'done' END AS status, CASE k WHEN 0 THEN 71 WHEN 1 THEN 82 END::DOUBLE AS score, CASE k WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 0 END AS total_issues, CASE k WHEN 0 THEN 2 ELSE 0 END AS high, CASE k WHEN 1 THEN 3 ELSE 0 END AS fixes FROM o""")
def run_rows(s, d):
    n = F.col("event_id").cast("string")
    deep = F.concat(F.lit('{"run_id": "id'), n, F.lit('", "status": "done", "deep_scan": {"score": 71, "issue_count": 4, "by_severity": {"high": 2}}, "overall_score": 5}'))
    record = F.when(F.col("event_id") % 5 == 0, "{broken").when(F.col("event_id") % 3 == 0, deep).when(F.col("event_id") % 3 == 1, '{"status": "done", "overall_score": 82, "total_issues": 6, "deep_fixes": {"succeeded": 3}}').otherwise("{}")
    x = t(s, d, "events").select(F.concat(F.lit("run-"), F.lpad(n, 9, "0"), F.lit(".json")).alias("name"), record.alias("record"))
    return tools.run_rows(x, 60).select("run_id", "status", "score", "total_issues", "high", "fixes")


TREE = ["src/a.py", "src/b.py", "docs/x.md", "config.yaml", "pyproject.toml", "routes/users.py", "routes/jobs.py", "tests/test_users.py", ".git/c.py", "services/io.py", "lib/.cache/d.py", "node_modules/e.py", ".gitlab-ci.yml"]
PATHS = f"p AS (SELECT DISTINCT user_id, {choose_sql(TREE, 'event_id * 7919 + event_id // 13')} AS path FROM events WHERE event_id % 9 < 4)"


def project_files(s, d):
    x = t(s, d, "events").where("event_id % 9 < 4").select("user_id", choose(TREE, "event_id * 7919 + event_id DIV 13").alias("path")).distinct()
    return x.withColumn("text", F.when(F.startswith("path", F.lit("routes/")), "def list_all(a):\n    pass\n").when(F.startswith("path", F.lit("services/")), "async def f():\n    time.sleep(1)\n").otherwise(F.concat(F.lit("# "), "path")))


@query("project_hashes", f"WITH {PATHS}, f AS (SELECT *, CASE WHEN path LIKE 'routes/%' THEN 'def list_all(a):' || chr(10) || '    pass' || chr(10) WHEN path LIKE 'services/%' THEN 'async def f():' || chr(10) || '    time.sleep(1)' || chr(10) ELSE '# ' || path END AS text FROM p WHERE path LIKE '%.py') SELECT user_id, left(sha256(string_agg(path || ':' || sha256(text), chr(10) ORDER BY path)), 16) AS hash FROM f GROUP BY user_id")
def project_hashes(s, d):
    return tools.project_hashes(project_files(s, d), ["user_id"])


@query("project_structure", f"WITH {PATHS}, x AS (SELECT user_id, string_agg(DISTINCT CASE WHEN path LIKE 'src/%' THEN 'src' WHEN path LIKE 'lib/%' THEN 'lib' END, ',' ORDER BY CASE WHEN path LIKE 'src/%' THEN 'src' WHEN path LIKE 'lib/%' THEN 'lib' END) AS s, count_if(path LIKE 'docs/%') AS d, count_if(path = 'config.yaml') AS c, count_if(path = 'pyproject.toml') AS b, count_if(path = '.gitlab-ci.yml') AS i FROM p GROUP BY user_id) SELECT user_id, coalesce(s, '.') AS source_dirs, CASE WHEN d > 0 THEN 'docs' ELSE '' END AS docs_dirs, CASE WHEN c > 0 THEN 'config.yaml' ELSE '' END AS config_files, CASE WHEN b > 0 THEN 'pyproject.toml' ELSE '' END AS build_files, CASE WHEN i > 0 THEN '.gitlab-ci.yml' ELSE '' END AS ci_files FROM x")
def project_structure(s, d):
    x = tools.structure(project_files(s, d), ["user_id"])
    return x.select("user_id", *(F.array_join(c, ",").alias(c) for c in ("source_dirs", "docs_dirs", "config_files", "build_files", "ci_files")))


@query("extension_counts", f"WITH {PATHS}, k AS (SELECT * FROM p WHERE path NOT LIKE '.git/%' AND path NOT LIKE 'lib/.%' AND path NOT LIKE 'node_modules/%' AND regexp_extract(path, '[.]([^./]+)$', 1) IN ('py', 'md')), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY path) AS n FROM k) SELECT user_id, count_if(path LIKE '%.py') AS py, count_if(path LIKE '%.md') AS md, string_agg(CASE WHEN n <= 3 THEN path END, ',' ORDER BY path) AS paths FROM r GROUP BY user_id")
def extension_counts(s, d):
    x = tools.extension_counts(project_files(s, d), ["user_id"], ["py", "md"], readers.SKIP_DIRS, 3)
    n = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)).cast("long")
    return x.select("user_id", n("py").alias("py"), n("md").alias("md"), F.array_join("paths", ",").alias("paths"))


@query("delegation_scan", f"WITH {PATHS} SELECT user_id, 'INFO' AS severity, 'async' AS category, path, 'list_all' AS name FROM p WHERE path LIKE 'routes/%' UNION ALL SELECT user_id, 'WARN', 'async_io', path, NULL FROM p WHERE path = 'services/io.py' UNION ALL SELECT user_id, 'INFO', 'test_coverage', path, 'jobs' FROM p WHERE path = 'routes/jobs.py' AND user_id IN (SELECT user_id FROM p WHERE path LIKE 'tests/%')")
def delegation_scan(s, d):
    return tools.delegation_scan(project_files(s, d), ["user_id"])


@query("cached_scans", "WITH c AS (SELECT user_id, event_type AS hash, count(*) AS runs FROM events WHERE event_id % 2 = 0 GROUP BY ALL), w AS (SELECT DISTINCT user_id, event_type AS hash FROM events) SELECT w.user_id, w.hash, coalesce(c.runs >= 10, false) AS hit FROM w LEFT JOIN c USING (user_id, hash)")
def cached_scans(s, d):
    e = t(s, d, "events").withColumnRenamed("event_type", "hash")
    cache = e.where("event_id % 2 = 0").groupBy("user_id", "hash").agg(F.count("*").alias("runs"))
    return tools.cached(e.select("user_id", "hash").distinct().withColumn("runs", F.lit(10)), cache, ["user_id"]).select("user_id", "hash", "hit")


@query("scan_snapshot", "SELECT coalesce(a.doc_id, b.doc_id) AS file, coalesce(a.n_chars, b.n_chars + 1) AS mtime FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) b ON a.doc_id = b.doc_id")
def scan_snapshot(s, d):
    x = t(s, d, "documents").select(F.col("doc_id").alias("file"), F.col("n_chars").alias("mtime"))
    return tools.snapshot(x.where("file % 2 = 0"), x.where("file % 3 = 0").withColumn("mtime", F.col("mtime") + 1))


@query("changed_files", "SELECT DISTINCT 'f' || (event_id % 300) || CASE WHEN event_id % 300 % 2 = 0 THEN '.py' ELSE '.md' END AS file FROM events WHERE event_type IN ('error', 'click') AND event_id % 2 = 0")
def changed_files(s, d):
    n = F.col("event_id") % 300
    x = t(s, d, "events").select("event_type", F.concat(F.lit("f"), n.cast("string"), F.when(n % 2 == 0, ".py").otherwise(".md")).alias("file"))
    return tools.changed_files(x.where("event_type = 'error'"), x.where("event_type = 'click'"), ["py"])


@query("quick_scan", f"WITH {LINES}, k AS (SELECT file FROM (SELECT DISTINCT file FROM lines) ORDER BY file LIMIT 5) SELECT 'todo_comment' AS type, 'info' AS severity, file, line_no AS line, stripped AS detail FROM lines WHERE line = '    x = 1' AND file IN (SELECT file FROM k) ORDER BY file, line_no LIMIT 100")
def quick_scan(s, d):
    x = shaped(s, d).withColumn("line", F.replace("line", F.lit("    x = 1"), F.lit("    x = 1 # TODO")))
    out = tools.quick_scan(x, x, 5)
    return out.withColumn("detail", F.replace("detail", F.lit(" # TODO"), F.lit("")))


@query("forbidden_paths", "SELECT page_id, CASE WHEN contains(lower(url), 'example.org') THEN 'EXAMPLE.org' ELSE 'utm_' END AS word FROM pages WHERE contains(lower(url), 'example.org') OR contains(lower(url), 'utm_')")
def forbidden_paths(s, d):
    return tools.forbidden(t(s, d, "pages"), ["EXAMPLE.org", "utm_"], "url").select("page_id", "word")


@query("bug_upserts", "WITH o AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) SELECT id, CASE WHEN id = 6 THEN -1 ELSE v END AS v FROM (SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n)")
def bug_upserts(s, d):
    old = t(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = t(s, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"))
    return readers.patched(readers.upsert(old, new, "id"), "id", 6, {"v": -1.0})


@query("audit_rows", "SELECT event_id, event_type AS operation, 'JSON: keys=[''k'']' AS summary, left(sha256(props), 16) AS content_hash FROM events")
def audit_rows(s, d):
    row = readers.audit_row(F.col("ts"), F.col("event_type"), F.lit("f"), F.lit("ok"), F.col("props"))
    get = lambda k: F.get_json_object(row, f"$.{k}").alias(k)
    return t(s, d, "events").select("event_id", get("operation"), get("summary"), get("content_hash"))


@query("log_lines", "SELECT event_id, format('{} {:<5s} [{}] {}', strftime(ts, '%H:%M:%S'), upper(event_type), 'm', user_id) AS line FROM events")
def log_lines(s, d):
    return t(s, d, "events").select("event_id", readers.log_line(F.date_format("ts", "HH:mm:ss"), F.upper("event_type"), F.lit("m"), F.col("user_id").cast("string")).alias("line"))
