"""Review rules beyond one line, on small texts with known findings."""

from siftline.operators import calls as C
from siftline.operators import reviewers as R
from siftline.operators.findings import source_lines


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_matches_across_lines(spark):
    text = "a = 1\ncur.execute(\n    f'SELECT {x}')\nos.system('ls')\nos.system('rm {}'.format(p))"
    rows = got(R.text_rules(files(spark, text, None, "")), "type", "line", "rule")
    assert rows == [("command_injection", 5, 7), ("missing_error_handling", 2, 22), ("sql_injection", 2, 0)]


def test_try_within_eleven_lines(spark):
    near, far = "try:\n" + "x\n" * 10 + "json.loads(x)", "try:\n" + "x\n" * 11 + "json.loads(x)"
    assert got(R.text_rules(files(spark, near, far)), "file", "line") == [("f1", 13)]


def test_loops_end_at_blank_lines(spark):
    x = source_lines(files(spark, "for a in b:\n    c.query()\n\n    d.query()", "while a:\n    if b:\n        for c in d.all():\n            e.get(1)\nf.get(2)"), "file", "text")
    assert got(R.queries_in_loops(x), "file", "line") == [("f0", 2), ("f1", 4)]


def test_async_scopes(spark):
    x = source_lines(files(spark, "async def a():\n\n    time.sleep(1)\n    asyncio.run(os.system(b))\ntime.sleep(2)", "def a():\n    time.sleep(1)"), "file", "text")
    assert got(R.blocking_in_async(x), "file", "line", "severity") == [("f0", 3, "high")]


def test_secrets_and_values(spark):
    text = "password = 'longer than five'\n# token = 'abcdefgh'\ntoken = 'your_token'\nt = 00443\nn = 12345 # x\nu = \"https://shop.org/x\"\nv = 'http://localhost/'"
    x = source_lines(files(spark, text, None), "file", "text")
    assert got(R.secrets(x), "line", "severity") == [(1, "critical")]
    assert got(R.hardcoded(x), "line", "value") == [(5, "12345"), (6, "https://shop.org/x")]


def test_nesting_outside_quotes(spark):
    deep = " " * 20 + "if x:"
    x = source_lines(files(spark, f'{deep}\n"""\n{deep}\n"""\n{deep}\n' + " " * 16 + "if y:"), "file", "text")
    assert got(R.nested_blocks(x), "line") == [(1,), (5,)]


def test_growth(spark):
    grows = "a = []\n" + "a.append(1)\n" * 4 + "@lru_cache\n@lru_cache(maxsize=2)"
    bounded = "a = []\n" + "a.append(1)\n" * 4 + "a.pop(0)"
    assert got(R.growing_collections(files(spark, grows, bounded, "b = {}\nb.add(1)", None)), "file", "line", "severity") == [("f0", 2, "medium"), ("f0", 6, "low")]


def test_long_functions(spark):
    body = "    x\n" * 3
    text = f"def a(x):\n{body}\n    def inner():\n    {body}def _b():\n{body}{body}class C:\n    def d(self):\n" + "        y\n" * 4 + "z = 1\ndef last():\n" + body
    assert got(R.long_functions(files(spark, text, None, ""), most=4), "line", "name", "n") == [(1, "a", 9), (18, "d", 5), (24, "last", 5)]


def test_calls(spark):
    one = "import asyncio\nasync def work():\n    pass\ndef main():\n    asyncio.run(work())\ndef go():\n    asyncio.run(other())\ndef w():\n    asyncio.get_running_loop()\n    raise RuntimeError('no')"
    rows = got(C.boundary_findings(files(spark, one, "def broken(", None)), "type", "line", "severity")
    assert rows == [("asyncio_run_in_loop", 7, "medium"), ("sync_wrapper_raises", 8, "critical")]
    a, b, c = "def load():\n    pass", "from a import load as l\nasync def go():\n    l()\n    x.l()\n    load()", "def load():\n    pass\ndef load():\n    pass"
    chain = got(C.import_chain(C.code_facts(files(spark, a, b, c))), "file", "line", "defined_in")
    assert chain == [("f1", 3, "f0"), ("f1", 3, "f2"), ("f1", 4, "f0"), ("f1", 4, "f2")]
