"""Where synchronous and asynchronous Python code meet, within files and across imports."""

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import values as V
from .syntax import parse

FACTS = "fact string, file string, line int, name string, target string, severity string"


def called(call: ast.Call) -> str | None:
    f = call.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def of_asyncio(call: ast.Call, name: str) -> bool:
    f = call.func
    return isinstance(f, ast.Attribute) and f.attr == name and isinstance(f.value, ast.Name) and f.value.id == "asyncio"


def facts(text: str) -> list[tuple]:
    """(fact, line, name, target, severity) of one text; none if it doesn't parse.

    Facts: function (a sync one is defined), import (local name and what it
    stands for, the last of a name), call (inside an async function, by name),
    and findings, whose fact is their type.
    """
    tree = parse(text)
    if tree is None:
        return []
    nodes = list(ast.walk(tree))
    asynchronous, imports, out = {x.name for x in nodes if isinstance(x, ast.AsyncFunctionDef)}, {}, []
    for x in nodes:
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            for a in x.names:
                imports[a.asname or a.name] = a.name.rpartition(".")[2]
        if isinstance(x, ast.AsyncFunctionDef):
            out += [("call", c.lineno, called(c), x.name, None) for c in ast.walk(x) if isinstance(c, ast.Call) and called(c)]
        if not isinstance(x, ast.FunctionDef):
            continue
        out.append(("function", x.lineno, x.name, None, None))
        inner = list(ast.walk(x))
        calls = [c for c in inner if isinstance(c, ast.Call)]
        raises = [r.exc.func for r in inner if isinstance(r, ast.Raise) and isinstance(r.exc, ast.Call)]
        if any(of_asyncio(c, "get_running_loop") for c in calls) and any(isinstance(r, ast.Name) and r.id == "RuntimeError" for r in raises):
            out.append(("sync_wrapper_raises", x.lineno, x.name, None, "critical"))
        runs = [c for c in calls if of_asyncio(c, "run")]
        if runs and x.name.lower() not in V.ENTRY_POINTS:
            out.append(("asyncio_run_in_loop", runs[0].lineno, x.name, None, "high" if "_sync" in x.name or "_wrap_" in x.name else "medium"))
            inner = [(c, called(c.args[0])) for c in runs if c.args and isinstance(c.args[0], ast.Call)]
            out += [("sync_calls_async", c.lineno, x.name, name, "high") for c, name in inner if name in asynchronous]
    return out + [("import", None, k, v, None) for k, v in imports.items()]


def code_facts(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """The facts of every text; null texts have none."""

    def run(batches):
        for pdf in batches:
            rows = [(x[0], f, *x[1:]) for f, t in zip(pdf["file"], pdf["text"]) if t is not None for x in facts(t)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])
            yield out.astype({"line": "Int32"})

    return files.selectExpr(f"CAST(`{file}` AS STRING) AS file", f"`{text}` AS text").mapInPandas(run, FACTS)


def boundary_findings(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Sync wrappers that raise, loops run in functions, and sync functions that run async ones of their own file."""
    x = code_facts(files, file, text).where(~F.col("fact").isin("function", "import", "call"))
    return x.select(F.col("fact").alias("type"), "severity", "file", "line", "name", "target")


def import_chain(known: DataFrame) -> DataFrame:
    """Calls in async functions of imported names that are sync functions somewhere: one row for each file that defines one.

    ``known`` is a table of ``code_facts``.  Functions are counted a file
    before the join, so a name defined often in one file counts once.
    """
    calls = known.where("fact = 'call'").select("file", "line", "name", F.col("target").alias("caller"))
    imports = known.where("fact = 'import'").select("file", "name", F.col("target").alias("function"))
    defined = known.where("fact = 'function'").select(F.col("name").alias("function"), F.col("file").alias("defined_in")).distinct()
    x = calls.join(imports, ["file", "name"]).join(defined, "function")
    return x.select(F.lit("sync_calls_async_cross_file").alias("type"), F.lit("high").alias("severity"), "file", "line", "caller", "name", "defined_in")
