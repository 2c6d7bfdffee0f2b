"""Issues on their way to a fix: records, tags, plans, verification and guards."""

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import scalars as S
from .graphs import DEEPEST, walked
from .syntax import parse


def with_defaults(issues: DataFrame) -> DataFrame:
    """Issues with what is missing filled in: unknown type, low severity, line 0, confidence 0.5, empty texts."""
    defaults = {"type": "unknown", "severity": "low", "file": "", "line": 0, "description": "", "suggestion": "", "confidence": 0.5, "dimension": ""}
    kind = lambda v: "string" if isinstance(v, str) else "int" if isinstance(v, int) else "double"
    have = set(issues.columns)
    return issues.withColumns({k: F.coalesce(F.col(k), F.lit(v)).cast(kind(v)) if k in have else F.lit(v).cast(kind(v)) for k, v in defaults.items()})


def pipeline_issues(findings: DataFrame) -> DataFrame:
    """Findings of the layers as issues; their scanner names the dimension."""
    return with_defaults(findings).withColumn("scanner", F.concat(F.lit("llm_scanner/"), F.coalesce(F.nullif(F.col("dimension"), F.lit("")), F.lit("unknown"))))


def warnings(issue_type: Column, file: Column, severity: Column, text: Column) -> Column:
    """What is wrong with an issue's record."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(empty(issue_type) | (issue_type == "unknown"), "issue_type is unknown"), F.when(empty(file), "file path is empty"),
        F.when(~F.coalesce(severity.isin(V.SEVERITIES), F.lit(False)), F.concat(F.lit("invalid severity: "), F.coalesce(severity, F.lit("None")))), F.when(empty(text), "description is empty"),
    ))


def tags(issue_type: Column, severity: Column) -> Column:
    """Marks of an issue; set before its complexity is known, so that none asks for a review."""
    return F.array_compact(F.array(F.when(severity.isin("critical", "high"), "high_priority"), F.when(issue_type.isin(V.SECURITY_TYPES), "security"), F.when(issue_type.isin("swallowed_exception", "bare_except", "print_used", "missing_timeout_config"), "auto_fixable")))


def strategy(issue_type: Column) -> Column:
    """How a type is fixed: approach, scope and lines; one line by pattern unless listed."""
    make = lambda a, s, n: F.struct(F.lit(a).alias("approach"), F.lit(s).alias("scope"), F.lit(n).alias("lines"))
    return S.lookup_struct({k: make(*v) for k, v in V.STRATEGIES.items()}, issue_type, make("pattern_replace", "single_line", 2))


def review_lists(issue_type: Column) -> Column:
    """The list of a review that a type belongs to; null for none."""
    return F.when(issue_type.isin(V.SECURITY_REVIEWS), "security").when(issue_type.isin(V.PERFORMANCE_REVIEWS), "performance").when(issue_type.isin(V.QUALITY_REVIEWS), "quality")


def verdicts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Score, verdict and summary of each review."""
    cost = F.sum(S.lookup(V.REVIEW_WEIGHTS, F.col("severity"), F.lit(2)))
    x = findings.groupBy(*keys).agg(F.greatest(F.lit(0), 100 - cost).cast("int").alias("score"), F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    verdict = F.when((F.col("critical") > 0) | (F.col("high") > 3), "reject").when(F.col("high") > 0, "needs_changes").when(F.col("score") >= 85, "approve").otherwise("needs_changes")
    return x.select(*keys, "score", "total", verdict.alias("verdict"))


def project_review(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row: the mean of file scores cut to a whole number, 100 without files."""
    return scores.agg(F.coalesce(F.floor(F.sum(score) / F.count("*")), F.lit(100)).cast("int").alias("score"), F.count("*").alias("files"))


def delegable(issues: DataFrame, fixable: list[str], most: int = 10) -> DataFrame:
    """The first grave issues of types without a fixer."""
    return issues.where(~F.col("type").isin(fixable) & F.col("severity").isin("critical", "high")).orderBy("ord").limit(most)


def dedicated_first(issues: DataFrame, dedicated: list[str], most: int) -> DataFrame:
    """The issues to fix: types with a fixer of their own first, in order, ``most`` at most."""
    return issues.orderBy(F.desc(F.col("type").isin(dedicated)), "ord").limit(most)


def runs_union(findings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Findings of several runs (run, ord), each signature once, the earliest; without those of ``known``."""
    sig = lambda x: x.withColumn("signature", F.concat_ws(":", "file", S.family(F.col("type")), S.bucket(F.col("line")).cast("string")))
    x = sig(findings).groupBy("signature").agg(F.min_by(F.struct(*findings.columns), F.struct("run", "ord")).alias("f")).select("signature", "f.*")
    return x if known is None else x.join(sig(known).select("signature").distinct(), "signature", "left_anti")


def cluster_texts(members: DataFrame, keys: list[str]) -> DataFrame:
    """Of the findings of a cluster (keys, description, suggestion, ord) the most frequent description, of equals the first, with their number where there are several, and so the suggestion."""

    def mode(column):
        n = members.groupBy(*keys, column).agg(F.count("*").alias("c"), F.min("ord").alias("o"))
        return n.groupBy(*keys).agg(F.max_by(column, F.struct("c", -F.col("o"))).alias(column), F.sum("c").alias("n"))

    x = mode("description").join(mode("suggestion").select(*keys, "suggestion"), keys)
    return x.select(*keys, F.when(F.col("n") > 1, F.concat("description", F.lit(" ("), F.col("n").cast("string"), F.lit(" 处)"))).otherwise(F.col("description")).alias("description"), "suggestion", "n")


def damped(findings: DataFrame, files: DataFrame) -> DataFrame:
    """SQL injection findings of files (file, text) that use placeholders and no f-string SQL get a confidence of 0.2 at most."""
    safe = F.rlike("text", F.lit(V.SQL_PLACEHOLDERS)) & ~F.rlike("text", F.lit(V.SQL_IN_FSTRING))
    x = findings.join(files.select("file", safe.alias("_safe")), "file", "left")
    return x.withColumn("confidence", F.when((F.col("type") == "sql_injection") & F.coalesce("_safe", F.lit(False)), F.least("confidence", F.lit(0.2))).otherwise(F.col("confidence"))).drop("_safe")


def unsuppressed(findings: DataFrame, suppressed: DataFrame, keys: list[str]) -> DataFrame:
    """Findings whose feedback key isn't suppressed."""
    return findings.join(suppressed.select(*keys).distinct(), keys, "left_anti")


def judged(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates (file, index, sink_kind) with the judgements given by index; those without are uncertain; repeated answers stay."""
    severity = F.when(F.col("sink_kind").isin(V.CRITICAL_SINKS), "critical").when(F.col("sink_kind").isin(V.HIGH_SINKS), "high").otherwise("medium")
    x = candidates.join(answers.select("file", "index", F.col("judgment").alias("_j"), F.col("reason").alias("_r"), F.col("severity").alias("_s")), ["file", "index"], "left")
    missing = F.lit("LLM 未对此候选做出判断")
    return x.select(*candidates.columns, F.coalesce("_j", F.lit("uncertain")).alias("judgment"), F.when(F.col("_j").isNull() & F.col("_r").isNull(), missing).otherwise(F.coalesce("_r", F.lit(""))).alias("reason"), F.coalesce("_s", severity).alias("severity"))


def candidate_text(file: Column, kind: Column, source: Column, source_line: Column, hops: Column, sink: Column, sink_code: Column, sink_line: Column, confidence: Column) -> Column:
    """The question about one candidate."""
    way = F.when(F.size(hops) > 0, F.array_join(hops, " → ")).otherwise("(直接传递)")
    return F.format_string("- 文件: %s\n- Source (%s): `%s` (行 %d)\n- 传播: %s (%d 跳)\n- Sink (%s): `%s` (行 %d)\n- 数据流置信度: %.1f%%", file, kind, F.left(source, F.lit(100)), source_line, way, F.size(hops), sink, F.left(sink_code, F.lit(100)), sink_line, confidence * 100)


def answers_json(text: Column, schema: str) -> Column:
    """The answers in a text: an array, an object that holds one under results or candidates, or one object, with or without a fence; null if it can't be read."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(text))
    many = F.coalesce(F.get_json_object(body, "$.results"), F.get_json_object(body, "$.candidates"), F.concat(F.lit("["), body, F.lit("]")))
    listed = F.when(F.startswith(body, F.lit("[")), body).when(F.startswith(body, F.lit("{")), many)
    return F.from_json(listed, f"array<{schema}>")


def unseen(new: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key neither ``known`` nor an earlier row has: failed tasks, approvals, created tasks."""
    x = new.groupBy(key).agg(F.min_by(F.struct(*(c for c in new.columns if c != key)), order).alias("r")).select(key, "r.*")
    return x.join(known.select(key).distinct(), key, "left_anti")


def ready(nodes: DataFrame, edges: DataFrame, status: DataFrame) -> DataFrame:
    """Nodes with whether all they depend on (edges src to dst) succeeded; edges from unknown nodes don't count."""
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    s = known.join(status.select(F.col("node").alias("src"), "status"), "src", "left")
    open_ = s.groupBy(F.col("dst").alias("node")).agg(F.bool_and(F.coalesce(F.col("status") == "success", F.lit(False))).alias("ok"))
    return nodes.select("node").join(open_, "node", "left").select("node", F.coalesce("ok", F.lit(True)).alias("ready"))


def blocked(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(node): the nodes behind failed ones, by one recursive query over the edges (src, dst)."""
    starts = failed.select("node").distinct()
    return walked(starts, edges, DEEPEST).select("node").distinct().join(starts, "node", "left_anti")


def batches(tasks: DataFrame, keys: list[str] = (), size: int = 3) -> DataFrame:
    """Tasks (task_id, depends array, ord) with their group and batch: free ones together, others by the sorted list of what they wait for, ``size`` a batch.

    Places come from counts by group and range of ord, so that no group is one task's work alone.
    """
    group = F.array_join(F.array_sort(F.coalesce("depends", F.array().cast("array<string>"))), ",")
    x = tasks.withColumn("group", group).withColumn("_b", F.floor(F.col("ord") / 4096))
    by = Window.partitionBy(*keys, "group")
    heads = x.groupBy(*keys, "group", "_b").agg(F.count("*").alias("n"))
    heads = heads.withColumn("_before", F.sum("n").over(by.orderBy("_b")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy(*keys, "group", "_b").orderBy("ord")) + F.col("_before")
    return x.join(heads, [*keys, "group", "_b"]).withColumn("batch", F.ceil(place / size)).drop("_b", "_before")


def chain(results: DataFrame, keys: list[str]) -> DataFrame:
    """Total of each chain of checks (name, passed, delta, ord): a failed syntax check ends it and asks for a rollback."""
    failed = (F.col("name") == "syntax") & ~F.col("passed")
    before = F.coalesce(F.max(failed).over(Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    x = results.withColumn("_cut", before).where("NOT _cut")
    return x.groupBy(*keys).agg(F.bround(F.sum("delta"), 6).alias("total_delta"), F.bool_and("passed").alias("passed"), F.bool_or(failed).alias("rollback"), F.count("*").alias("checks"))


def checks(fixes: DataFrame, remaining: DataFrame, imports: DataFrame) -> DataFrame:
    """The three checks of each fix (fix, type, file, action, text): it parses, no finding of its type is left in the file, and, where imports are at stake, the file imports (imports: file, ok)."""

    @F.pandas_udf("boolean")
    def parses(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t is not None and parse(t) is not None)

    x = fixes.withColumn("_s", parses("text"))
    x = x.join(remaining.select("type", "file", F.lit(True).alias("_left")).distinct(), ["type", "file"], "left").join(imports.select("file", F.col("ok").alias("_ok")), "file", "left")
    words = F.lower(F.concat_ws(" ", "type", "action"))
    about = F.greatest(*(F.contains(words, F.lit(w)) for w in ("import", "module", "dependency", "missing")))
    gone = F.col("_left").isNull()
    one = lambda n, name, ok, delta: F.struct(F.lit(n).alias("ord"), F.lit(name).alias("name"), ok.alias("passed"), delta.alias("delta"))
    three = [
        one(0, "syntax", F.col("_s"), F.when(F.col("_s"), 0.05).otherwise(-0.3)), one(1, "rescan", gone, F.when(gone, 0.15).otherwise(-0.2)),
        one(2, "import", ~about | F.coalesce("_ok", F.lit(True)), F.when(~about | F.col("_ok").isNull(), 0.0).when(F.col("_ok"), 0.1).otherwise(-0.15)),
    ]
    return x.select("fix", F.explode(F.array(*three)).alias("c")).select("fix", "c.*")


def imports_of(text: Column) -> Column:
    """The import lines of a text."""
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(F.trim(x), F.lit("^(import |from )")))


def over_modified(before: Column, after: Column) -> Column:
    """Why a fix changed too much: more than 20 lines more or 10 fewer, environment defaults or imports lost; null if it didn't."""
    n = F.size(F.split(after, "\n")) - F.size(F.split(before, "\n"))
    env = lambda t: F.regexp_count(t, F.lit(r"""\.get\w*\(+"\w+"\s*,\s*["']"""))
    return F.when(n > 20, "grown").when(n < -10, "shrunk").when(env(before) > env(after), "defaults lost").when(F.size(F.array_except(imports_of(before), imports_of(after))) > 0, "imports lost")


def signature_of(text: Column, name: str) -> Column:
    """The head of the first function ``name`` in a text, up to its colon; empty if there is none."""
    return F.regexp_extract(text, rf"def\s+{name}\s*\([^)]*\)\s*(->\s*\w+\s*)?:", 0)


def signature_kept(before: Column, after: Column, name: str) -> Column:
    """Whether a function's head is the same in both texts, or missing in one."""
    old, new = signature_of(before, name), signature_of(after, name)
    return F.coalesce((old == "") | (new == "") | (old == new), F.lit(False))


def acceptance(changes: DataFrame, names: list[str]) -> DataFrame:
    """Acceptance of each change (change, before, after, test_file, rework): signatures kept, parses, and neither empty nor over 200 lines; what to do next, and the number of reworks."""

    @F.pandas_udf("boolean")
    def parses(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t is not None and parse(t) is not None)

    same = [signature_kept(F.col("before"), F.col("after"), n) for n in names]
    added = F.size(F.split("after", "\n")) - F.size(F.split("before", "\n"))
    x = changes.withColumn("signature_ok", F.least(F.lit(True), F.lit(True), *same)).withColumn("syntax_ok", parses("after")).withColumn("diff_ok", (added <= 200) & (added != 0))
    ok = F.col("signature_ok") & F.col("syntax_ok") & F.col("diff_ok")
    action = F.when(ok, "通过").when(F.col("rework") >= 2, "协调者接管").otherwise("打回重做")
    return x.select("change", "signature_ok", "syntax_ok", "diff_ok", F.when(F.coalesce("test_file", F.lit("")) == "", True).alias("test_ok"), ok.alias("passed"), action.alias("action"), (F.col("rework") + F.when(ok, 0).otherwise(1)).alias("rework"))


def processed(fixes: DataFrame) -> DataFrame:
    """Fixes with the gate's decision and what follows: applied, queued or dropped; all go into the history."""
    d = S.gate(F.col("success"), F.col("confidence"))
    x = fixes.withColumn("decision", d)
    return x.withColumn("outcome", F.when(F.col("decision") == "auto_apply", "applied").when(F.col("decision") == "pending_review", "queued").otherwise("dropped"))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Of the proposals for each issue (issue, ord, text, first, last, replacement, confidence) the best that changes the text and parses.

    Half of the score is the proposal's confidence (0.5 if missing), half how small a part of the lines it replaces.
    Scores count to 9 places, so that equal ones tie whatever their sums' last bits; of those that tie the first is best.
    """

    @F.pandas_udf("boolean")
    def parses(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t is not None and parse(t) is not None)

    first, last, lines = F.col("first").cast("int"), F.col("last").cast("int"), F.split(F.coalesce("text", F.lit("")), "\n")
    fits = (F.col("replacement") != "") & (first >= 1) & (first <= last) & (last <= F.size(lines))
    new = F.array_join(F.concat(F.slice(lines, F.lit(1), first - 1), F.array("replacement"), F.slice(lines, last + 1, F.size(lines) - last)), "\n")
    sure = F.coalesce(F.nanvl(F.col("confidence").cast("double"), F.lit(0.5)), F.lit(0.5))
    score = F.round(0.5 * sure + 0.5 * (1 - (last - first + 1) / F.size(lines)), 9)
    x = candidates.select("issue", "ord", "text", F.when(fits, new).alias("new"), score.alias("score")).where("new IS NOT NULL AND NOT new <=> text").where(parses("new"))
    best = F.min_by(F.struct("ord", "score"), F.struct((-F.col("score")).alias("s"), F.col("ord").isNull().alias("n"), "ord"))
    return x.groupBy("issue").agg(best.alias("b")).select("issue", "b.ord", "b.score")


def signatures(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Functions of Python files: line, name, first five parameters, whether it is async and has a docstring, and decorators."""
    out = "file string, line int, end int, name string, args array<string>, is_async boolean, documented boolean, decorators array<string>"

    def run(batches):
        for pdf in batches:
            rows = []
            for f, t in zip(pdf["file"], pdf["text"]):
                root = parse(t) if t is not None else None
                for x in ast.walk(root) if root is not None else ():
                    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows.append((f, x.lineno, x.end_lineno, x.name, [a.arg for a in x.args.args[:5]], isinstance(x, ast.AsyncFunctionDef), ast.get_docstring(x) is not None, [ast.unparse(d) for d in x.decorator_list]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return files.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text")).mapInPandas(run, out)


def module_context(files: DataFrame, keys: list[str], most: int = 2000, head: int = 30, longest: int = 80) -> DataFrame:
    """The texts of a module (keys, file, text) as context: whole where they have ``most`` lines together at most, else of each file its first lines, its signatures and its longest function of ``longest`` lines at most."""
    lines = F.split("text", "\n")
    total = files.groupBy(*keys).agg(F.sum(F.size(lines)).alias("_total"))
    sig = signatures(files.select(F.concat_ws("\x1f", *keys, "file").alias("file"), "text"))
    n = F.col("end") - F.col("line") + 1
    sig = sig.groupBy(F.col("file").alias("_f")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "name", "args"))), lambda s: F.concat(F.lit("def "), s["name"], F.lit("("), F.array_join(s["args"], ", "), F.lit(")"))), "\n").alias("_sigs"), F.max_by(F.struct("line", "end"), F.when(n <= longest, F.struct(n, -F.col("line")))).alias("_long"))
    x = files.join(total, list(keys)).withColumn("_f", F.concat_ws("\x1f", *keys, "file")).join(sig, "_f", "left")
    body = F.when(F.col("_long").isNotNull(), F.concat(F.lit("\n"), F.array_join(F.slice(lines, F.col("_long.line"), F.col("_long.end") - F.col("_long.line") + 1), "\n"))).otherwise("")
    short = F.concat(F.array_join(F.slice(lines, 1, head), "\n"), F.lit("\n"), F.coalesce("_sigs", F.lit("")), body)
    part = F.concat(F.lit("# "), F.col("file"), F.lit("\n"), F.when(F.col("_total") <= most, F.col("text")).otherwise(short))
    return x.select(*keys, "file", part.alias("_p"), (F.col("_total") > most).alias("compact")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "_p"))), lambda p: p["_p"]), "\n\n").alias("context"), F.bool_or("compact").alias("compact"))


def delegate_decision(task: Column, category: Column, text: Column, tokens: Column, spent: Column, limit: Column) -> Column:
    """Whether a task goes to a helper: never new tests, always small tasks, then no features, and nothing beyond four fifths of the budget."""
    creates = (category == "test_creation") | (F.contains(task, F.lit("test_")) & F.contains(F.coalesce(text, F.lit("")), F.lit("创建")))
    tight = (limit > 0) & (spent / F.nullif(limit, F.lit(0)) > 0.8)
    return F.when(creates, False).when(F.coalesce(F.nullif(tokens, F.lit(0)), F.lit(2000)) < 1000, True).when(category.isin("feature", "refactor", "architecture"), False).otherwise(~F.coalesce(tight, F.lit(False)))


def writable(path: Column, allowed: list[str], protected: list[str]) -> Column:
    """Whether a path lies below an allowed folder and doesn't name a protected file or climb up."""
    inside = F.greatest(F.lit(False), F.lit(False), *(F.startswith(path, F.lit(a.rstrip("/") + "/")) for a in allowed))
    return inside & ~F.regexp_extract(path, "([^/]*)$", 1).isin(protected) & ~F.contains(path, F.lit(".."))


def checked(rows: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows with ``bad``, the first column whose value isn't one of those allowed; null where all are."""
    return rows.withColumn("bad", F.coalesce(*(F.when(~F.coalesce(F.col(c).isin(v), F.lit(False)), F.lit(c)) for c, v in allowed.items())))


def targets(listed: DataFrame, default: str = ".") -> DataFrame:
    """(place, path): distinct paths in order of first sight; the default where there are none."""
    x = listed.where(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(F.min("ord").alias("ord"))
    none = x.sparkSession.createDataFrame([(default, -1)], "path string, ord long")
    x = x.unionByName(none.join(x.limit(1).select(F.lit(default).alias("path"), F.lit(1).alias("_any")), "path", "left_anti"))
    place = F.row_number().over(Window.orderBy("ord", "path"))
    return x.select(place.alias("place"), "path").orderBy("place")
