"""Findings: line rules, layers of dedup, clusters, ranks and scores.

A finding has type, severity, dimension, file, line, confidence and ord, its
place in the order of emission.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import scalars as S


def source_lines(files: DataFrame, file: str, text: str) -> DataFrame:
    """(file, line_no, line, stripped, indent), numbered from 1; a text's last newline opens a line."""
    x = files.select(F.col(file).cast("string").alias("file"), F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    bare = F.regexp_replace("line", r"^\s+", "")
    return x.select("file", (F.col("n") + 1).alias("line_no"), "line", F.regexp_replace(bare, r"\s+$", "").alias("stripped"), (F.length("line") - F.length(bare)).alias("indent"))


def scan_lines(lines: DataFrame, rules=V.LINE_RULES) -> DataFrame:
    """Findings of the line rules, one for each pattern that matches, in a single pass."""
    comment = F.startswith("stripped", F.lit("#"))
    code = F.substring_index("line", "#", 1)
    hits = []
    for i, (kind, severity, dimension, pattern, on) in enumerate(rules):
        text = {"stripped": F.col("stripped"), "line": F.col("line"), "code": code, "uncommented": F.col("line")}[on]
        test = F.rlike(text, F.lit(pattern))
        if kind == "long_line":
            test = F.length("line") > 120
        if on in ("stripped", "uncommented"):
            test = test & ~comment
        if on == "code":
            test = test & ~F.rlike(code, F.lit(V.SKIP_SECRET))
        if kind in ("todo_fixme", "hardcoded_ip"):
            test = test & ~F.rlike("file", F.lit(V.SKIP_FILE))
        if kind == "hardcoded_ip":
            test = test & ~F.rlike("stripped", F.lit(r"[\"'](0\.0\.0\.0|127\.0\.0\.1)(:\d+)?[\"']"))
        if kind == "missing_timeout":
            test = test & ~F.contains("stripped", F.lit("timeout"))
        if kind == "naked_env":
            test = test & ~F.contains(F.lower("stripped"), F.lit("default")) & ~F.contains("stripped", F.lit("or "))
        hits.append(F.when(test, F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(dimension).alias("dimension"))))
    x = lines.select("file", F.col("line_no").alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return x.select("f.type", "f.severity", "f.dimension", "file", "line", "f.rule")


def after_header(lines: DataFrame, header: str, call: str, kind: str, severity: str) -> DataFrame:
    """Findings where ``call`` stands below a ``header`` line, deeper than it, before the text returns to its depth.

    The header in force is the last one; a line that is not deeper ends it.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.where("stripped <> ''").withColumn("head", F.rlike("stripped", F.lit(header)))
    x = x.withColumn("depth", F.last(F.when(F.col("head"), F.col("indent")), True).over(w)).withColumn("at", F.last(F.when(F.col("head"), F.col("line_no")), True).over(w))
    left = F.max(F.when(~F.col("head") & (F.col("indent") <= F.col("depth")), 1).otherwise(0)).over(Window.partitionBy("file", "at").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("left", left).where(F.col("at").isNotNull() & ~F.col("head") & (F.col("left") == 0) & F.rlike("stripped", F.lit(call)))
    return x.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "file", F.col("line_no").alias("line"))


def empty_except(lines: DataFrame) -> DataFrame:
    """``except`` lines whose next line is blank, ``pass`` or ``...``."""
    nxt = F.lead("stripped").over(Window.partitionBy("file").orderBy("line_no"))
    x = lines.withColumn("next", nxt).where(((F.col("stripped") == "except:") | F.startswith("stripped", F.lit("except Exception"))) & F.col("next").isin("", "pass", "..."))
    return x.select(F.lit("empty_except").alias("type"), F.lit("high").alias("severity"), "file", F.col("line_no").alias("line"))


def opening(lines: DataFrame, header: str, most: int) -> DataFrame:
    """Header lines with the stripped lines of their body: the next ``most`` - 1 lines up to the first that is not deeper, the first of them whatever its depth.

    Only lines that follow a header are joined and put in order.
    """
    heads = lines.where(F.rlike("stripped", F.lit(header)))
    near = heads.select("file", F.col("line_no").alias("_h"), F.explode(F.sequence(F.col("line_no") + 1, F.col("line_no") + most - 1)).alias("line_no"))
    near = near.join(lines.select("file", "line_no", "stripped", "indent"), ["file", "line_no"])
    near = near.groupBy("file", F.col("_h").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", "stripped", "indent"))).alias("_near"))
    x = heads.join(near, ["file", "line_no"], "left").withColumn("_near", F.coalesce("_near", F.array().cast(near.schema["_near"].dataType)))
    shallow = F.transform("_near", lambda l, i: F.when((i > 0) & (l["indent"] <= F.col("indent")), i).otherwise(F.lit(most)))
    return x.withColumn("body", F.slice(F.col("_near.stripped"), F.lit(1), F.least(F.coalesce(F.array_min(shallow), F.lit(0)), F.size("_near")))).drop("_near")


def finding(lines: DataFrame, kind: str, severity: str, line="line_no") -> DataFrame:
    return lines.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "file", F.col(line).alias("line"))


def empty_tests(lines: DataFrame) -> DataFrame:
    """Tests whose body within 50 lines is nothing but blanks, comments and ``pass``."""
    x = opening(lines, r"^def test_\w+\s*\(", 51)
    return finding(x.where(~F.exists("body", lambda b: (b != "") & ~F.startswith(b, F.lit("#")) & (b != "pass"))), "empty_test", "high")


def missing_asserts(lines: DataFrame) -> DataFrame:
    """Tests without an assertion in the next 20 lines of their body."""
    x = opening(lines, r"^def test_\w+\s*\(", 21)
    return finding(x.where(~F.exists("body", lambda b: F.contains(b, F.lit("assert")) | F.contains(b, F.lit("pytest.raises")))), "missing_assert", "medium")


def missing_docstrings(lines: DataFrame) -> DataFrame:
    """Classes and public functions without triple quotes in the next three lines."""
    return missing_nearby(lines, r"^class .*:$|^def [^_]|^def $", "\"\"\"|\'\'\'", 1, 3, "missing_docstring", "low")


def unreachable(lines: DataFrame) -> DataFrame:
    """Deeper lines behind a bare return, raise, break or continue: the first line with code of the next five."""
    by = Window.partitionBy("file").orderBy("line_no").rowsBetween(1, 5)
    x = lines.withColumn("_near", F.collect_list(F.struct("line_no", "stripped", "indent")).over(by)).where(F.col("stripped").isin("return", "raise", "break", "continue"))
    other = F.filter("_near", lambda l: (l["stripped"] != "") & ~F.startswith(l["stripped"], F.lit("#")) & ~((l["indent"] > F.col("indent")) & F.rlike(l["stripped"], F.lit(r"^(else:|elif |except:|except |finally:)"))))
    x = x.withColumn("_first", F.get(other, F.lit(0))).where(F.col("_first.indent") > F.col("indent")).withColumn("at", F.col("_first.line_no"))
    return finding(x, "unreachable_code", "medium", "at")


def unused_import_lines(lines: DataFrame) -> DataFrame:
    """Import lines whose name stands at most once in the rest of the file, as a part of words too."""
    x = lines.where(F.rlike("stripped", F.lit("^(import |from )")) & ~F.contains("stripped", F.lit("import *")))
    part = lambda i: F.regexp_extract("stripped", r"import\s+(\w+)(?:\s+as\s+(\w+))?", i)
    x = x.select("file", "line_no", "line", F.coalesce(F.nullif(part(2), F.lit("")), F.nullif(part(1), F.lit(""))).alias("name")).where("name IS NOT NULL")
    count = lambda c: ((F.length(c) - F.length(F.replace(c, F.col("name"), F.lit("")))) / F.length("name")).cast("long")
    held = lines.select("file", F.col("line").alias("_other"), F.col("line_no").alias("_n")).join(x.select("file", "name").distinct(), "file").where(F.contains("_other", F.col("name")))
    whole = held.groupBy("file", "name").agg(F.sum(count(F.col("_other"))).alias("n"))
    x = x.join(whole, ["file", "name"]).where(F.col("n") - count(F.col("line")) <= 1)
    return finding(x, "unused_import", "medium")


#: Rules of calls below a header: (type, severity, header, call).
SCOPED = [
    ("sync_sleep_in_async", "high", r"^async def ", r"time\.sleep\s*\("), ("re_compile_in_loop", "medium", r"^(for|while)\b.*:$", r"re\.compile\s*\("),
    ("sync_http_in_async", "high", r"^async def ", r"requests\.(get|post|put|delete|patch)\s*\("), ("blocking_in_async", "high", r"^async def ", r"time\.sleep\s*\("),
]


def all_dimensions(lines: DataFrame) -> DataFrame:
    """Findings (type, severity, file, line) of every line rule: single lines, lines below headers, lines and what follows them."""
    parts = [scan_lines(lines).select("type", "severity", "file", "line"), *(after_header(lines, header, call, kind, severity) for kind, severity, header, call in SCOPED)]
    parts += [f(lines) for f in (empty_except, empty_tests, missing_asserts, missing_docstrings, unreachable, unused_import_lines)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_nearby(lines: DataFrame, header: str, wanted: str, lo: int, hi: int, kind: str, severity: str) -> DataFrame:
    """``header`` lines with nothing that matches ``wanted`` among the lines lo to hi away."""
    near = F.max(F.rlike("line", F.lit(wanted))).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(lo, hi))
    x = lines.withColumn("near", near).where(F.rlike("stripped", F.lit(header)) & ~F.coalesce("near", F.lit(False)))
    return x.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "file", F.col("line_no").alias("line"))


def normalise(findings: DataFrame, least: float = 0.8, strict: bool = False) -> DataFrame:
    """Types by their standard names, of confidence ``least`` or more (missing: 0.5); ``strict`` keeps listed types only."""
    x = findings.withColumn("type", S.lookup(V.TYPE_ALIASES, F.col("type"), F.col("type"))).where(F.coalesce("confidence", F.lit(0.5)) >= least)
    return x.where(F.col("type").isin(V.VALID_TYPES)) if strict else x


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, by columns of ascending order; partial aggregation keeps one row a key and task."""
    rest = [c for c in df.columns if c not in keys]
    x = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return x.select(*keys, "_r.*").select(*df.columns)


def most_severe(findings: DataFrame) -> DataFrame:
    """One finding of each fingerprint, the most severe, of equals the first; ``seen`` is the place of its first sight."""
    x = findings.withColumn("fingerprint", S.fingerprint(F.col("type"), F.col("file"), F.col("line")))
    first = F.min_by(F.struct(*findings.columns), F.struct(S.rank(F.col("severity"), 9).alias("r"), "ord"))
    return x.groupBy("fingerprint").agg(first.alias("_f"), F.min("ord").alias("seen")).select("_f.*", "fingerprint", "seen")


def signature(findings: DataFrame) -> DataFrame:
    return findings.withColumn("signature", F.concat_ws(":", "file", S.family(F.col("type")), S.bucket(F.col("line")).cast("string")))


def merge_layers(findings: DataFrame) -> DataFrame:
    """One finding of each signature: the lowest layer's first."""
    return first_by(signature(findings), ["signature"], [F.col("layer"), F.col("ord")])


def unknown_only(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings whose signature no row of ``known`` has."""
    return signature(findings).join(signature(known).select("signature"), "signature", "left_anti")


def islands(df: DataFrame, keys: list[str], at: str, gap, ord: str) -> DataFrame:
    """Number the runs of rows no more than ``gap`` apart, in each key."""
    w = Window.partitionBy(*keys).orderBy(at, ord)
    prev = F.lag(at).over(w)
    new = prev.isNull() | (F.col(at) - prev > gap)
    return df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def clusters(findings: DataFrame, gap: int = 3, most: int = 1) -> DataFrame:
    """Clusters of neighbouring lines by file, type and dimension, ``most`` of each file and type.

    A line 0 clusters only with line 0.  A cluster has its first finding's
    fields, the least positive line and the number of findings.
    """
    keys = ["file", "type", "dimension"]
    w = Window.partitionBy(*keys).orderBy("line", "ord")
    prev = F.lag("line").over(w)
    new = prev.isNull() | (F.col("line") - prev > gap) | ((prev == 0) != (F.col("line") == 0))
    x = findings.withColumn("_new", new.cast("int")).withColumn("cluster", F.sum("_new").over(w))
    x = x.groupBy(*keys, "cluster").agg(F.min_by("severity", F.struct("line", "ord")).alias("severity"), F.coalesce(F.min(F.when(F.col("line") > 0, F.col("line"))), F.lit(0)).alias("line"), F.count("*").alias("n"))
    n = F.row_number().over(Window.partitionBy("file", "type").orderBy("dimension", "cluster"))
    return x.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def snippets(findings: DataFrame, lines: DataFrame, around: int = 3, most: int | None = None) -> DataFrame:
    """(file, line, rule, snippet): the lines around each finding; only lines near one are sorted and joined, ``most`` characters at most."""
    where = findings.select("file", "line").distinct()
    near = where.select("file", F.col("line").alias("at"), F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line_no"))
    text = near.join(lines.select("file", "line_no", F.col("line").alias("_l")), ["file", "line_no"]).groupBy("file", F.col("at").alias("line")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "_l")))["_l"], "\n").alias("snippet"))
    if most is not None:
        text = text.withColumn("snippet", F.left("snippet", F.lit(most)))
    return findings.join(text, ["file", "line"]).select("file", "line", "rule", "snippet")


def project_score(findings: DataFrame) -> DataFrame:
    """One row: counts of the four severities and 100 - 20 * sqrt(weight / 20), between 0 and 100."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES]
    weight = sum((F.col(s) * w for s, w in V.PROJECT_WEIGHTS.items()), F.lit(0))
    return findings.agg(*counts).withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - 20 * F.sqrt(weight / 20), 0).cast("int"))))


def dimension_scores(findings: DataFrame) -> DataFrame:
    """Score of each dimension: 100 - 5 a finding; security 100 - 25 a critical and 10 a high."""
    n, crit, high = F.count("*"), F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "high")
    score = F.when(F.col("dimension") == "security", 100 - 25 * F.col("critical") - 10 * F.col("high")).otherwise(100 - 5 * F.col("n"))
    return findings.groupBy("dimension").agg(n.alias("n"), crit.alias("critical"), high.alias("high")).withColumn("score", F.greatest(F.lit(0), score).cast("int"))


def overall(scores: DataFrame) -> DataFrame:
    """Weighted mean of dimension scores, cut to an integer; dimensions without findings count 100."""
    w = scores.sparkSession.createDataFrame(list(V.DIMENSION_WEIGHTS.items()), "dimension string, weight double")
    x = w.join(scores.select("dimension", "score"), "dimension", "left")
    return x.agg((F.sum(F.coalesce("score", F.lit(100)) * F.col("weight")) / F.sum("weight")).cast("int").alias("overall"), F.count_if(F.col("score") < 100).alias("below"))


def review(findings: DataFrame, key: str = "file") -> DataFrame:
    """Review score of each file: 100 - 30, 15, 5, 2 a finding."""
    cost = F.sum(S.lookup(V.REVIEW_WEIGHTS, F.col("severity"), F.lit(2)))
    return findings.groupBy(key).agg(F.greatest(F.lit(0), 100 - cost).cast("int").alias("score"), F.count("*").alias("n"))


def assessed(findings: DataFrame) -> DataFrame:
    """Valid findings, once each, with related counts, complexity, effort and risk, in priority order."""
    x = findings.where("file <> '' AND type <> '' AND type <> 'unknown'")
    x = most_severe(x)
    x = x.join(x.groupBy("file").agg((F.count("*").cast("int") - 1).alias("related")), "file")
    kind = F.col("type")
    x = x.withColumn("complexity", S.complexity(kind)).withColumn("effort", S.effort(kind, F.col("related"))).withColumn("risk", S.risk(kind, F.col("severity")))
    place: Column = F.when(F.col("complexity") == "simple", 0).when(F.col("complexity") == "medium", 1).otherwise(2)
    return x.orderBy(S.rank(F.col("severity"), 9), place, "file", "line", "ord")


def still_there(before: DataFrame, after: DataFrame, slack: int = 3) -> DataFrame:
    """Findings of ``before`` that ``after`` has within ``slack`` lines, in the same file and of the same type.

    Lines are dealt to buckets of ``slack`` + 1, so the join is on equal keys.
    """
    width = slack + 1
    a = after.select("file", "type", F.col("line").alias("_line"), F.explode(F.array(*(F.floor(F.col("line") / width) + d for d in (-1, 0, 1)))).alias("_b"))
    b = before.withColumn("_b", F.floor(F.col("line") / width))
    return b.join(a, (b["file"] == a["file"]) & (b["type"] == a["type"]) & (b["_b"] == a["_b"]) & (F.abs(b["line"] - a["_line"]) <= slack), "left_semi").drop("_b")
