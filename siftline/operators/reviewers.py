"""Review rules that look beyond one line: whole-text patterns, scopes, counts and long functions.

Whole-text rules stay inside a file's row, so they shuffle nothing.  Scope
rules run in windows over the lines of one file.  Null texts give no findings.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V

PLACE = "array<int>"


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def match_lines(text: Column, pattern: Column) -> Column:
    """The line (from 1) where each match of ``pattern`` starts."""
    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, m: F.when(m.isNotNull(), F.struct(newlines(gap).alias("gap"), newlines(m).alias("own"))))
    start = F.struct(F.lit(1).alias("at"), F.array().cast(PLACE).alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["gap"]).alias("out"))
    return F.aggregate(F.array_compact(steps), start, step, lambda acc: acc["out"])


def guard(flag: str, lines: Column, at: Column) -> Column | None:
    """What the line of a match, or those before it, must hold for a rule of this flag."""
    line = F.element_at(lines, at)
    if flag == "variable":
        return F.rlike(line, F.lit(V.REVIEW_VARIABLE))
    if flag == "unescaped":
        return ~F.lower(line).contains("escaped") & ~F.lower(line).contains("sanitize")
    if flag == "untried":
        before = F.slice(lines, F.greatest(F.lit(1), at - 11), F.least(F.lit(11), at - 1))
        return ~F.exists(before, lambda x: F.rlike(x, F.lit(r"^\s*try\s*:")))
    return None


def rule_hits(i: int, kind: str, severity: str, pattern: str, flag: str) -> Column:
    places = match_lines(F.col("text"), F.lit("(?d)" + pattern))
    if flag:
        places = F.filter(places, lambda at: guard(flag, F.col("lines"), at))
    return F.transform(places, lambda at: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), at.alias("line"), F.lit(i).alias("rule")))


def text_rules(files: DataFrame, file: str = "file", text: str = "text", rules=V.REVIEW_RULES) -> DataFrame:
    """(type, severity, file, line, rule): one row for each match of each rule in a whole text."""
    x = files.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text"), F.split(F.col(text), "\n", -1).alias("lines"))
    hits = [F.when(F.rlike("text", F.lit("(?d)" + rule[2])), rule_hits(i, *rule)) for i, rule in enumerate(rules)]
    x = x.select("file", F.explode(F.flatten(F.array_compact(F.array(*hits)))).alias("f"))
    return x.select("f.type", "f.severity", "file", "f.line", "f.rule")


def scoped(lines: DataFrame, header: str, blank_ends: bool) -> DataFrame:
    """Lines inside the scope of the last ``header`` line: deeper than it, up to the first that is not.

    Adds head (the line is a header).  A later header takes over; a blank line
    ends the scope if ``blank_ends`` and it is not deeper.
    """
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("head", F.rlike("stripped", F.lit(header)))
    x = x.withColumn("top", F.last(F.when(F.col("head"), F.struct("line_no", "indent")), True).over(so_far)).where("top IS NOT NULL")
    ends = ~F.col("head") & (F.col("indent") <= F.col("top.indent"))
    if not blank_ends:
        ends = ends & (F.col("stripped") != "")
    run = Window.partitionBy("file", "top").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("ended", F.max(ends).over(run)).where("NOT ended").drop("top", "ended")


def found(x: DataFrame, kind: str, severity) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return x.select(F.lit(kind).alias("type"), severity.alias("severity"), "file", F.col("line_no").alias("line"))


def queries_in_loops(lines: DataFrame) -> DataFrame:
    """Lines of a loop that query a database or service; the line that opens a loop does not count."""
    opens = F.rlike(F.substring("line", 1, 40), F.lit(r"(for|while|list comp|generator|map\()"))
    x = scoped(lines, r"^(for|while)\s.*:", True)
    return found(x.where(F.rlike("line", F.lit(V.QUERY_CALLS)) & ~opens), "n_plus_one", "high")


def blocking_in_async(lines: DataFrame) -> DataFrame:
    """Calls that block inside ``async def``, one row for each kind of call on a line; lines that name asyncio are passed over."""
    x = scoped(lines, "^async def ", False).where(~F.col("head") & ~F.col("stripped").contains("asyncio"))
    kinds = F.array_compact(F.array(*(F.when(F.rlike("stripped", F.lit(p)), F.lit(s)) for p, s in V.BLOCKING_CALLS)))
    return found(x.withColumn("severity", F.explode(kinds)), "sync_io_in_async", F.col("severity"))


def secrets(lines: DataFrame) -> DataFrame:
    """Quoted values assigned on lines that name a secret; comments, imports and placeholders are passed over."""
    x = lines.where(~F.rlike("stripped", F.lit(r"^(#|//|/\*)")) & ~F.col("stripped").contains("import "))
    x = x.withColumn("key", F.lower(F.regexp_extract("stripped", V.SECRET_NAMES, 0))).where("key <> ''")
    x = x.withColumn("value", F.regexp_extract("stripped", r"=\s*[\"'](.+?)[\"']", 1)).where((F.col("value") != "") & ~F.rlike("value", F.lit(V.SECRET_SKIPPED)))
    return found(x, "secret_leak", F.when(F.col("key").contains("password") | F.col("key").contains("secret"), "critical").otherwise("high"))


def nested_blocks(lines: DataFrame, most: int = 4) -> DataFrame:
    """Block openers more than ``most`` steps of four columns deep, outside texts that triple quotes open and close."""
    quote = F.startswith("stripped", F.lit('"""'))
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("inside", F.count_if(quote).over(so_far) % 2 == 1)
    x = x.where(~quote & ~F.col("inside") & ~F.startswith("stripped", F.lit("#")) & (F.floor(F.col("indent") / 4) > most) & F.rlike("line", F.lit(V.NESTING)))
    return found(x, "deep_nesting", "medium")


def hardcoded(lines: DataFrame) -> DataFrame:
    """Numbers of four digits or more that end an assignment, and quoted addresses; up to one of each a line."""
    x = lines.where(~F.rlike("stripped", F.lit('^(#|""")')) & ~F.col("stripped").contains("import "))
    number = F.regexp_replace(F.regexp_extract("stripped", r"=\s*(\d{4,})\s*(?:#|$|\])", 1), r"^0+(?=\d)", "")
    url = F.regexp_extract("stripped", r"[\"'](https?://[^\"']+)[\"']", 1)
    skipped = url.contains("localhost") | url.contains("127.0.0.1") | F.rlike(url, F.lit(r"example\.com|test|cdn\."))
    hits = F.array_compact(F.array(F.when((number != "") & ~number.isin("0", "1", *V.KNOWN_NUMBERS), number), F.when((url != "") & ~skipped, url)))
    x = x.withColumn("value", F.explode(hits))
    return x.select(F.lit("hardcoded_value").alias("type"), F.lit("low").alias("severity"), "file", F.col("line_no").alias("line"), "value")


def growing_collections(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Empty lists, maps and sets declared at the margin with more than 3 additions and fewer than 2 removals, and caches without a bound.

    The line is that of the first addition or of the cache.
    """
    x = files.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text"))
    kinds = [r"\[\s*\]", r"\{\s*\}", r"set\(\s*\)"]
    names = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(rf"(?m)^([\p{{L}}\p{{N}}_]+)\s*=\s*{k}"), F.lit(1)) for k in kinds)))
    n = x.select("file", "text", F.explode(names).alias("name"))
    of = lambda *parts: F.concat(*(F.col("name") if p is None else F.lit(p) for p in parts))
    added = of(r"\b", None, r"\.append\(|", None, r"\.add\(")
    gone = of(r"\b", None, r"\.pop\(|", None, r"\.discard\(")
    cleared = of(r"del\s+", None, r"\[|", None, r"\.clear\(|", None, r"\s*=\s*\[\s*\]")
    n = n.where((F.regexp_count("text", added) > 3) & (F.regexp_count("text", gone) + F.regexp_count("text", cleared) < 2))
    n = n.select("file", F.lit("medium").alias("severity"), (newlines(F.get(F.split("text", added, 2), F.lit(0))) + 1).alias("line"))
    caches = x.select("file", F.lit("low").alias("severity"), F.explode(match_lines(F.col("text"), F.lit(r"@lru_cache\b(?!\s*\(\s*maxsize)"))).alias("line"))
    return n.union(caches).select(F.lit("memory_leak").alias("type"), "severity", "file", "line")


def long_functions(files: DataFrame, file: str = "file", text: str = "text", most: int = 80) -> DataFrame:
    """Public functions of more than ``most`` lines, up to the next written line that is no deeper.

    Functions inside another one belong to it.  One pass along the lines of a row.
    """
    header = r"^\s*def\s+([\p{L}\p{N}_]+)\s*\("
    bare = lambda x: F.regexp_replace(x, r"^\s+", "")
    facts = F.transform(
        F.concat(F.split(F.col(text), "\n", -1), F.array(F.lit(None).cast("string"))),
        lambda x, i: F.struct(i.alias("i"), x.isNull().alias("last"), (bare(x) != "").alias("written"), (F.length(x) - F.length(bare(x))).alias("indent"), F.regexp_extract(x, header, 1).alias("name")),
    )
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("i"), none.alias("indent"), F.lit("").alias("name"), F.array().cast("array<struct<line:int,name:string,n:int>>").alias("out"))

    def step(acc, x):
        inside = acc["i"].isNotNull()
        ends = inside & (x["last"] | (x["written"] & (x["indent"] <= acc["indent"])))
        long = ends & (x["i"] - acc["i"] > most) & ~F.startswith(acc["name"], F.lit("_"))
        out = F.when(long, F.array_append(acc["out"], F.struct((acc["i"] + 1).alias("line"), acc["name"].alias("name"), (x["i"] - acc["i"]).alias("n")))).otherwise(acc["out"])
        opens = (~inside | ends) & ~x["last"] & (x["name"] != "")
        keep = lambda new, old: F.when(opens, new).when(ends, F.lit(None)).otherwise(old)
        return F.struct(keep(x["i"], acc["i"]).alias("i"), keep(x["indent"], acc["indent"]).alias("indent"), F.when(opens, x["name"]).otherwise(acc["name"]).alias("name"), out.alias("out"))

    x = files.where(F.col(text).isNotNull()).select(F.col(file).cast("string").alias("file"), F.explode(F.aggregate(facts, start, step, lambda acc: acc["out"])).alias("f"))
    return x.select(F.lit("long_function").alias("type"), F.lit("low").alias("severity"), "file", "f.line", "f.name", "f.n")
