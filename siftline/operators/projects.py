"""Projects from their files: languages, frameworks, layout, batches of modules, reports and run states."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders left out, languages by suffix, and marker files.
SKIPPED = ["node_modules", "__pycache__", ".venv", "venv", "target", "dist", "build", ".git", "vendor", "__pypackages__"]
NO_MODULES = ["__pycache__", ".git", ".venv", "venv", "node_modules", "__pypackages__", ".mypy_cache", ".pytest_cache"]
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust"}
OTHER = ["c", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "kt"]
FRAMEWORKS = {"fastapi": "app = FastAPI", "flask": "Flask", "django": "Django", "uvicorn": "uvicorn", "asyncio": "async def"}
MANAGERS = {
    "pip": ["requirements.txt", "setup.py", "pyproject.toml", "Pipfile.lock", "poetry.lock"], "npm": ["package-lock.json", "yarn.lock", "pnpm-lock.yaml"], "maven": ["pom.xml"],
    "gradle": ["build.gradle", "build.gradle.kts"], "go": ["go.mod"], "cargo": ["Cargo.lock"],
}
TEST_FOLDERS = {"python": ["tests", "test", "testing"], "javascript": ["tests", "test", "__tests__"], "java": ["src/test"], "rust": ["tests"]}
CONFIGS = [".env.example", ".env.template", "config.yaml", "config.yml", "settings.py", "settings.json", "config.toml"]
DOCS = ["docs", "doc", "documentation"]
SEVERITY_MARKS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "⚪"}


def folder(path: Column) -> Column:
    """The path's folder; empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def blueprint(files: DataFrame, project: str = "project", path: str = "path", text: str = "text") -> DataFrame:
    """One row a project: primary language, counts by language, total, frameworks, package managers, tests and dimensions that apply.

    ``path`` is relative, with slashes.  Source files are those of known
    suffixes outside skipped and hidden folders; the primary language has the
    most of them, ties by name.  Frameworks are looked for in Python projects.
    """
    low = F.lower(path)
    source = ~F.rlike(path, F.lit(r"(^|/)\.")) & ~F.exists(F.split(folder(F.col(path)), "/"), lambda x: x.isin(SKIPPED))
    suffix = F.regexp_extract(low, r"[^/]\.([a-z]+)$", 1)
    lang = F.coalesce(*(F.when(suffix == k, v) for k, v in LANGUAGES.items()), F.when(suffix.isin(OTHER), "other"))
    x = files.select(F.col(project).alias("project"), F.col(path).alias("path"), F.col(text).alias("text"), F.when(source, lang).alias("lang"))
    python = F.endswith("path", F.lit(".py"))
    marks = [F.bool_or(python & F.contains("text", F.lit(v))).alias(f"fw_{k}") for k, v in FRAMEWORKS.items()]
    marks += [F.bool_or(F.col("path").isin(v)).alias(f"pm_{k}") for k, v in MANAGERS.items()]
    marks += [F.bool_or(F.rlike("path", F.lit("^(" + "|".join(v) + ")/"))).alias(f"t_{k}") for k, v in TEST_FOLDERS.items()]
    marks += [F.bool_or(F.regexp_extract("path", "([^/]*)$", 1) == "app.py").alias("app"), F.bool_or(F.lower("path").isin(CONFIGS)).alias("configs"), F.bool_or(F.rlike("path", F.lit("(?i)^(" + "|".join(DOCS) + ")/")) | (F.col("path") == "README.md")).alias("docs")]
    facts = x.groupBy("project").agg(*marks, *(F.count_if(F.col("lang") == k).alias(f"n_{k}") for k in [*dict.fromkeys(LANGUAGES.values()), "other"]))
    names = [*dict.fromkeys(LANGUAGES.values()), "other"]
    counts = F.filter(F.array(*(F.struct(F.col(f"n_{k}").alias("n"), F.lit(k).alias("lang")) for k in names)), lambda c: c["n"] > 0)
    ranked = F.array_sort(counts, lambda a, b: F.when(a["n"] != b["n"], F.signum(b["n"] - a["n"]).cast("int")).when(a["lang"] < b["lang"], -1).otherwise(1))
    primary = F.coalesce(F.get(ranked["lang"], F.lit(0)), F.lit("unknown"))
    y = facts.select("*", ranked.alias("ranked"), primary.alias("primary"), F.aggregate(counts["n"], F.lit(0).cast("long"), lambda a, b: a + b).alias("total_files"))
    is_python = F.col("primary") == "python"
    true = lambda c: F.coalesce(c, F.lit(False))
    frameworks = F.array_compact(F.array(*(F.when(is_python & (true(F.col(f"fw_{k}")) | (true(F.col("app")) if k == "fastapi" else F.lit(False))), k) for k in FRAMEWORKS)))
    managers = F.array_compact(F.array(*(F.when(true(F.col(f"pm_{k}")), k) for k in MANAGERS)))
    tests = F.coalesce(*(F.when(F.col("primary") == k, true(F.col(f"t_{k}"))) for k in TEST_FOLDERS), F.lit(False))
    y = y.withColumns({"frameworks": frameworks, "package_managers": managers, "has_tests": tests})
    web, n = ["python", "javascript", "typescript"], F.col("total_files")
    enabled = {
        "quality": n > 0, "testing": F.col("has_tests"), "performance": F.col("primary").isin([*web, "java"]), "architecture": n >= 5, "security": F.col("primary").isin([*web, "java"]), "documentation": true(F.col("docs")),
        "configuration": true(F.col("configs")), "asyncification": F.array_contains("frameworks", "asyncio") | F.col("primary").isin(web), "deadcode": n >= 3,
    }
    dimensions = F.array_sort(F.array_compact(F.array(*(F.when(v, k) for k, v in enabled.items()))))
    return y.select("project", "primary", F.map_from_arrays(F.col("ranked.lang"), F.col("ranked.n")).alias("file_counts"), "total_files", "frameworks", "package_managers", "has_tests", dimensions.alias("dimensions"))


def module_batches(files: DataFrame, path: str = "path", keys: list[str] = ()) -> DataFrame:
    """Python files by folder: (module_dir, files, is_test, file_count); tool folders and hidden ones are left out."""
    at = F.coalesce(F.nullif(folder(F.col(path)), F.lit("")), F.lit("(root)"))
    x = files.where(F.endswith(path, F.lit(".py"))).select(*keys, F.col(path).alias("_path"), at.alias("module_dir"))
    parts = F.split("module_dir", "/")
    x = x.where(~F.startswith("module_dir", F.lit(".")) & ~F.exists(parts, lambda p: p.isin(NO_MODULES)))
    is_test = F.exists(parts, lambda p: F.contains(F.lower(p), F.lit("test")))
    return x.groupBy(*keys, "module_dir").agg(F.array_sort(F.collect_list("_path")).alias("files"), F.first(is_test).alias("is_test"), F.count("*").alias("file_count"))


def review_comment(findings: DataFrame, keys: list[str], title: str = "## Code review report") -> DataFrame:
    """One Markdown comment for each value of ``keys``: findings by type, types and findings in the order of ``ord``.

    A finding has type, severity, line, description, suggestion, code and ord.
    """
    mark = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in SEVERITY_MARKS.items()), F.lit("⚪"))
    code = F.when(F.coalesce("code", F.lit("")) != "", F.concat(F.lit("\n  - ```"), F.left("code", F.lit(80)), F.lit("```"))).otherwise("")
    line = F.concat(F.lit("- **L"), F.coalesce(F.col("line").cast("string"), F.lit("0")), F.lit("** ["), F.coalesce("severity", F.lit("low")), F.lit("]: "), F.coalesce("description", F.lit("")), F.lit("\n  - 💡 "), F.coalesce("suggestion", F.lit("")), code)
    x = findings.select(*keys, "type", "ord", mark.alias("mark"), line.alias("entry"), F.col("severity").isin("critical", "high").alias("grave"))
    y = x.groupBy(*keys, "type").agg(F.array_sort(F.collect_list(F.struct("ord", "entry", "mark"))).alias("es"), F.bool_or(F.coalesce("grave", F.lit(False))).alias("grave"))
    block = F.concat(F.lit("### "), F.get("es", F.lit(0))["mark"], F.lit(" "), F.coalesce("type", F.lit("")), F.lit("\n\n"), F.array_join(F.col("es.entry"), "\n"), F.lit("\n"))
    y = y.select(*keys, "grave", F.get("es", F.lit(0))["ord"].alias("ord"), block.alias("block"))
    z = y.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "block"))).alias("bs"), F.bool_or("grave").alias("grave"))
    rest = F.when(F.col("grave"), "").otherwise("\n---\n> ⚠️ 未发现严重问题，建议修复以上 low/medium 问题后合并。")
    return z.select(*keys, F.concat(F.lit(title + "\n\n"), F.array_join(F.col("bs.block"), "\n"), rest).alias("comment"))


def run_states(events: DataFrame) -> DataFrame:
    """State, times and phase timings of each run from its events (run_id, event, at, ord, phase, seconds, error).

    start moves queued to running; succeed and fail end a running one; cancel
    asks, and the next check after it ends the run as cancelled, whatever its
    state; phase records seconds, the last of a name.  Other moves are counted
    as illegal and change nothing.
    """
    es = F.array_sort(F.collect_list(F.struct("at", "ord", "event", "error")))
    none = F.lit(None)
    start = F.struct(F.lit("queued").alias("state"), none.cast("timestamp").alias("started_at"), none.cast("timestamp").alias("finished_at"), none.cast("string").alias("error"), F.lit(False).alias("asked"), F.lit(0).alias("illegal"))

    def step(s, e):
        op, at = e["event"], e["at"].cast("timestamp")
        begins = (op == "start") & (s["state"] == "queued")
        ends = op.isin("succeed", "fail") & (s["state"] == "running")
        stops = (op == "check") & s["asked"]
        bad = op.isin("start", "succeed", "fail") & ~begins & ~ends
        state = F.when(begins, "running").when(ends & (op == "succeed"), "succeeded").when(ends, "failed").when(stops, "cancelled").otherwise(s["state"])
        return F.struct(
            state.alias("state"), F.when(begins, at).otherwise(s["started_at"]).alias("started_at"), F.when(ends | stops, at).otherwise(s["finished_at"]).alias("finished_at"),
            F.when(ends & (op == "fail"), e["error"]).otherwise(s["error"]).alias("error"), (s["asked"] | (op == "cancel")).alias("asked"), (s["illegal"] + bad.cast("int")).alias("illegal"),
        )

    last = F.array_sort(F.collect_list(F.when((F.col("event") == "phase") & F.col("phase").isNotNull(), F.struct("at", "ord", "phase", "seconds"))))
    timings = F.aggregate(last, F.create_map().cast("map<string,double>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["phase"]), F.create_map(p["phase"], p["seconds"].cast("double"))))
    x = events.groupBy("run_id").agg(F.aggregate(es, start, step).alias("s"), timings.alias("phase_timings"))
    seconds = (F.unix_micros("s.finished_at") - F.unix_micros("s.started_at")) / 1e6
    return x.select("run_id", "s.state", "s.started_at", "s.finished_at", seconds.alias("duration_seconds"), "s.error", "s.illegal", "phase_timings")
