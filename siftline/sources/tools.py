"""What other tools leave behind: linter output, run logs, task lists, settings, caches and project layout."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import values as V

LINT = "array<struct<code:string,filename:string,message:string,location:struct<row:int>,row:int,fix:struct<message:string>>>"
# Names of folders and files by what they tell about a project.
SOURCE_DIRS = ["src", "lib", "core", "internal", "app", "apps"]
DOC_DIRS = ["docs", "doc", "documentation"]
BUILD_FILES = ["dockerfile", "docker-compose.yml", "docker-compose.yaml", "makefile", "cmakelists.txt", "build.sh", "tox.ini", "setup.py", "pyproject.toml", "requirements.txt", "package.json", "go.mod", "cargo.toml", "pom.xml"]
CONFIG_FILES = [".env.example", ".env.template", "config.yaml", "config.yml", "settings.py", "settings.json", "config.toml"]
CI_FILES = ["azure-pipelines.yml", ".gitlab-ci.yml", "circleci"]


def lint_findings(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Findings of a linter's JSON output, one row of text a run (key columns stay); only rules that are known here."""
    rules = F.create_map(*(x for k, (a, b, c) in V.LINT_RULES.items() for x in (F.lit(k), F.struct(F.lit(a).alias("type"), F.lit(b).alias("severity"), F.lit(c).alias("dimension")))))
    keys = [c for c in outputs.columns if c != text]
    x = outputs.select(*keys, F.posexplode(F.from_json(text, LINT)).alias("ord", "i")).withColumn("_r", F.try_element_at(rules, F.col("i.code"))).where("_r IS NOT NULL")
    line, suggestion = F.coalesce("i.location.row", "i.row", F.lit(0)), F.coalesce("i.fix.message", F.lit(""))
    return x.select(*keys, "ord", "_r.*", F.col("i.filename").alias("file"), line.alias("line"), suggestion.alias("suggestion"), F.lit(0.95).alias("confidence"), F.concat(F.lit("ruff/"), "i.code").alias("scanner"))


def todo_tasks(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Open tasks of task lists in Markdown: (keys, task_id, depends, token_est, description); of a repeated id the last.

    A task starts at a line ``- [ ] 任务ID:``; lines below it give the rest, the last of a kind.
    Without them it depends on nothing and takes 2000 tokens.
    """
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), "\n- \\[ \\] 任务ID:"), 2, 1 << 30)
    x = texts.select(*keys, F.posexplode(parts).alias("ord", "part"))
    last = lambda p: F.try_element_at(F.regexp_extract_all("part", F.lit(p), F.lit(1)), F.lit(-1))
    waits = F.trim(last(r"\n[ \t]+依赖:[ \t]*([^\n]+)"))
    listed = F.filter(F.transform(F.split(waits, ","), lambda d: F.trim(d)), lambda d: d != "")
    none = F.array().cast("array<string>")
    x = x.select(
        *keys, "ord", F.regexp_extract("part", r"^\s*(\S+)", 1).alias("task_id"), F.when(waits.isNull() | (waits == "无") | F.startswith(waits, F.lit("无（")), none).otherwise(listed).alias("depends"),
        F.coalesce(last(r"\n[ \t]+预估 token 量:[ \t]*(\d+)").cast("int"), F.lit(2000)).alias("token_est"), F.coalesce(F.trim(last(r"\n[ \t]+描述:[ \t]*([^\n]+)")), F.lit("")).alias("description"),
    )
    return x.where("task_id <> ''").groupBy(*keys, "task_id").agg(F.max_by(F.struct("depends", "token_est", "description"), "ord").alias("t")).select(*keys, "task_id", "t.*")


def pending(ids: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Pending tasks (keys, task_id, ord) with their definitions; those without one depend on nothing and take 2000 tokens."""
    x = ids.join(tasks, [*keys, "task_id"], "left")
    return x.select(*keys, "task_id", "ord", F.coalesce("depends", F.array().cast("array<string>")).alias("depends"), F.coalesce("token_est", F.lit(2000)).alias("token_est"), F.coalesce("description", F.lit("")).alias("description"))


def top_level(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, key, value, items): the top level of plain YAML texts: a value, or the dash items below a key without one; of a repeated key the last."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    x = texts.select(*keys, F.posexplode(lines).alias("n", "line"))
    bare = lambda c: F.regexp_replace(F.trim(c), "^['\"]+|['\"]+$", "")
    top = F.rlike("line", F.lit(r"^[^\s].*:"))
    w = Window.partitionBy(*keys).orderBy("n")
    x = x.withColumn("at", F.last(F.when(top, F.col("n")), True).over(w)).where("at IS NOT NULL")
    item = F.when(F.rlike("line", F.lit(r"^\s+- ")) & ~F.contains("line", F.lit(":")), F.nullif(bare(F.regexp_replace("line", r"^\s+- ", "")), F.lit("")))
    head = F.when(F.col("n") == F.col("at"), F.col("line"))
    x = x.groupBy(*keys, "at").agg(F.max(head).alias("head"), F.array_sort(F.collect_list(F.when(item.isNotNull(), F.struct("n", item.alias("i"))))).alias("items"))
    x = x.select(*keys, "at", F.trim(F.substring_index("head", ":", 1)).alias("key"), F.nullif(bare(F.regexp_replace("head", r"^[^:]*:", "")), F.lit("")).alias("value"), F.col("items.i").alias("items"))
    return x.groupBy(*keys, "key").agg(F.max_by(F.struct("value", "items"), "at").alias("v")).select(*keys, "key", "v.*")


def number_setting(text: Column, name: str, default: float) -> Column:
    """A number set by ``name:`` or ``name =`` in a text, else the default."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"\b{name}\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")), F.lit("999999D999999")).cast("double"), F.lit(float(default)))


def run_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file that can be read, with its name."""
    x = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).json(path)
    return x.select("*", F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("name")).where("_corrupt_record IS NULL").drop("_corrupt_record")


def run_rows(runs: DataFrame, limit: int) -> DataFrame:
    """Summaries of run records (name, record as JSON text), the last by name first; a deep scan's figures before those of the run; records that can't be read drop out."""
    get = lambda p: F.get_json_object("record", f"$.{p}")
    deep = get("deep_scan").isNotNull() & (get("deep_scan") != "{}")
    pick = lambda d, *other: F.when(deep, get(f"deep_scan.{d}")).otherwise(F.coalesce(*(F.nullif(get(o), F.lit("0")) for o in other), F.lit(None)))
    x = runs.where(F.get_json_object("record", "$").isNotNull() & ~F.endswith("name", F.lit(".running")))
    return x.orderBy(F.desc("name")).limit(limit).select(
        F.coalesce(get("run_id"), F.regexp_replace("name", r"\.[^.]*$", "")).alias("run_id"), F.coalesce(get("status"), F.lit("unknown")).alias("status"), pick("score", "overall_score", "final_score").cast("double").alias("score"),
        F.coalesce(pick("issue_count", "total_issues").cast("int"), F.when(deep, F.lit(None)).otherwise(F.lit(0))).alias("total_issues"), F.coalesce(F.when(deep, get("deep_scan.by_severity.high").cast("int")), F.lit(0)).alias("high"),
        F.coalesce(get("deep_fixes.succeeded").cast("int"), F.lit(0)).alias("fixes"), F.coalesce(get("started_at"), F.lit("")).alias("started_at"), F.coalesce(get("finished_at"), F.lit("")).alias("finished_at"),
    )


def project_hashes(files: DataFrame, keys: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """Sixteen digits that change when a Python file of a project does: the hash of its files' hashes in order of their paths."""
    x = files.where(F.endswith(path, F.lit(".py"))).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col(path).alias("p"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("h")))).alias("hs"))
    return x.select(*keys, F.left(F.sha2(F.array_join(F.transform("hs", lambda h: F.concat_ws(":", h["p"], h["h"])), "\n"), 256), F.lit(16)).alias("hash"))


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted scans (keys, hash, runs) with ``hit``: whether the cache has the same hash with as many runs at least."""
    c = cache.groupBy(*keys, "hash").agg(F.max("runs").alias("_runs"))
    return wanted.join(c, [*keys, "hash"], "left").withColumn("hit", F.coalesce(F.col("_runs") >= F.col("runs"), F.lit(False))).drop("_runs")


def snapshot(now: DataFrame, before: DataFrame, key: str = "file", state: str = "mtime") -> DataFrame:
    """The states after a scan: those of ``now``, and of files only ``before`` has."""
    return now.select(key, state).unionByName(before.select(key, state).join(now.select(key), key, "left_anti"))


def structure(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Projects by the names at their top: source folders (the root without any), docs, configuration, build and CI files."""
    top = F.split(path, "/")[0]
    low, folder = F.lower(top), F.contains(path, F.lit("/")) & ~F.startswith(path, F.lit("."))
    named = lambda test: F.array_sort(F.collect_set(F.when(test, top)))
    file = ~F.contains(path, F.lit("/"))
    x = files.groupBy(*keys).agg(
        named(folder & low.isin(SOURCE_DIRS)).alias("source_dirs"), named(folder & low.isin(DOC_DIRS)).alias("docs_dirs"), named(file & low.isin(CONFIG_FILES)).alias("config_files"), named(file & low.isin(BUILD_FILES)).alias("build_files"),
        named(file & ~low.isin(CONFIG_FILES) & ~low.isin(BUILD_FILES) & (F.startswith(low, F.lit(".github")) | low.isin(CI_FILES))).alias("ci_files"),
    )
    return x.withColumn("source_dirs", F.when(F.size("source_dirs") == 0, F.array(F.lit("."))).otherwise(F.col("source_dirs")))


def extension_counts(files: DataFrame, keys: list[str], extensions: list[str], skipped: list[str], most: int = 5000, path: str = "path") -> DataFrame:
    """Projects with the number of files of each extension and the first ``most`` paths by name; skipped and hidden folders are left out."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    x = files.where(~F.exists(folders, lambda f: f.isin(skipped) | F.startswith(f, F.lit("."))) & ext.isin(extensions)).select(*keys, ext.alias("ext"), F.col(path).alias("path"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    counts = x.groupBy(*keys, "ext").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("counts"))
    listed = x.withColumn("_n", place).where(F.col("_n") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return counts.join(listed, keys)


def modules_without_tests(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Python modules below routes/ for which tests/ has neither test_<name>.py nor test_<name>s.py, in projects with tests."""
    name = F.regexp_extract(path, r"([^/]+)\.py$", 1)
    modules = files.where(F.startswith(path, F.lit("routes/")) & (name != "") & (name != "__init__")).select(*keys, F.col(path).alias("path"), name.alias("module")).distinct()
    tests = files.where(F.rlike(path, F.lit(r"^tests/[^/]*$"))).select(*keys, F.regexp_extract(path, r"([^/]+)$", 1).alias("test")).distinct()
    wanted = modules.withColumn("test", F.explode(F.array(F.concat(F.lit("test_"), "module", F.lit(".py")), F.concat(F.lit("test_"), "module", F.lit("s.py")))))
    tested = wanted.join(tests, [*keys, "test"], "left_semi").select(*keys, "path")
    return modules.join(tests.select(*keys).distinct(), keys, "left_semi").join(tested, [*keys, "path"], "left_anti")


def delegation_scan(files: DataFrame, keys: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """(keys, severity, category, path, name): sync routes, sync input and output in async services, modules without tests."""
    defs = files.where(F.startswith(path, F.lit("routes/")) & F.endswith(path, F.lit(".py"))).select(*keys, F.col(path).alias("path"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^[ \t]*def\s+(\w+)\s*\([^\n]*\)"), F.lit(1))).alias("name"))
    calls = [".get(", ".post(", ".request(", ".write(", ".read(", "open(", "subprocess.", "time.sleep"]
    t = F.col(text)
    blocking = F.contains(t, F.lit("async def")) & F.greatest(*(F.contains(t, F.lit(c)) for c in calls)) & ~F.contains(t, F.lit("asyncio.to_thread")) & ~F.contains(t, F.lit("await"))
    io = files.where(F.startswith(path, F.lit("services/")) & F.endswith(path, F.lit(".py")) & blocking).select(*keys, F.col(path).alias("path"))
    row = lambda x, s, c, n: x.select(*keys, F.lit(s).alias("severity"), F.lit(c).alias("category"), "path", n.alias("name"))
    return row(defs, "INFO", "async", F.col("name")).unionByName(row(io, "WARN", "async_io", F.lit(None).cast("string"))).unionByName(row(modules_without_tests(files, keys, path), "INFO", "test_coverage", F.col("module")))


def quick_scan(files: DataFrame, lines: DataFrame, most_files: int = 30, most: int = 100) -> DataFrame:
    """The first findings of open notes and silent handlers in the first files by name."""
    x = lines.join(files.select("file").distinct().orderBy("file").limit(most_files), "file", "left_semi")
    kinds = F.array_compact(F.array(F.when(F.rlike("line", F.lit("TODO|FIXME|XXX")), F.struct(F.lit("todo_comment").alias("type"), F.lit("info").alias("severity"))), F.when(F.rlike("line", F.lit(r"except[^:]*:\s*pass")), F.struct(F.lit("silent_exception").alias("type"), F.lit("warning").alias("severity")))))
    x = x.select("file", "line_no", F.left(F.trim("line"), F.lit(100)).alias("detail"), F.posexplode(kinds).alias("k", "f"))
    return x.orderBy("file", "line_no", "k").limit(most).select("f.type", "f.severity", "file", F.col("line_no").alias("line"), "detail")


def forbidden(paths: DataFrame, words: list[str], path: str = "path") -> DataFrame:
    """Rows whose path holds a forbidden word, whatever the case, with the first such word."""
    hit = F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(path), F.lower(w))), F.lit(0))
    return paths.withColumn("word", hit).where("word IS NOT NULL")


def changed_files(diff: DataFrame, untracked: DataFrame, extensions: list[str]) -> DataFrame:
    """Files of a version control's diff and its untracked ones, once each, of the wanted extensions."""
    return diff.select("file").union(untracked.select("file")).distinct().where(F.regexp_extract("file", r"\.([^./]+)$", 1).isin(extensions))
