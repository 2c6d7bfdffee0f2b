"""Single files, issues, bugs and agents, and scans of chosen dimensions: filters that reach the rows before any rule does."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..functions import scalars as S
from . import findings as O
from . import history as H

METRICS = "summary struct<last_round:long,generated_at:string>, timer struct<round_num:long>, tasks struct<summary:struct<total:long>>, _corrupt_record string"


def code_window(text: Column, line: Column, before: int = 4, after: int = 3) -> Column:
    """The lines of a text from ``before`` lines above (counted from 0) to ``after`` below, the last left out; empty without text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    first = F.greatest(line - before, F.lit(0))
    last = F.least(line + after, F.size(lines))
    return F.array_join(F.slice(lines, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")), "\n")


def by_severity(issues: DataFrame, ord: str = "ord") -> DataFrame:
    """Issues in order of severity alone, as they came within each; unknown severities last."""
    return issues.orderBy(S.rank(F.col("severity")), ord)


def scan_one(files: DataFrame, name: str, file: str = "file", text: str = "text") -> DataFrame:
    """Findings of all line rules in one file; the other files' texts aren't cut into lines."""
    return O.all_dimensions(O.source_lines(files.where(F.col(file) == name), file, text))


def scan_phase(lines: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Findings of the line rules of the chosen dimensions, all without a choice; no other rule is tried.  ``scanner`` is the dimension's."""
    rules = [r for r in V.LINE_RULES if not dimensions or r[2] in dimensions]
    return O.scan_lines(lines, rules).drop("rule").withColumn("scanner", F.concat("dimension", F.lit("_scanner")))


def single_fixes(issues: DataFrame, fixers: DataFrame, results: DataFrame, calibration: DataFrame) -> DataFrame:
    """(id, fixer, confidence, decision, applied): the gate's decision on one fix of each issue (id, type).

    The fixer is the first registered (fixer, type, reg) for the issue's type,
    else the first for ``*``.  Its result (id, fixer, success, confidence) has
    its confidence replaced by the calibrated one (type, fixer, samples,
    calibrated), if known.  Without a fixer the decision is no_fixer, without a result rejected.
    """
    own = O.first_by(fixers.where("type <> '*'"), ["type"], [F.col("reg")]).select("type", F.col("fixer").alias("_own"))
    wild = O.first_by(fixers.where("type = '*'"), ["type"], [F.col("reg")]).select(F.col("fixer").alias("_any"), F.lit(1).alias("_k"))
    x = issues.join(own, "type", "left").withColumn("_k", F.lit(1)).join(wild, "_k", "left").withColumn("fixer", F.coalesce("_own", "_any")).drop("_k", "_own", "_any")
    x = x.join(results.select("id", "fixer", "success", F.col("confidence").alias("given")), ["id", "fixer"], "left")
    x = H.calibrated(x, calibration, ["type", "fixer"], "given")
    decision = F.when(F.col("fixer").isNull(), "no_fixer").otherwise(S.gate(F.coalesce("success", F.lit(False)), F.col("confidence")))
    return x.select("id", "fixer", "confidence", decision.alias("decision"), (decision == "auto_apply").alias("applied"))


def bug(bugs: DataFrame, id, ord: str = "ord") -> DataFrame:
    """The first row of a bug's id, none if it isn't there."""
    return bugs.where(F.col("id") == id).orderBy(ord).limit(1)


def capability(agents: DataFrame, agent: str) -> DataFrame:
    """An agent's row, none if it isn't there."""
    return agents.where(F.col("agent") == agent)


def without(tasks: DataFrame, gone: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks but for those deleted by id."""
    return tasks.join(gone.select(key), key, "left_anti")


def metrics_files(spark: SparkSession, folder: str, pattern: str = "round-*.json") -> DataFrame:
    """(path, round_num, timestamp, task_count) of the metrics files that match, by path; those that can't be read drop out."""
    x = spark.read.schema(METRICS).option("multiLine", True).json(f"{folder}/{pattern}").select("*", F.col("_metadata.file_path").alias("path")).where("_corrupt_record IS NULL")
    x = x.select("path", F.coalesce("timer.round_num", "summary.last_round").alias("round_num"), F.col("summary.generated_at").alias("timestamp"), F.coalesce("tasks.summary.total", F.lit(0)).alias("task_count"))
    return x.orderBy("path")


def history_figures(rounds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rounds (result, lines_added, lines_removed, score_before, score_after): number, successes with their percentage, failures, sums of lines, and mean scores of the rounds that have one."""
    n, ok = F.count("*"), F.count_if(F.col("result") == "success")
    scored = F.col("score_before").isNotNull()
    mean = lambda c: F.bround(F.sum(F.when(scored, F.coalesce(c, F.lit(0)))) / F.nullif(F.count_if(scored), F.lit(0)), 0)
    return rounds.groupBy(*keys).agg(
        n.alias("total"), ok.alias("success"), F.bround(ok / F.greatest(n, F.lit(1)) * 100, 0).alias("percent"), F.count_if(F.col("result") == "failed").alias("failed"),
        F.coalesce(F.sum("lines_added"), F.lit(0)).alias("added"), F.coalesce(F.sum("lines_removed"), F.lit(0)).alias("removed"), mean(F.col("score_before")).alias("score_before"), mean(F.col("score_after")).alias("score_after"),
    )


def task_figures(tasks: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Tasks by status: completed, pending (all others), total, and the percentage completed to 1 place, 0 without tasks."""
    n, done = F.count("*"), F.count_if(F.col("status") == "completed")
    return tasks.groupBy(*keys).agg(done.alias("completed_tasks"), (n - done).alias("pending_tasks"), n.alias("total_tasks"), F.bround(done / F.greatest(n, F.lit(1)) * 100, 1).alias("success_rate"))


def sub_agent_rate(tasks: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of completed among completed and failed tasks, 0 without any."""
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return tasks.groupBy(*keys).agg(F.coalesce(F.try_divide(done.cast("double"), done + failed), F.lit(0.0)).alias("rate"))


def feedback_figures(marks: DataFrame, least: int = 2) -> DataFrame:
    """Of suppressed patterns (marks): how many are active, with ``least`` marks or more, and how many pending, with fewer but some."""
    return marks.agg(F.count_if(F.col("marks") >= least).alias("active_suppressions"), F.count_if((F.col("marks") > 0) & (F.col("marks") < least)).alias("pending_suppressions"))


def pending_items(states: DataFrame) -> DataFrame:
    """Approval items that wait for a decision; replied ones don't."""
    return states.where("status = 'pending'")


def task_types(tasks: DataFrame, registry: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Tasks (id, type, description) with their type's definition from the registry (id, definition), and the reason of the first forbidden entry (place, reason, examples) one of whose examples the description holds, whatever the case.

    The forbidden entries are a configuration's few: their examples are looked
    for in one pass over the tasks, without a join.
    """
    known = O.first_by(registry, ["id"], [F.col("place")]).select(F.col("id").alias("type"), "definition")
    rules = forbidden.orderBy("place").collect()
    low = F.lower(F.coalesce("description", F.lit("")))
    reason = F.coalesce(*(F.when(F.contains(low, F.lit(e.lower())), F.lit(r["reason"])) for r in rules for e in r["examples"] or [] if e is not None), F.lit(None).cast("string"))
    return tasks.join(known, "type", "left").withColumn("forbidden", reason)
