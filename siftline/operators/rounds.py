"""Rounds, delegations, agents and runs: statistics, choices and reports.

A round has round, task, approach, result, waste, lines_added and ord; ``keys``
name the columns that tell projects apart, none for one project.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import scalars as S
from . import history as H


def share(part: Column, whole: Column, places: int, empty: float = 0.0) -> Column:
    """part / whole, rounded half to even; ``empty`` of nothing."""
    return F.bround(F.when(whole > 0, part / whole).otherwise(F.lit(empty)), places)


def round_stats(rounds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rounds, successes, all others, and the rate of success to 3 places."""
    n, ok = F.count("*"), F.count_if(F.coalesce(F.col("result") == "success", F.lit(False)))
    return rounds.groupBy(*keys).agg(n.alias("total_rounds"), ok.alias("success_count"), (n - ok).alias("failed_count"), share(ok, n, 3).alias("overall_success_rate"))


def delegation_stats(rounds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The same of rounds whose approach or task speaks of delegating; 0 without any."""
    told = F.coalesce(F.contains("approach", F.lit("delegate")), F.lit(False)) | F.coalesce(F.contains("task", F.lit("delegate")), F.lit(False))
    n, ok = F.count_if(told), F.count_if(told & (F.col("result") == "success"))
    return rounds.groupBy(*keys).agg(n.alias("delegated_rounds"), ok.alias("delegate_success_count"), (n - ok).alias("delegate_failed_count"), share(ok, n, 3).alias("delegate_success_rate"))


def delegation_diagnosis(rounds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rates to 2 places by approach alone, 1 without rounds, and how often wasted delegations name each cause."""
    told = F.contains(F.lower(F.coalesce("approach", F.lit(""))), F.lit("delegate"))
    waste = F.lower(F.coalesce("waste", F.lit("")))
    ok = F.coalesce(F.col("result") == "success", F.lit(False))
    causes = [F.count_if(told & F.contains(waste, F.lit("delegate")) & F.contains(waste, F.lit(c))).alias(c) for c in V.DELEGATION_CAUSES]
    x = rounds.groupBy(*keys).agg(F.count_if(told).alias("delegated_rounds"), share(F.count_if(told & ok), F.count_if(told), 2, 1.0).alias("delegate_success_rate"), share(F.count_if(ok), F.count("*"), 2, 1.0).alias("overall_success_rate"), *causes)
    return x


def failure_patterns(rounds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rounds by class of failure, the first that their task and waste match."""
    kind = S.failure_class(F.concat_ws(" ", F.coalesce("task", F.lit("")), F.coalesce("waste", F.lit(""))))
    return rounds.select(*keys, kind.alias("pattern")).where("pattern IS NOT NULL").groupBy(*keys, "pattern").agg(F.count("*").alias("n"))


def failure_keywords(rounds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rounds by each keyword that their waste holds, whatever the case."""
    low = F.lower(F.coalesce("waste", F.lit("")))
    held = F.filter(F.array(*map(F.lit, V.FAILURE_KEYWORDS)), lambda k: F.contains(low, k))
    return rounds.select(*keys, F.explode(held).alias("keyword")).groupBy(*keys, "keyword").agg(F.count("*").alias("n"))


def capabilities(tasks: DataFrame, agent: str = "agent") -> DataFrame:
    """Agents by their tasks (success, tokens, failure, ord): tasks, successes, rate to 2 places, mean tokens, and failures in order of first sight."""
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    failed = tasks.where(~F.coalesce("success", F.lit(False)) & (F.coalesce("failure", F.lit("")) != "")).groupBy(F.col(agent).alias("_a"), "failure").agg(F.min("ord").alias("ord"))
    seen = failed.groupBy("_a").agg(F.array_sort(F.collect_list(F.struct("ord", "failure"))).alias("seen"))
    x = tasks.groupBy(F.col(agent).alias("agent")).agg(F.count("*").alias("tasks"), ok.alias("successes"), F.bround(F.avg(F.coalesce("tokens", F.lit(0))), 0).alias("mean_tokens"))
    x = x.join(seen, F.col("agent").eqNullSafe(F.col("_a")), "left")
    rate = F.bround(F.col("successes") / F.col("tasks"), 2)
    return x.select("agent", "tasks", "successes", rate.alias("success_rate"), "mean_tokens", F.coalesce(F.array_join("seen.failure", ", "), F.lit("")).alias("failures"))


def best_agents(agents: DataFrame, kinds: list[str], default: str = "agent-coder") -> DataFrame:
    """(task_type, agent): for each kind of task the first agent that may take it, by success rate, those without one last.

    A rate of 0.5 may take all; from 0.3 on small changes; an agent without tasks explores.
    """
    rate = F.col("success_rate")
    may = F.when(rate >= 0.5, F.lit(True)).when((F.col("tasks") == 0) & F.col("task_type").isin("elastic", "config_update"), True).otherwise((rate >= 0.3) & F.col("task_type").isin("incremental_modification", "config_update"))
    x = agents.withColumn("task_type", F.explode(F.array(*map(F.lit, kinds)))).where(may)
    best = x.groupBy("task_type").agg(F.min_by("agent", F.struct((rate == 0).alias("none"), (-rate).alias("r"), "ord")).alias("best"))
    wanted = agents.sparkSession.createDataFrame([(k,) for k in kinds], "task_type string")
    return wanted.join(best, "task_type", "left").select("task_type", F.coalesce("best", F.lit(default)).alias("agent"))


def calibration_as_of(records: DataFrame, keys: list[str], success: str, order: str, least: int = 3) -> DataFrame:
    """Records with the calibrated rate that held right after each; null before ``least`` of them."""
    x = H.running_sum(records.withColumn("_ok", F.col(success).cast("int")), keys, "_ok", order)
    rate = F.greatest(F.lit(0.1), F.least(F.lit(0.99), F.col("total") / F.col("samples")))
    return x.withColumn("calibrated", F.when(F.col("samples") >= least, F.bround(rate, 3))).select(*records.columns, "calibrated")


def rounds_until(scores: DataFrame, keys: list[str], converged: str, number: str, most: int = 15) -> DataFrame:
    """Rounds that a loop runs: up to the first that converged, ``most`` at most."""
    x = scores.where(F.col(number) <= most).groupBy(*keys)
    return x.agg(F.coalesce(F.min(F.when(F.col(converged), F.col(number))), F.max(number)).alias("rounds"), F.coalesce(F.max(F.col(converged)), F.lit(False)).alias("converged"))


def round_times(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rounds from their events (round, event start or end, at): start, end and seconds to 3 places.

    A round that has not ended is open; ends before a start and negative round numbers are left out.
    """
    x = events.where("round >= 0").groupBy(*keys, "round").agg(F.min(F.when(F.col("event") == "start", F.col("at"))).alias("start"), F.max(F.when(F.col("event") == "end", F.col("at"))).alias("end")).where("start IS NOT NULL")
    end = F.when(F.col("end") >= F.col("start"), F.col("end"))
    return x.select(*keys, "round", "start", end.alias("end"), F.bround((F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6, 3).alias("seconds"))


def current_and_last(times: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The open round (of several the latest) and the last one that ended."""
    return times.groupBy(*keys).agg(F.max(F.when(F.col("end").isNull(), F.col("round"))).alias("current"), F.max_by(F.when(F.col("end").isNotNull(), F.col("round")), F.col("end")).alias("last"))


def idle_excess(pools: DataFrame, threshold: int) -> DataFrame:
    """Pools with the number of idle members beyond the threshold."""
    return pools.withColumn("excess", F.greatest(F.coalesce("idle", F.lit(0)) - threshold, F.lit(0)))


def budget_warning(spent: Column, limit: Column) -> Column:
    """Whether nine tenths of a limit are spent; never without a limit."""
    return F.coalesce((limit > 0) & (spent >= 0.9 * limit), F.lit(False))


def stale(beats: DataFrame, now: Column, timeout: int, most: int = 3) -> DataFrame:
    """The oldest processes (.pid files) whose last sign is ``timeout`` seconds old, ``most`` at most."""
    age = F.unix_timestamp(now) - F.unix_timestamp("at")
    return beats.withColumn("age", age).where(F.endswith("name", F.lit(".pid")) & (F.col("age") >= timeout)).orderBy(F.desc("age"), "name").limit(most)


def expired(items: DataFrame, now: Column, hours: float) -> DataFrame:
    """Items with their age in hours and whether it passes ``hours``."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("at").cast("timestamp"))) / 3.6e9
    return items.withColumn("age_hours", age).withColumn("expired", age > hours)


def pipeline_result(fixes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counters of a fix run from its issues (file, attempted, decision, error), and the line that sums them up."""
    on = lambda v: F.count_if(F.col("attempted") & (F.col("decision") == v))
    tried, known = F.count_if("attempted"), ("auto_apply", "pending_review")
    x = fixes.groupBy(*keys).agg(
        F.countDistinct("file").alias("scanned_files"), F.count("*").alias("issues_found"), tried.alias("fixes_attempted"), on("auto_apply").alias("auto_applied"), on("pending_review").alias("pending_review"),
        F.count_if(F.col("attempted") & ~F.coalesce(F.col("decision").isin(*known), F.lit(False))).alias("rejected"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    line = F.format_string("扫描 %d 个问题 → 尝试修复 %d → 自动应用 %d, 待审批 %d, 拒绝 %d, 失败 %d", "issues_found", "fixes_attempted", "auto_applied", "pending_review", "rejected", "errors")
    return x.withColumn("summary", line)


def target_totals(findings: DataFrame, target: str = "target") -> DataFrame:
    """Findings by target, and of all targets together in a row without a name."""
    return findings.rollup(target).agg(F.count("*").alias("n"))


def latest_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Runs by when they finished, or else started, the last ones first; those still running before all."""
    return runs.withColumn("_at", F.coalesce(F.nullif("finished_at", F.lit("")), F.col("started_at"))).orderBy(F.desc(F.col("status") == "running"), F.desc("_at"), "run_id").limit(limit).drop("_at")


def merged_runs(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Runs, and those logs whose start no run has; of logs that started together the last by name."""
    fresh = logs.join(runs.select("started_at").distinct(), "started_at", "left_anti")
    fresh = fresh.groupBy("started_at").agg(F.max_by(F.struct(*(c for c in logs.columns if c != "started_at")), "run_id").alias("l")).select("started_at", "l.*")
    return runs.unionByName(fresh, allowMissingColumns=True)


def run_progress(events: DataFrame, fields: list[str]) -> DataFrame:
    """The record of each run from its updates (run_id, ord): later values of a field win, nulls change nothing."""
    return events.groupBy("run_id").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in fields))


def dimension_summary(logs: DataFrame, most: int = 9) -> DataFrame:
    """(run_id, dimension, score, issues, label) of the first ``most`` dimensions of each log (run_id, dimensions array)."""
    x = logs.select("run_id", F.posexplode(F.slice("dimensions", 1, most)).alias("place", "d"))
    return x.select("run_id", "place", F.col("d.name").alias("dimension"), F.coalesce("d.score", F.lit(0)).alias("score"), F.coalesce("d.issue_count", F.lit(0)).alias("issues"), F.coalesce("d.label", "d.name").alias("label"))


def log_tail(lines: DataFrame, wanted: int, order: str = "line_no") -> DataFrame:
    """The last lines of a log, between 10 and 200 of them."""
    return lines.orderBy(F.desc(order)).limit(max(10, min(200, wanted))).orderBy(order)


def timer_totals(rounds: DataFrame, key: str) -> DataFrame:
    """(key, total_rounds, total_seconds, mean_seconds): rounds (round, start, seconds) of each project, the seconds to 3 places.

    Seconds are added in the order of rounds: a mean that lies halfway goes by the
    last bits of its sum, which another order changes.
    """
    so_far = F.sum("seconds").over(Window.partitionBy(key).orderBy("round", "start", "seconds").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = rounds.select(key, F.struct("round", "start", "seconds").alias("at"), "seconds", so_far.alias("sum")).groupBy(key).agg(F.count("*").alias("total_rounds"), F.max_by("sum", "at").alias("sum"), F.count("seconds").alias("n"))
    return x.select(key, "total_rounds", F.bround("sum", 3).alias("total_seconds"), F.bround(F.try_divide("sum", "n"), 3).alias("mean_seconds"))


def text_report(timer: DataFrame, rounds: DataFrame, tasks: DataFrame, agents: DataFrame, issues: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """(key, report): the text report of each project, from tables of one row a project but for rounds, agents and categories.

    timer: total_rounds, total_seconds, mean_seconds; rounds: round, start,
    seconds (the last five show); tasks: total, completed, failed, skipped,
    pass_rate; agents: agent and the same counts; issues: total, weighted and a count
    by severity; categories: category, n (the five most frequent show).
    """
    bar, rule = "=" * 60, lambda t: f"─── {t} ───"
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("round"), F.desc("start"), F.desc("seconds")))
    last = F.array_sort(F.collect_list(F.struct("round", "start", "seconds")))
    shown = rounds.withColumn("_p", place).where(F.col("_p") <= 5).groupBy(key).agg(F.transform(last, lambda r: F.format_string("  Round %3d | %s | %8.3fs", r["round"], r["start"], r["seconds"])).alias("rounds"))
    team = agents.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("agent", "completed", "failed", "skipped", "total"))), lambda a: F.format_string("  %-15s %5d %5d %5d %5d", *(a[c] for c in ("agent", "completed", "failed", "skipped", "total")))).alias("agents"))
    most = categories.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category"))), 1, 5).alias("c"))
    most = most.select(key, F.transform("c", lambda c: F.format_string("    %-20s: %d", c["category"], -c["m"])).alias("categories"))
    joined = reduce(lambda a, b: a.join(b, key, "left"), [timer, shown, tasks.select(key, *(F.col(c).alias(f"t_{c}") for c in ("total", "completed", "failed", "skipped", "pass_rate"))), team, issues, most])
    some = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.array(F.lit(title)), xs, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    line = lambda text, *c: F.array(F.format_string(text, *(F.coalesce(x, F.lit(0)) for x in c)))
    severities = F.array_compact(F.array(*(F.when(F.coalesce(F.col(s), F.lit(0)) > 0, F.format_string(f"    {s:<10s}: %d", s)) for s in V.ISSUE_WEIGHTS)))
    col = F.col
    parts = [
        F.array(*map(F.lit, [bar, rule("轮次计时")])), line("  已完成轮次: %d", col("total_rounds")), line("  总耗时: %.3f 秒", F.coalesce("total_seconds", F.lit(0.0))),
        F.when(col("mean_seconds").isNotNull(), F.array(F.format_string("  平均耗时: %.3f 秒", "mean_seconds"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("")), some(rule("轮次详情"), F.coalesce("rounds", F.array().cast("array<string>"))),
        F.array(F.lit(rule("任务追踪"))), line("  总数: %d", col("t_total")), line("  完成: %d", col("t_completed")), line("  失败: %d", col("t_failed")), line("  跳过: %d", col("t_skipped")),
        F.when(col("t_pass_rate").isNotNull(), F.array(F.format_string("  通过率: %.2f%%", col("t_pass_rate") * 100))).otherwise(F.array().cast("array<string>")), F.array(F.lit("")), some(rule("Agent 统计"), F.coalesce("agents", F.array().cast("array<string>"))),
        F.array(F.lit(rule("问题统计"))), line("  问题总数: %d", col("total")), line("  加权得分: %d", col("weighted")), F.array(F.lit("")), some("  按严重级别:", severities), some("  按类别（Top 5）:", F.coalesce("categories", F.array().cast("array<string>"))), F.array(F.lit(bar)),
    ]
    return joined.select(key, F.array_join(F.concat(*parts), "\n").alias("report"))


def json_report(timer: DataFrame, tasks: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(key, report): the same figures as one JSON object."""
    x = timer.join(tasks.select(key, F.struct("total", "completed", "failed", "pass_rate").alias("tasks")), key, "left").join(issues.select(key, F.struct("total", F.col("weighted").alias("weighted_score"), F.struct(*V.ISSUE_WEIGHTS).alias("frequency_by_severity")).alias("issues")), key, "left")
    return x.select(key, F.to_json(F.struct(F.struct("total_rounds", F.col("total_seconds").alias("total_duration_sec"), F.col("mean_seconds").alias("average_duration_sec")).alias("timer"), "tasks", "issues")).alias("report"))


def scan_report(scores: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """(key, report): Markdown with a heading for each dimension (dimension, score) and its findings (dimension, severity, file, line, description, ord)."""
    item = F.concat(F.lit("- **["), F.col("severity"), F.lit("]** `"), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("` "), F.col("description"))
    listed = findings.groupBy(key, "dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(S.rank(F.col("severity"), 9).alias("r"), "ord", item.alias("item")))), lambda x: x["item"]), "\n").alias("items"), F.count("*").alias("n"))
    x = scores.join(listed, [key, "dimension"], "left")
    block = F.concat(F.lit("## "), F.col("dimension"), F.lit(" "), F.col("score").cast("string"), F.lit("/100 ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")\n"), F.coalesce("items", F.lit("")))
    return x.select(key, "dimension", block.alias("block")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "block"))), lambda b: b["block"]), "\n\n").alias("report"))
