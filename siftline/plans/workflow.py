"""Rounds, experience and issues bound to the driver's tables, each with its SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import scalars as S
from ..operators import experience as E
from ..operators import findings as O
from ..operators import history as H
from ..operators import issues as I
from ..operators import rounds as R
from . import bindings as B
from .bindings import BUCKET, FAMILY, FIND, RANK, finds, listed, query, sql_map, t


def choose(values, e: str):
    """One of ``values`` by the remainder of an expression."""
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"CAST(({e}) % {len(values)} + 1 AS INT)"))


def choose_sql(values, e: str) -> str:
    return f"([{listed(values)}])[({e}) % {len(values)} + 1]"


# ---- rounds: events play rounds, users projects

APPROACH = ["delegate fix", "edit by hand", "Delegate review"]
WASTE = ["mock import failed", "timeout hit", "venv pip install", "cd to delegate environment", "fine", ""]
RD = f"rd AS (SELECT user_id, event_id AS round, event_id AS ord, ts, value, {choose_sql(APPROACH, 'event_id')} AS approach, {choose_sql(WASTE, 'event_id // 2')} AS waste, CASE WHEN event_id % 11 = 0 THEN 'delegate ' ELSE 'fix ' END || event_type AS task, CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END AS result FROM events)"


def rounds(s, d):
    return t(s, d, "events").select(
        "user_id", F.col("event_id").alias("round"), F.col("event_id").alias("ord"), "ts", "value", choose(APPROACH, "event_id").alias("approach"), choose(WASTE, "event_id DIV 2").alias("waste"),
        F.concat(F.when(F.col("event_id") % 11 == 0, "delegate ").otherwise("fix "), "event_type").alias("task"), F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("result"),
    )


@query("round_stats", f"WITH {RD} SELECT user_id, count(*) AS total_rounds, count_if(result = 'success') AS success_count, count_if(result <> 'success') AS failed_count, round_even(count_if(result = 'success') / count(*), 3) AS overall_success_rate FROM rd GROUP BY user_id")
def round_stats(s, d):
    return R.round_stats(rounds(s, d), ["user_id"])


@query("delegation_stats", f"WITH {RD}, g AS (SELECT user_id, count(*) AS n, count_if(result = 'success') AS ok FROM rd WHERE contains(approach, 'delegate') OR contains(task, 'delegate') GROUP BY user_id) SELECT user_id, coalesce(n, 0) AS delegated_rounds, coalesce(ok, 0) AS delegate_success_count, coalesce(n - ok, 0) AS delegate_failed_count, coalesce(round_even(ok / n, 3), 0) AS delegate_success_rate FROM (SELECT DISTINCT user_id FROM rd) LEFT JOIN g USING (user_id)")
def delegation_stats(s, d):
    return R.delegation_stats(rounds(s, d), ["user_id"])


CAUSES = ", ".join(f"count_if(contains(lower(approach), 'delegate') AND contains(waste, 'delegate') AND contains(waste, '{c}')) AS {c}" for c in V.DELEGATION_CAUSES)


@query("delegation_diagnosis", f"WITH {RD} SELECT user_id, count_if(contains(lower(approach), 'delegate')) AS delegated_rounds, coalesce(round_even(count_if(contains(lower(approach), 'delegate') AND result = 'success') / nullif(count_if(contains(lower(approach), 'delegate')), 0), 2), 1) AS delegate_success_rate, round_even(count_if(result = 'success') / count(*), 2) AS overall_success_rate, {CAUSES} FROM rd GROUP BY user_id")
def delegation_diagnosis(s, d):
    return R.delegation_diagnosis(rounds(s, d), ["user_id"])


@query("failure_patterns", f"WITH {RD}, p AS (SELECT user_id, CASE " + " ".join(f"WHEN regexp_matches(task || ' ' || waste, '{p}') THEN '{n}'" for p, n in V.FAILURES) + " END AS pattern FROM rd) SELECT user_id, pattern, count(*) AS n FROM p WHERE pattern IS NOT NULL GROUP BY ALL")
def failure_patterns(s, d):
    return R.failure_patterns(rounds(s, d), ["user_id"])


@query("failure_keywords", f"WITH {RD}, k AS (SELECT unnest([{listed(V.FAILURE_KEYWORDS)}]) AS keyword) SELECT user_id, keyword, count(*) AS n FROM rd JOIN k ON contains(lower(waste), keyword) GROUP BY ALL")
def failure_keywords(s, d):
    return R.failure_keywords(rounds(s, d), ["user_id"])


CAP = f"""x AS (SELECT user_id, event_id AS ord, value < 40 AS success, event_id % 1000 AS tokens, {choose_sql(WASTE, 'event_id // 2')} AS failure FROM events),
f AS (SELECT user_id, string_agg(failure, ', ' ORDER BY o) AS failures FROM (SELECT user_id, failure, min(ord) AS o FROM x WHERE NOT success AND failure <> '' GROUP BY ALL) GROUP BY user_id),
cap AS (SELECT 'a' || x.user_id AS agent, x.user_id AS ord, count(*) AS tasks, count_if(success) AS successes, round_even(count_if(success) / count(*), 2) AS success_rate, round_even(avg(tokens), 0) AS mean_tokens, coalesce(any_value(failures), '') AS failures FROM x LEFT JOIN f USING (user_id) GROUP BY x.user_id)"""


def agents(s, d):
    x = t(s, d, "events").select("user_id", F.col("event_id").alias("ord"), (F.col("value") < 40).alias("success"), (F.col("event_id") % 1000).alias("tokens"), choose(WASTE, "event_id DIV 2").alias("failure"))
    return R.capabilities(x.withColumn("agent", F.concat(F.lit("a"), F.col("user_id").cast("string"))))


@query("agent_capabilities", f"WITH {CAP} SELECT * EXCLUDE (ord) FROM cap")
def agent_capabilities(s, d):
    return agents(s, d)


KINDS = ["elastic", "config_update", "incremental_modification", "code_review"]


@query("best_agents", f"WITH {CAP}, k AS (SELECT unnest([{listed(KINDS)}]) AS task_type), c AS (SELECT task_type, agent, row_number() OVER (PARTITION BY task_type ORDER BY success_rate = 0, success_rate DESC, ord) AS r FROM k JOIN cap ON success_rate >= 0.5 OR (success_rate >= 0.3 AND task_type IN ('incremental_modification', 'config_update'))) SELECT k.task_type, coalesce(agent, 'agent-coder') AS agent FROM k LEFT JOIN c ON c.task_type = k.task_type AND r = 1")
def best_agents(s, d):
    return R.best_agents(agents(s, d).withColumn("ord", F.substring("agent", 2, 20).cast("long")), KINDS)


@query("calibration_as_of", f"WITH {B.EX} SELECT ord, CASE WHEN count(*) OVER w >= 3 THEN round_even(greatest(0.1, least(0.99, avg(CAST(success AS INTEGER)) OVER w)), 3) END AS calibrated FROM x WINDOW w AS (PARTITION BY type, fixer ORDER BY ord ROWS UNBOUNDED PRECEDING)")
def calibration_as_of(s, d):
    return R.calibration_as_of(B.experience(s, d), ["type", "fixer"], "success", "ord").select("ord", "calibrated")


@query("rounds_until", f"WITH {B.DAILY}, c AS (SELECT event_type, date, row_number() OVER (PARTITION BY event_type ORDER BY date) AS number, count(score) OVER v = 3 AND max(score) OVER v - min(score) OVER v <= 3 AS converged FROM day WINDOW v AS (PARTITION BY event_type ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT event_type, coalesce(min(CASE WHEN converged THEN number END), max(number)) AS rounds, bool_or(converged) AS converged FROM c WHERE number <= 15 GROUP BY event_type")
def rounds_until(s, d):
    x = B.convergence(s, d).withColumn("number", F.row_number().over(Window.partitionBy("event_type").orderBy("date")).cast("long"))
    return R.rounds_until(x, ["event_type"], "converged", "number")


TIMES = """e AS (SELECT user_id, event_id // 40 AS round, CASE WHEN event_id % 40 < 20 THEN 'start' ELSE 'end' END AS event, ts AS w FROM events),
g AS (SELECT user_id, round, min(CASE WHEN event = 'start' THEN w END) AS start, max(CASE WHEN event = 'end' THEN w END) AS stop FROM e GROUP BY ALL),
ti AS (SELECT user_id, round, start, CASE WHEN stop >= start THEN stop END AS stop FROM g WHERE start IS NOT NULL)"""


def times(s, d):
    e = t(s, d, "events").select("user_id", F.expr("event_id DIV 40").alias("round"), F.when(F.col("event_id") % 40 < 20, "start").otherwise("end").alias("event"), F.col("ts").alias("at"))
    return R.round_times(e, ["user_id"])


@query("round_times", f"WITH {TIMES}, m AS (SELECT user_id, round, epoch_us(stop) - epoch_us(start) AS us FROM ti) SELECT user_id, round, (us // 1000 + CASE WHEN us % 1000 > 500 OR (us % 1000 = 500 AND us // 1000 % 2 = 1) THEN 1 ELSE 0 END) / 1000 AS seconds FROM m")
def round_times(s, d):
    return times(s, d).select("user_id", "round", "seconds")


@query("round_now", f"WITH {TIMES} SELECT user_id, max(CASE WHEN stop IS NULL THEN round END) AS current, arg_max(round, stop) AS last FROM ti GROUP BY user_id")
def round_now(s, d):
    return R.current_and_last(times(s, d), ["user_id"])


@query("idle_pools", "SELECT s_suppkey, greatest(s_nationkey - 10, 0) AS excess, s_acctbal >= 0.9::DOUBLE * 5000 AS warn FROM supplier")
def idle_pools(s, d):
    x = R.idle_excess(t(s, d, "supplier").withColumn("idle", F.col("s_nationkey")), 10)
    return x.select("s_suppkey", "excess", R.budget_warning(F.col("s_acctbal"), F.lit(5000)).alias("warn"))


@query("stale_beats", "SELECT 'p' || user_id || '.pid' AS name, min(ts) AS at FROM events WHERE user_id % 2 = 0 GROUP BY user_id HAVING epoch(TIMESTAMP '2030-01-01') - epoch(min(ts)) >= 3600 ORDER BY date_trunc('second', min(ts)), 1 LIMIT 3")
def stale_beats(s, d):
    beats = t(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("at")).select(F.concat(F.lit("p"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, ".pid").otherwise(".log")).alias("name"), "at")
    return R.stale(beats, F.lit("2030-01-01").cast("timestamp"), 3600).select("name", "at")


@query("expired_items", "SELECT event_id, round((epoch_us(TIMESTAMP '2024-01-05') - epoch_us(ts)) / 3.6e9, 6) AS age_hours, (epoch_us(TIMESTAMP '2024-01-05') - epoch_us(ts)) / 3.6e9 > 72 AS expired FROM events")
def expired_items(s, d):
    return R.expired(t(s, d, "events").withColumn("at", F.col("ts")), F.lit("2024-01-05").cast("timestamp"), 72).select("event_id", F.round("age_hours", 6).alias("age_hours"), "expired")


FX = f"""fx AS (SELECT user_id, event_id, 'f' || (event_id % 30) AS file, event_id % 5 <> 0 AS attempted, {choose_sql(["auto_apply", "pending_review", "rejected"], 'event_id // 3')} AS decision, CASE WHEN event_type = 'error' THEN 'e' END AS error FROM events)"""


@query("pipeline_results", f"""WITH {FX}, c AS (SELECT user_id, count(DISTINCT file) AS scanned_files, count(*) AS issues_found, count_if(attempted) AS fixes_attempted, count_if(attempted AND decision = 'auto_apply') AS auto_applied, count_if(attempted AND decision = 'pending_review') AS pending_review, count_if(attempted AND decision = 'rejected') AS rejected, count(error) AS errors FROM fx GROUP BY user_id)
SELECT *, '扫描 ' || issues_found || ' 个问题 → 尝试修复 ' || fixes_attempted || ' → 自动应用 ' || auto_applied || ', 待审批 ' || pending_review || ', 拒绝 ' || rejected || ', 失败 ' || errors AS summary FROM c""")
def pipeline_results(s, d):
    x = t(s, d, "events").select("user_id", F.concat(F.lit("f"), (F.col("event_id") % 30).cast("string")).alias("file"), (F.col("event_id") % 5 != 0).alias("attempted"), choose(["auto_apply", "pending_review", "rejected"], "event_id DIV 3").alias("decision"), F.when(F.col("event_type") == "error", "e").alias("error"))
    return R.pipeline_result(x, ["user_id"])


@query("target_totals", "SELECT event_type AS target, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def target_totals(s, d):
    return R.target_totals(t(s, d, "events"), "event_type").withColumnRenamed("event_type", "target")


@query("lines_written", "SELECT event_id, CAST(sum(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS written FROM events")
def lines_written(s, d):
    x = H.running_sum(t(s, d, "events").withColumn("n", F.col("event_id") % 50), ["user_id"], "n", "event_id")
    return x.select("event_id", F.col("total").alias("written"))


@query("category_top", "SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def category_top(s, d):
    return t(s, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(5)


@query("recent_rounds", f"WITH {RD} SELECT user_id, round FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round DESC) AS k FROM rd) WHERE k <= 5")
def recent_rounds(s, d):
    return H.tail(rounds(s, d), 5, ["round"], ["user_id"]).select("user_id", "round")


RUNS = "ru AS (SELECT 'r' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'done' END AS status, strftime(o_orderdate, '%Y-%m-%d') || o_orderkey AS started_at, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') END AS finished_at FROM orders)"


def runs(s, d):
    return t(s, d, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string")).alias("started_at"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.date_format(F.date_add("o_orderdate", 9), "yyyy-MM-dd")).alias("finished_at"))


@query("latest_runs", f"WITH {RUNS} SELECT run_id, status FROM ru ORDER BY status = 'running' DESC, coalesce(nullif(finished_at, ''), started_at) DESC, run_id LIMIT 20")
def latest_runs(s, d):
    return R.latest_runs(runs(s, d)).select("run_id", "status")


@query("merged_runs", f"WITH {RUNS}, a AS (SELECT * FROM ru WHERE CAST(substr(run_id, 2) AS BIGINT) % 2 = 0), b AS (SELECT 'log' || run_id AS run_id, status, started_at, finished_at FROM ru WHERE CAST(substr(run_id, 2) AS BIGINT) % 3 = 0) SELECT run_id, status, started_at, finished_at FROM a UNION ALL SELECT * FROM b WHERE started_at NOT IN (SELECT started_at FROM a)")
def merged_runs(s, d):
    n = F.substring("run_id", 2, 20).cast("long")
    return R.merged_runs(runs(s, d).where(n % 2 == 0), runs(s, d).where(n % 3 == 0).withColumn("run_id", F.concat(F.lit("log"), "run_id"))).select("run_id", "status", "started_at", "finished_at")


@query("run_progress", "SELECT conv_id AS run_id, arg_max(role, turn) AS phase, arg_max(CASE WHEN turn % 2 = 0 THEN length(text) END, CASE WHEN turn % 2 = 0 THEN turn END) AS chars FROM conversations GROUP BY conv_id")
def run_progress(s, d):
    x = t(s, d, "conversations").groupBy(F.col("conv_id").alias("run_id"), F.col("turn").alias("ord")).agg(F.max("role").alias("phase"), F.max(F.when(F.col("turn") % 2 == 0, F.length("text").cast("long"))).alias("chars"))
    return R.run_progress(x, ["phase", "chars"])


B.ORACLES["run_progress"] = "WITH c AS (SELECT conv_id, turn, max(role) AS role, max(CASE WHEN turn % 2 = 0 THEN length(text) END) AS n FROM conversations GROUP BY ALL) SELECT conv_id AS run_id, arg_max(role, turn) AS phase, arg_max(n, turn) AS chars FROM c GROUP BY conv_id"


@query("dimension_summaries", """WITH c AS (SELECT user_id AS run_id, event_type || event_id % 3 AS name, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY name) - 1 AS place FROM c)
SELECT run_id, CAST(place AS INTEGER) AS place, name AS dimension, CASE WHEN n % 2 = 0 THEN n % 100 ELSE 0 END AS score, n AS issues, CASE WHEN n % 3 = 0 THEN name ELSE 'has ' || n END AS label FROM p WHERE place < 9""")
def dimension_summaries(s, d):
    c = t(s, d, "events").groupBy(F.col("user_id").alias("run_id"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("name")).agg(F.count("*").alias("n"))
    dim = F.struct("name", F.when(F.col("n") % 2 == 0, F.col("n") % 100).alias("score"), F.col("n").alias("issue_count"), F.when(F.col("n") % 3 != 0, F.concat(F.lit("has "), F.col("n").cast("string"))).alias("label"))
    return R.dimension_summary(c.groupBy("run_id").agg(F.array_sort(F.collect_list(dim)).alias("dimensions")))


@query("log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def log_tail(s, d):
    return R.log_tail(t(s, d, "events").select("event_id", "event_type"), 3, "event_id")


REPORT = f"""WITH {RD}, u AS (SELECT user_id, count(*) AS n, round_even(sum(value), 3) AS total, round_even(avg(value), 3) AS mean FROM rd GROUP BY user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round DESC) AS r FROM rd), l AS (SELECT user_id, string_agg(format('  Round {{:3d}} | {{}} | {{:8.3f}}s', round, strftime(ts, '%Y-%m-%dT%H:%M:%S'), value), chr(10) ORDER BY round) AS lines FROM k WHERE r <= 5 GROUP BY user_id),
c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, string_agg(format('    {{:<20s}}: {{}}', event_type, n), chr(10) ORDER BY n DESC, event_type) AS cats FROM c GROUP BY user_id),
q AS (SELECT user_id, count(*) AS n, count_if(event_type = 'purchase') AS a, count_if(event_type = 'error') AS b, count_if(event_type = 'signup') AS e FROM events GROUP BY user_id)
SELECT user_id, md5(concat_ws(chr(10), repeat('=', 60), '─── 轮次计时 ───', '  已完成轮次: ' || u.n, format('  总耗时: {{:.3f}} 秒', total), format('  平均耗时: {{:.3f}} 秒', mean), '', '─── 轮次详情 ───', lines, '', '─── 任务追踪 ───', '  总数: ' || q.n, '  完成: ' || a, '  失败: ' || b, '  跳过: ' || e,
  CASE WHEN a + b > 0 THEN format('  通过率: {{:.2f}}%', round_even(a / (a + b), 4) * 100) END, '', '─── Agent 统计 ───', format('  {{:<15s}} {{:5d}} {{:5d}} {{:5d}} {{:5d}}', 'u' || user_id, a, b, e, q.n), '', '─── 问题统计 ───', '  问题总数: ' || q.n, '  加权得分: ' || (40 * b + 20 * (q.n - b)), '', '  按严重级别:',
  CASE WHEN b > 0 THEN '    error     : ' || b END, CASE WHEN q.n > b THEN '    info      : ' || (q.n - b) END, '', '  按类别（Top 5）:', cats, '', repeat('=', 60))) AS digest FROM u JOIN l USING (user_id) JOIN m USING (user_id) JOIN q USING (user_id)"""


def report_parts(s, d):
    x, e = rounds(s, d), t(s, d, "events")
    timer = R.timer_totals(x.select("user_id", "round", F.col("ts").alias("start"), F.col("value").alias("seconds")), "user_id")
    done, failed, skipped = (F.count_if(F.col("event_type") == k) for k in ("purchase", "error", "signup"))
    tasks = e.groupBy("user_id").agg(F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), skipped.alias("skipped"), H.rate(done, failed).alias("pass_rate"))
    level = lambda k: F.count_if((F.col("event_type") == "error") == F.lit(k == "error")) if k in ("error", "info") else F.lit(0).cast("long")
    issues = e.groupBy("user_id").agg(F.count("*").alias("total"), (40 * failed + 20 * (F.count("*") - failed)).alias("weighted"), *(level(k).alias(k) for k in V.ISSUE_WEIGHTS))
    return timer, x, tasks, issues, e


@query("text_reports", REPORT)
def text_reports(s, d):
    timer, x, tasks, issues, e = report_parts(s, d)
    team = tasks.withColumn("agent", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    shown = x.select("user_id", "round", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), F.col("value").alias("seconds"))
    out = R.text_report(timer, shown, tasks, team, issues, e.groupBy("user_id", F.col("event_type").alias("category")).agg(F.count("*").alias("n")), "user_id")
    return out.select("user_id", F.md5("report").alias("digest"))


@query("json_reports", f"WITH {RD}, u AS (SELECT user_id, count(*) AS n, count_if(result = 'success') AS a FROM rd GROUP BY user_id), q AS (SELECT user_id, count_if(event_type = 'error') AS b FROM events GROUP BY user_id) SELECT user_id, n AS rounds, a AS completed, b AS failed, 40 * b + 20 * (n - b) AS weighted, b AS errors FROM u JOIN q USING (user_id)")
def json_reports(s, d):
    timer, _, tasks, issues, _ = report_parts(s, d)
    x = R.json_report(timer, tasks, issues, "user_id")
    get = lambda p: F.get_json_object("report", f"$.{p}").cast("long")
    return x.select("user_id", get("timer.total_rounds").alias("rounds"), get("tasks.completed").alias("completed"), get("tasks.failed").alias("failed"), get("issues.weighted_score").alias("weighted"), get("issues.frequency_by_severity.error").alias("errors"))


@query("scan_reports", f"""WITH {FIND}, i AS (SELECT file, dimension, string_agg('- **[' || severity || ']** `' || file || ':' || line || '` ' || type, chr(10) ORDER BY {RANK}, ord) AS items, count(*) AS n FROM f GROUP BY ALL)
SELECT file, md5(string_agg('## ' || dimension || ' 80/100 (' || n || ')' || chr(10) || items, chr(10) || chr(10) ORDER BY dimension)) AS digest FROM i GROUP BY file""")
def scan_reports(s, d):
    x = finds(s, d).withColumn("description", F.col("type")).withColumn("key", F.col("file"))
    scores = x.select("key", "dimension").distinct().withColumn("score", F.lit(80))
    return R.scan_report(scores, x, "key").select(F.col("key").alias("file"), F.md5("report").alias("digest"))


# ---- experience: events play records of fixes

KIND = ["sql_injection", "command_injection", "ssrf_vulnerability", "secret_leak", "custom", "bare_except", "swallowed_exception"]
FILES = ["src/a.py", "src/core/b.py", "lib/util/c.py", "d", "x/y/z/e.js"]
CODE = ['cur.execute(f"SELECT {x}")', "os.system(c)", "requests.get(u)", "# note\nk = 1", ""]
ERRORS = ["", "timeout", "syntax", "lost"]
XP = f"""xp AS (SELECT event_id AS ord, event_id AS id, {choose_sql(KIND, 'event_id')} AS type, {choose_sql(FILES, 'event_id // 7')} AS file, event_id % 60 AS line, 'edit line ' || (event_id % 9) || ' of /src/m' || (event_id % 4) || '.py' AS action, 'fix' || (user_id % 12) AS fixer, value < 40 AS success,
  (event_id % 10) / 10 AS confidence, replace({choose_sql([c.replace(chr(10), '~') for c in CODE], 'event_id // 3')}, '~', chr(10)) AS code_before, 'safe' || (event_id % 3) AS code_after, {choose_sql(ERRORS, 'event_id // 5')} AS error, ts FROM events)"""


def fixes(s, d):
    n = F.col("event_id")
    return t(s, d, "events").select(
        n.alias("ord"), n.alias("id"), choose(KIND, "event_id").alias("type"), choose(FILES, "event_id DIV 7").alias("file"), (n % 60).alias("line"), F.concat(F.lit("edit line "), (n % 9).cast("string"), F.lit(" of /src/m"), (n % 4).cast("string"), F.lit(".py")).alias("action"),
        F.concat(F.lit("fix"), (F.col("user_id") % 12).cast("string")).alias("fixer"), (F.col("value") < 40).alias("success"), ((n % 10) / 10).alias("confidence"), choose(CODE, "event_id DIV 3").alias("code_before"), F.concat(F.lit("safe"), (n % 3).cast("string")).alias("code_after"), choose(ERRORS, "event_id DIV 5").alias("error"), "ts",
    )


@query("experience_keys", f"""WITH {XP} SELECT id, left(md5(type || ':' || file || ':' || action || ':' || strftime(ts, '%Y%m%d%H')), 10) AS key, sha256(fixer || '::' || action) AS cache, replace(regexp_replace(action, 'line \\d+', 'line N'), '/src/m' || (id % 4) || '.py', '<FILE>') AS action,
CASE file WHEN 'src/a.py' THEN 'src/*.py' WHEN 'src/core/b.py' THEN 'src/core/*.py' WHEN 'lib/util/c.py' THEN 'lib/util/*.py' WHEN 'd' THEN '**' ELSE 'y/z/*.js' END AS pattern FROM xp""")
def experience_keys(s, d):
    c = F.col
    return fixes(s, d).select("id", E.experience_id(c("type"), c("file"), c("action"), c("ts")).alias("key"), E.cache_key(c("fixer"), c("action")).alias("cache"), E.action_key(c("action")).alias("action"), E.file_pattern(c("file")).alias("pattern"))


NORM = "replace(regexp_replace(action, 'line \\d+', 'line N'), '/src/m' || (id % 4) || '.py', '<FILE>')"
PT = f"""{XP}, ok AS (SELECT *, CASE WHEN code_before <> '' THEN '__code__' || left(code_before, 100) ELSE {NORM} END AS pattern, length(file) - length(replace(file, '/', '')) AS depth FROM xp WHERE success AND confidence >= 0.5),
pt AS (SELECT type, pattern, count(*) AS successes, avg(confidence) AS mean_confidence, arg_max(fixer, ord) AS fixer, arg_max(action, ord) AS action, any_value(code_before) AS code_before, arg_min(code_after, ord) AS code_after, arg_min(file, (depth, file)) AS shortest, min(ord) AS first FROM ok GROUP BY type, pattern),
pa AS (SELECT *, CASE WHEN contains(shortest, '/') THEN regexp_extract(shortest, '^(.*)/[^/]*$', 1) || '/*' ELSE '*' END AS files, CAST(row_number() OVER (PARTITION BY type ORDER BY successes DESC, mean_confidence DESC, first) AS INTEGER) AS place FROM pt)"""


@query("fix_patterns", f"WITH {PT} SELECT type, pattern, successes, round(mean_confidence, 9) AS mean_confidence, fixer, action, code_before, CASE WHEN code_before <> '' THEN code_after ELSE '' END AS code_after, files FROM pa")
def fix_patterns(s, d):
    x = E.fix_patterns(fixes(s, d))
    return x.select("type", "pattern", "successes", F.round("mean_confidence", 9).alias("mean_confidence"), "fixer", "action", "code_before", F.when(F.col("code_before") != "", F.col("code_after")).otherwise("").alias("code_after"), "files")


WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"


@query("best_patterns", f"""WITH {PT}, i AS (SELECT id, type, file, {WORDS.format("'fix ' || code_before")} AS words FROM xp WHERE id % 3 = 0), p AS (SELECT type, pattern, files, place, {WORDS.format('code_before')} AS pw FROM pa),
j AS (SELECT id, pattern, place, 0.4::DOUBLE * CASE WHEN array_extract(string_split(files, '/'), -2) = array_extract(string_split(file, '/'), -2) THEN 1.0 WHEN contains(array_extract(string_split(file, '/'), -1), '.') AND ends_with(array_extract(string_split(files, '/'), -1), regexp_extract(file, '[.]([^.]*)$', 1)) THEN 0.5 ELSE 0.1 END::DOUBLE
  + 0.6::DOUBLE * CASE WHEN len(words) > 0 AND len(pw) > 0 THEN len(list_intersect(words, pw)) / (len(words) + len(pw) - len(list_intersect(words, pw))) ELSE 0 END AS score FROM i JOIN p USING (type)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, place) AS k FROM j) SELECT id, round(score, 6) AS score FROM r WHERE k = 1 AND score >= 0.3""")
def best_patterns(s, d):
    x = fixes(s, d)
    issues = x.where("id % 3 = 0").select("id", "type", "file", F.concat(F.lit("fix "), "code_before").alias("description"))
    return E.best_patterns(issues, E.fix_patterns(x)).select("id", F.round("score", 6).alias("score"))


@query("apply_patterns", """WITH x AS (SELECT *, event_id % 3 = user_id % 3 AND event_id % 4 <> 1 AS applied, 'a' || (user_id % 3) || ' = 1' AS line FROM events)
SELECT CAST(event_id AS VARCHAR) AS file, CASE WHEN applied THEN 'b' || event_id || ' = 2' ELSE line END || chr(10) || line AS text, applied FROM x""")
def apply_patterns(s, d):
    n = F.col("event_id")
    line = lambda k: F.concat(F.lit("a"), (k % 3).cast("string"), F.lit(" = 1"))
    own = line(F.col("user_id"))
    return E.apply_patterns(t(s, d, "events").select(n.cast("string").alias("file"), F.concat(own, F.lit("\n"), own).alias("text"), line(n).alias("code_before"), F.when(n % 4 == 1, F.concat(F.lit("(b"), n.cast("string"))).otherwise(F.concat(F.lit("b"), n.cast("string"), F.lit(" = 2"))).alias("code_after")))


@query("experience_overview", f"WITH {XP}, g AS (SELECT type, fixer, count(*) AS n, count_if(success) AS ok FROM xp GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS experiences, count(*) AS patterns, count_if(ok >= 3) AS suggestions FROM g")
def experience_overview(s, d):
    return E.overview(fixes(s, d))


@query("top_patterns", f"WITH {XP} SELECT type, fixer, round_even(count_if(success) / count(*), 3) AS success_rate, count(*) AS total, round_even(avg(confidence), 3) AS mean_confidence FROM xp GROUP BY type, fixer ORDER BY count_if(success) / count(*) DESC, min(ord) LIMIT 10")
def top_patterns(s, d):
    return E.top_patterns(fixes(s, d))


@query("prompt_stats", f"WITH {XP}, k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord DESC) AS n FROM xp), l AS (SELECT * FROM k WHERE n <= 50), b AS (SELECT type, string_agg(action, ',' ORDER BY n DESC) AS failed_actions FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n) AS m FROM l WHERE NOT success) WHERE m <= 5 GROUP BY type) SELECT type, count_if(success) AS successes, count(*) AS total, round_even(avg(confidence), 6) AS mean_confidence, coalesce(any_value(failed_actions), '') AS failed_actions FROM l LEFT JOIN b USING (type) GROUP BY type")
def prompt_stats(s, d):
    return E.prompt_stats(fixes(s, d)).withColumn("failed_actions", F.array_join("failed_actions", ","))


@query("failure_warnings", f"WITH {XP}, e AS (SELECT type, error, min(ord) AS o, arg_min(file, ord) AS file, arg_min(line, ord) AS line FROM xp WHERE NOT success AND error <> '' GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY o) AS INTEGER) AS place FROM e) SELECT type, place, '在 ' || file || ':' || line || ' 修复失败: ' || error AS warning FROM r WHERE place <= 5")
def failure_warnings(s, d):
    return E.failure_warnings(fixes(s, d))


@query("experience_by_id", f"WITH {XP} SELECT id, type, fixer FROM xp WHERE id IN (SELECT o_custkey FROM orders)")
def experience_by_id(s, d):
    return E.by_ids(fixes(s, d).select("id", "type", "fixer", "ord"), t(s, d, "orders").select(F.col("o_custkey").alias("id"))).select("id", "type", "fixer")


@query("propagated", f"WITH {B.EX}, {B.CAL} SELECT type, string_agg(fixer || '=' || calibrated, ',' ORDER BY fixer) AS fixers FROM c GROUP BY type")
def propagated(s, d):
    x = E.propagated(H.calibrate(B.experience(s, d), ["type", "fixer"], "success"))
    return x.select("type", F.array_join(F.transform(F.map_entries("fixers"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("fixers"))


DESC = "'问题类型: ' || type || '。' || CASE WHEN type = 'sql_injection' AND code LIKE 'cur%' THEN '代码通过 f-string 拼接 SQL 查询。语句: ' || code || '。' WHEN type = 'command_injection' AND code LIKE 'os%' THEN '使用 os.system/os.popen 直接执行命令。语句: ' || code || '。' WHEN type = 'ssrf_vulnerability' AND code LIKE 'req%' THEN '代码使用网络请求库直接访问用户输入的 URL。语句: ' || code || '。' " + " ".join(f"WHEN type = '{k}' THEN '{v}语句: ' || code || '。'" for k, v in V.DESCRIPTIONS.items()) + " WHEN type IN ('custom', 'bare_except') AND code = '' THEN '' ELSE '代码上下文: ' || code || '。' END || '修复方法: ' || action || '。' || CASE WHEN type IN ('custom', 'bare_except') THEN '修复工具: ' || fixer || '。' ELSE '' END || '修复结果: ' || CASE WHEN success THEN '成功' ELSE '失败' END || CASE WHEN type IN ('custom', 'bare_except') AND NOT success AND error <> '' THEN '失败原因: ' || error ELSE '' END"


@query("experience_texts", f"WITH {XP}, y AS (SELECT *, CASE WHEN code_before LIKE '#%' THEN 'k = 1' ELSE code_before END AS code FROM xp) SELECT id, {DESC} AS text FROM y")
def experience_texts(s, d):
    return fixes(s, d).select("id", E.description().alias("text"))


@query("index_additions", f"WITH {XP} SELECT id FROM xp WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def index_additions(s, d):
    return E.index_additions(fixes(s, d).select("id"), t(s, d, "embeddings").select(F.col("vec_id").alias("id")))


@query("index_state", "SELECT count_if(event_id % 2 = 0) AS indexed, count(*) AS known, max(ts) > max(CASE WHEN event_id % 2 = 0 THEN ts END) AS dirty FROM events")
def index_state(s, d):
    x = t(s, d, "events").select("event_id", F.col("ts").alias("at"))
    return E.index_state(x, x.where("event_id % 2 = 0"))


@query("semantic_or_recent", f"""WITH {XP}, q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q, {choose_sql(KIND, 'vec_id')} AS type FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query, vec_id AS id, list_dot_product(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, q WHERE vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS k FROM x), h AS (SELECT query, id, round(s, 6) AS score FROM r WHERE k <= 3 AND s >= 0.6), n AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord DESC) AS k FROM xp)
SELECT * FROM h UNION ALL SELECT query, id, NULL FROM q JOIN n USING (type) WHERE n.k <= 20 AND query NOT IN (SELECT query FROM h)""")
def semantic_or_recent(s, d):
    e = t(s, d, "embeddings")
    near = H.top_inner_products(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 4, -1e9).select(F.col("vec_id").alias("query"), F.col("neighbour").alias("id"), "score").where("query <> id")
    best = H.tail(near, 3, ["score", F.asc("id")], ["query"]).where("score >= 0.6").withColumn("score", F.round("score", 6))
    return E.found_or_recent(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), choose(KIND, "vec_id").alias("type")), best, fixes(s, d))


# ---- issues

@query("issue_records", f"""WITH {FIND} SELECT ord, 'llm_scanner/' || dimension AS scanner, concat_ws(',', CASE WHEN type = 'made_up' THEN 'issue_type is unknown' END, CASE WHEN ord % 7 = 0 THEN 'file path is empty' END, CASE WHEN ord % 5 = 0 THEN 'invalid severity: odd' END, CASE WHEN ord % 3 = 0 THEN 'description is empty' END) AS warnings,
  concat_ws(',', CASE WHEN severity IN ('critical', 'high') THEN 'high_priority' END, CASE WHEN type = 'sql_injection' THEN 'security' END, CASE WHEN type IN ('bare_except', 'print_used') THEN 'auto_fixable' END) AS tags, CASE type WHEN 'sql_injection' THEN 'manual_review' ELSE 'pattern_replace' END AS approach,
  CASE WHEN type = 'sql_injection' THEN 10 WHEN type IN ('bare_except', 'print_used') THEN 1 ELSE 2 END AS lines FROM f""")
def issue_records(s, d):
    n = F.col("ord")
    x = I.pipeline_issues(finds(s, d).withColumn("description", F.when(n % 3 != 0, "d")))
    kind, bad = F.when(F.col("type") == "made_up", "unknown").otherwise(F.col("type")), F.when(n % 5 == 0, "odd").otherwise(F.col("severity"))
    w = I.warnings(kind, F.when(n % 7 != 0, F.col("file")), bad, F.col("description"))
    return x.select("ord", "scanner", F.array_join(w, ",").alias("warnings"), F.array_join(I.tags(F.col("type"), F.col("severity")), ",").alias("tags"), I.strategy(F.col("type"))["approach"].alias("approach"), I.strategy(F.col("type"))["lines"].alias("lines"))


VERDICT = f"v AS (SELECT file, layer, CAST(greatest(0, 100 - sum({sql_map(V.REVIEW_WEIGHTS, 'severity', '2')})) AS INTEGER) AS score, count(*) AS total, count_if(severity = 'critical') AS c, count_if(severity = 'high') AS h FROM f GROUP BY ALL)"


@query("review_verdicts", f"WITH {FIND}, {VERDICT} SELECT file, layer, score, total, CASE WHEN c > 0 OR h > 3 THEN 'reject' WHEN h > 0 THEN 'needs_changes' WHEN score >= 85 THEN 'approve' ELSE 'needs_changes' END AS verdict FROM v")
def review_verdicts(s, d):
    return I.verdicts(finds(s, d), ["file", "layer"])


@query("project_review", f"WITH {FIND}, {VERDICT} SELECT CAST(floor(sum(score) / count(*)) AS INTEGER) AS score, count(*) AS files FROM v")
def project_review(s, d):
    return I.project_review(I.verdicts(finds(s, d), ["file", "layer"]))


LISTS = " ".join(f"WHEN type IN ({listed(v)}) THEN '{k}'" for k, v in (("security", V.SECURITY_REVIEWS), ("performance", V.PERFORMANCE_REVIEWS), ("quality", V.QUALITY_REVIEWS)))


REVIEWED = [*V.SECURITY_REVIEWS, *V.PERFORMANCE_REVIEWS, *V.QUALITY_REVIEWS, "other"]


@query("review_lists", f"""WITH f AS (SELECT {choose_sql(REVIEWED, 'event_id // 3')} AS type, value FROM events) SELECT CASE {LISTS} END AS list, type, count(*) AS n, count_if(value > 40) AS critical FROM f GROUP BY ALL""")
def review_lists(s, d):
    x = t(s, d, "events").select(choose(REVIEWED, "event_id DIV 3").alias("type"), "value")
    return x.groupBy(I.review_lists(F.col("type")).alias("list"), "type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 40).alias("critical"))


FIXABLE = ["bare_except", "print_used", "sql_injection"]


@query("delegable_issues", f"WITH {FIND} SELECT ord, type FROM f WHERE type NOT IN ({listed(FIXABLE)}) AND severity IN ('critical', 'high') ORDER BY ord LIMIT 10")
def delegable_issues(s, d):
    return I.delegable(finds(s, d), FIXABLE).select("ord", "type")


@query("issues_to_fix", f"WITH {FIND} SELECT ord, type FROM f ORDER BY type IN ({listed(FIXABLE)}) DESC, ord LIMIT 30")
def issues_to_fix(s, d):
    return I.dedicated_first(finds(s, d), FIXABLE, 30).select("ord", "type")


SIG = f"file || ':' || ({FAMILY}) || ':' || ({BUCKET})"


@query("runs_union", f"WITH {FIND}, x AS (SELECT *, {SIG} AS signature, ord % 3 AS run FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY run, ord) AS k FROM x WHERE layer > 0) SELECT signature, run, ord FROM r WHERE k = 1 AND signature NOT IN (SELECT signature FROM x WHERE layer = 0)")
def runs_union(s, d):
    x = finds(s, d).withColumn("run", F.col("ord") % 3)
    return I.runs_union(x.where("layer > 0"), x.where("layer = 0")).select("signature", "run", "ord")


@query("cluster_texts", f"WITH {FIND}, x AS (SELECT file, type, 'd' || (line % 4) AS description, 's' || layer AS suggestion, ord FROM f), a AS (SELECT file, type, description, count(*) AS c, min(ord) AS o FROM x GROUP BY ALL), b AS (SELECT file, type, suggestion, count(*) AS c, min(ord) AS o FROM x GROUP BY ALL), p AS (SELECT file, type, arg_max(description, (c, -o)) AS description, CAST(sum(c) AS BIGINT) AS n FROM a GROUP BY ALL), q AS (SELECT file, type, arg_max(suggestion, (c, -o)) AS suggestion FROM b GROUP BY ALL) SELECT file, type, CASE WHEN n > 1 THEN description || ' (' || n || ' 处)' ELSE description END AS description, suggestion, n FROM p JOIN q USING (file, type)")
def cluster_texts(s, d):
    x = finds(s, d).select("file", "type", F.concat(F.lit("d"), (F.col("line") % 4).cast("string")).alias("description"), F.concat(F.lit("s"), F.col("layer").cast("string")).alias("suggestion"), "ord")
    return I.cluster_texts(x, ["file", "type"])


SQLS = ["execute('a = ?', x)", "f'SELECT {x} FROM y'", "execute(q)"]


@query("damped_confidence", f"WITH {FIND} SELECT ord, CASE WHEN type = 'sql_injection' AND CAST(substr(file, 2) AS INTEGER) % 3 = 0 THEN least(confidence, 0.2) ELSE confidence END AS confidence FROM f")
def damped_confidence(s, d):
    x = finds(s, d)
    files = x.select("file").distinct().withColumn("text", F.element_at(F.array(*map(F.lit, SQLS)), (F.substring("file", 2, 9).cast("int") % 3 + 1)))
    return I.damped(x, files).select("ord", "confidence")


@query("unsuppressed", f"WITH {FIND} SELECT ord FROM f WHERE (file, type) NOT IN (SELECT (file, type) FROM f WHERE layer = 3 GROUP BY file, type HAVING count(*) >= 2)")
def unsuppressed(s, d):
    x = finds(s, d)
    return I.unsuppressed(x, x.where("layer = 3").groupBy("file", "type").agg(F.count("*").alias("marks")).where("marks >= 2"), ["file", "type"]).select("ord")


SINKS = ["sql_query", "xss_write", "log_inject"]
B.query("judged_candidates", f"""WITH c AS (SELECT user_id AS file, event_id AS index, {choose_sql(SINKS, 'event_id')} AS sink_kind FROM events) SELECT file, index, CASE WHEN index % 4 = 0 THEN 'uncertain' ELSE 'true_positive' END AS judgment, CASE WHEN index % 4 = 0 THEN 'LLM 未对此候选做出判断' ELSE 'r' END AS reason,
CASE WHEN index % 4 = 1 THEN 'low' ELSE CASE sink_kind WHEN 'sql_query' THEN 'critical' WHEN 'xss_write' THEN 'high' ELSE 'medium' END END AS severity FROM c""")(
    lambda s, d: I.judged(
        t(s, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("index"), choose(SINKS, "event_id").alias("sink_kind")),
        t(s, d, "events").where("event_id % 4 <> 0").select(F.col("user_id").alias("file"), F.col("event_id").alias("index"), F.lit("true_positive").alias("judgment"), F.lit("r").alias("reason"), F.when(F.col("event_id") % 4 == 1, "low").alias("severity")),
    ).select("file", "index", "judgment", "reason", "severity")
)


@query("candidate_texts", """SELECT event_id, '- 文件: f' || user_id || chr(10) || '- Source (http): `' || event_type || '` (行 ' || (event_id % 9) || ')' || chr(10) || '- 传播: ' || CASE event_id % 3 WHEN 0 THEN '(直接传递)' WHEN 1 THEN 'x' ELSE 'x → y' END || ' (' || (event_id % 3) || ' 跳)' || chr(10) || '- Sink (sql): `run` (行 7)' || chr(10) || '- 数据流置信度: 80.0%' AS text FROM events""")
def candidate_texts(s, d):
    n = F.col("event_id")
    hops = F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), (n % 3).cast("int"))
    text = I.candidate_text(F.concat(F.lit("f"), F.col("user_id").cast("string")), F.lit("http"), F.col("event_type"), n % 9, hops, F.lit("sql"), F.lit("run"), F.lit(7), F.lit(0.8))
    return t(s, d, "events").select("event_id", text.alias("text"))


@query("triage_answers", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id % 100 END AS index, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type END AS judgment FROM events")
def triage_answers(s, d):
    one = F.to_json(F.struct((F.col("event_id") % 100).alias("index"), F.col("event_type").alias("judgment")))
    n = F.col("event_id") % 5
    text = F.when(n == 0, F.concat(F.lit("["), one, F.lit("]"))).when(n == 1, F.concat(F.lit("Sure:\n```json\n["), one, F.lit("]\n```"))).when(n == 2, F.concat(F.lit('{"results": ['), one, F.lit("]}"))).when(n == 3, one).otherwise("no idea")
    a = F.get(I.answers_json(text, "struct<index:bigint,judgment:string>"), F.lit(0))
    return t(s, d, "events").select("event_id", a["index"].alias("index"), a["judgment"].alias("judgment"))


@query("unseen_tasks", "SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY user_id")
def unseen_tasks(s, d):
    known = t(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return I.unseen(t(s, d, "events").where("event_type = 'error'").select("user_id", "event_id"), known, "user_id", "event_id")


DAG = "g AS (SELECT n_nationkey AS node, CASE WHEN n_regionkey % 2 = 0 THEN 'success' ELSE 'failed' END AS status FROM nation), e AS (SELECT a.node AS src, b.node AS dst FROM g a JOIN g b ON b.node IN (2 * a.node + 1, 2 * a.node + 2))"


def dag(s, d):
    nodes = t(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_regionkey") % 2 == 0, "success").otherwise("failed").alias("status"))
    return nodes, nodes.select(F.col("node").alias("src"), F.explode(F.array(2 * F.col("node") + 1, 2 * F.col("node") + 2)).alias("dst"))


@query("ready_nodes", f"WITH {DAG} SELECT g.node, coalesce(bool_and(s.status = 'success'), true) AS ready FROM g LEFT JOIN e ON e.dst = g.node LEFT JOIN g s ON s.node = e.src GROUP BY g.node")
def ready_nodes(s, d):
    nodes, edges = dag(s, d)
    return I.ready(nodes, edges, nodes)


@query("blocked_nodes", f"WITH RECURSIVE {DAG}, b(node) AS (SELECT dst FROM e JOIN g ON g.node = e.src WHERE status = 'failed' UNION SELECT e.dst FROM b JOIN e ON e.src = b.node) SELECT node FROM b WHERE node NOT IN (SELECT node FROM g WHERE status = 'failed')")
def blocked_nodes(s, d):
    nodes, edges = dag(s, d)
    known = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    return I.blocked(known, nodes.where("status = 'failed'"))


CH = "c AS (SELECT user_id, event_id AS ord, (['syntax', 'rescan', 'import'])[event_id % 3 + 1] AS name, value >= 5 AS passed, CASE WHEN value >= 5 THEN 0.05 ELSE -0.3 END AS delta FROM events)"


@query("check_chains", f"WITH {CH}, k AS (SELECT *, coalesce(max(name = 'syntax' AND NOT passed) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cut FROM c) SELECT user_id, round_even(CAST(sum(delta) AS DOUBLE), 6) AS total_delta, bool_and(passed) AS passed, bool_or(name = 'syntax' AND NOT passed) AS rollback, count(*) AS checks FROM k WHERE NOT cut GROUP BY user_id")
def check_chains(s, d):
    ok = F.col("value") >= 5
    return I.chain(t(s, d, "events").select("user_id", F.col("event_id").alias("ord"), choose(["syntax", "rescan", "import"], "event_id").alias("name"), ok.alias("passed"), F.when(ok, 0.05).otherwise(-0.3).alias("delta")), ["user_id"])


@query("fix_checks", """WITH x AS (SELECT event_id AS fix, value < 8 AS broken, user_id % 3 = 0 AS remains, event_id % 2 = 0 AS about, event_id % 7 AS m FROM events WHERE value IS NOT NULL)
SELECT fix, 0 AS ord, 'syntax' AS name, NOT broken AS passed, CASE WHEN broken THEN -0.3 ELSE 0.05 END::DOUBLE AS delta FROM x UNION ALL SELECT fix, 1, 'rescan', NOT remains, CASE WHEN remains THEN -0.2 ELSE 0.15 END FROM x
UNION ALL SELECT fix, 2, 'import', NOT about OR m <> 1, CASE WHEN NOT about OR m > 1 THEN 0 WHEN m = 0 THEN 0.1 ELSE -0.15 END FROM x""")
def fix_checks(s, d):
    n = F.col("event_id")
    text = F.concat(F.lit("def f"), n.cast("string"), F.when(F.col("value") < 8, "(").otherwise("():\n    return "), F.col("user_id").cast("string"))
    x = t(s, d, "events").where("value IS NOT NULL").select(n.alias("fix"), F.when(n % 2 == 0, "unused_import").otherwise("dead_code").alias("type"), n.cast("string").alias("file"), F.lit("edit").alias("action"), text.alias("text"), "user_id")
    remaining = x.where("user_id % 3 = 0").select("type", "file")
    imports = x.where("fix % 7 < 2").select("file", (F.col("fix") % 7 == 0).alias("ok"))
    return I.checks(x.drop("user_id"), remaining, imports)


@query("over_modified", """WITH x AS (SELECT event_id, (event_id * 7) % 45 - event_id % 30 - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM events)
SELECT event_id, CASE WHEN n > 20 THEN 'grown' WHEN n < -10 THEN 'shrunk' WHEN event_id % 5 = 0 THEN 'defaults lost' WHEN event_id % 3 = 0 THEN 'imports lost' END AS why FROM x""")
def over_modified(s, d):
    n, u = F.col("event_id"), F.col("user_id")
    imports = lambda first: F.transform(F.sequence(first, u % 4 + 1), lambda i: F.concat(F.lit("import m"), i.cast("string")))
    text = lambda first, default, lines: F.array_join(F.concat(imports(first), F.array(default), F.array_repeat(F.lit("y"), lines.cast("int"))), "\n")
    kept = F.concat(F.lit('x = d.get("k'), n.cast("string"), F.lit('", "v")'))
    zero = F.lit(0).cast("long")
    before, after = text(zero, kept, n % 30), text(F.when(n % 3 == 0, F.lit(1).cast("long")).otherwise(zero), F.when(n % 5 == 0, F.lit('x = d.get("k")')).otherwise(kept), n * 7 % 45)
    return t(s, d, "events").select("event_id", I.over_modified(before, after).alias("why"))


@query("acceptance", """WITH x AS (SELECT event_id AS change, event_id % 5 IN (2, 4) OR event_id % 2 = user_id % 2 AS signature_ok, event_id % 5 <> 2 AS syntax_ok, event_id % 5 NOT IN (1, 3) AS diff_ok, event_id % 3 AS rework FROM events)
SELECT change, signature_ok, syntax_ok, diff_ok, CASE WHEN change % 2 = 0 THEN true END AS test_ok, signature_ok AND syntax_ok AND diff_ok AS passed, CASE WHEN signature_ok AND syntax_ok AND diff_ok THEN '通过' WHEN rework >= 2 THEN '协调者接管' ELSE '打回重做' END AS action,
  rework + CASE WHEN signature_ok AND syntax_ok AND diff_ok THEN 0 ELSE 1 END AS rework FROM x""")
def acceptance(s, d):
    n, u = F.col("event_id"), F.col("user_id")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    after = F.when(n % 5 == 0, text("def f(a", u % 2, "):\n    return ", n, "\nx = 1\ny = ", n)).when(n % 5 == 1, text("def f(a", u % 2, "):\n    return ", n, "\nx = 2")).when(n % 5 == 2, text("def f(a", n, ":\n    return 1"))
    after = after.when(n % 5 == 3, text("def f(a", u % 2, "):\n    return 1", F.repeat(F.lit("\nx = 1"), 203))).otherwise(text("def g", n, "():\n    return 1"))
    x = t(s, d, "events").select(n.alias("change"), text("def f(a", n % 2, "):\n    return 1\nx = 1").alias("before"), after.alias("after"), F.when(n % 2 == 1, "t.py").alias("test_file"), (n % 3).alias("rework"))
    return I.acceptance(x, ["f"])


@query("processed_fixes", f"WITH {FIND}, p AS (SELECT CASE WHEN severity = 'low' THEN 'rejected' WHEN confidence >= 0.8 THEN 'auto_apply' WHEN confidence >= 0.5 THEN 'pending_review' ELSE 'rejected' END AS decision FROM f) SELECT decision, CASE decision WHEN 'auto_apply' THEN 'applied' WHEN 'pending_review' THEN 'queued' ELSE 'dropped' END AS outcome, count(*) AS n FROM p GROUP BY ALL")
def processed_fixes(s, d):
    return I.processed(finds(s, d).withColumn("success", F.col("severity") != "low")).groupBy("decision", "outcome").agg(F.count("*").alias("n"))


@query("best_candidates", "SELECT user_id AS issue, arg_max(event_id, (round(0.5::DOUBLE * coalesce(CASE WHEN event_id % 9 > 0 THEN (event_id % 9) / 10 END, 0.5) + 0.5::DOUBLE * (1 - (event_id % 3 + 1) / (3 + user_id % 5)), 9), -event_id)) AS ord FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def best_candidates(s, d):
    n, u = F.col("event_id"), F.col("user_id")
    text = F.array_join(F.transform(F.sequence(F.lit(1), (u % 5 + 3).cast("int")), lambda i: F.concat(F.lit("v"), i.cast("string"), F.lit(" = "), u.cast("string"))), "\n")
    x = t(s, d, "events").select(u.alias("issue"), n.alias("ord"), text.alias("text"), F.lit(1).alias("first"), (n % 3 + 1).cast("int").alias("last"), F.when(n % 4 == 0, F.concat(F.lit("f("), n.cast("string"))).otherwise(F.concat(F.lit("z = "), n.cast("string"))).alias("replacement"), F.when(n % 9 > 0, (n % 9) / 10).alias("confidence"))
    return I.best_candidates(x).select("issue", "ord")


DEFS = ["async def f{}(a, b=1, *c):\n    '''d'''\n    return a\n", "@x\ndef g{}(a, b, c, d, e, h):\n    pass\n", "v = {}\n"]


def code(s, d):
    return t(s, d, "events").select("user_id", F.col("event_id").cast("string").alias("file"), F.replace(choose(DEFS, "event_id"), F.lit("{}"), F.col("event_id").cast("string")).alias("text"))


@query("function_signatures", "SELECT CAST(event_id AS VARCHAR) AS file, CASE event_id % 3 WHEN 0 THEN 1 ELSE 2 END AS line, CASE event_id % 3 WHEN 0 THEN 'f' ELSE 'g' END || event_id AS name, CASE event_id % 3 WHEN 0 THEN 'a,b' ELSE 'a,b,c,d,e' END AS args, event_id % 3 = 0 AS is_async, event_id % 3 = 0 AS documented, CASE event_id % 3 WHEN 0 THEN '' ELSE 'x' END AS decorators FROM events WHERE event_id % 3 < 2")
def function_signatures(s, d):
    return I.signatures(code(s, d)).select("file", "line", "name", F.array_join("args", ",").alias("args"), "is_async", "documented", F.array_join("decorators", ",").alias("decorators"))


@query("module_contexts", """WITH x AS (SELECT user_id, CAST(event_id AS VARCHAR) AS file, CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 4 ELSE 2 END AS n, CASE event_id % 3 WHEN 0 THEN 'async def f' || event_id || '(a, b=1, *c):~    ''''''d''''''~    return a~' WHEN 1 THEN '@x~def g' || event_id || '(a, b, c, d, e, h):~    pass~' ELSE 'v = ' || event_id || '~' END AS text, event_id % 3 AS k, event_id FROM events),
y AS (SELECT user_id, sum(n) > 60 AS compact FROM x GROUP BY user_id)
SELECT user_id, md5(replace(string_agg('# ' || file || '~' || CASE WHEN compact THEN text || CASE k WHEN 2 THEN '~' WHEN 0 THEN '~def f' || event_id || '(a, b)~' || rtrim(text, '~') ELSE '~def g' || event_id || '(a, b, c, d, e)~' || 'def g' || event_id || '(a, b, c, d, e, h):~    pass' END ELSE text END, '~~' ORDER BY file), '~', chr(10))) AS digest, any_value(compact) AS compact FROM x JOIN y USING (user_id) GROUP BY user_id""")
def module_contexts(s, d):
    return I.module_context(code(s, d), ["user_id"], 60, 30, 80).select("user_id", F.md5("context").alias("digest"), "compact")


CATEGORY = ["debug", "feature", "test_creation", "refactor"]


@query("delegate_decisions", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 2 THEN false WHEN CASE WHEN o_orderkey % 3000 = 0 THEN 2000 ELSE o_orderkey % 3000 END < 1000 THEN true WHEN o_custkey % 4 IN (1, 3) THEN false ELSE NOT o_totalprice / 100000 / 5 > 0.8 END AS delegate FROM orders")
def delegate_decisions(s, d):
    x = t(s, d, "orders")
    return x.select("o_orderkey", I.delegate_decision(F.lit("t"), choose(CATEGORY, "o_custkey"), F.lit(""), F.col("o_orderkey") % 3000, F.col("o_totalprice") / 100000, F.lit(5.0)).alias("delegate"))


PATH = "['src/', 'tests/', 'etc/', 'srcx/'][event_id % 4 + 1] || ['', '../', 'deep/', 'a..b/'][event_id // 4 % 4 + 1] || CASE WHEN user_id % 5 = 0 THEN 'config.yaml' ELSE event_type || event_id || '.py' END"


@query("writable_paths", f"SELECT event_id, (starts_with(p, 'src/') OR starts_with(p, 'tests/')) AND NOT ends_with(p, '/config.yaml') AND NOT contains(p, '..') AS ok FROM (SELECT event_id, {PATH} AS p FROM events)")
def writable_paths(s, d):
    name = F.when(F.col("user_id") % 5 == 0, "config.yaml").otherwise(F.concat("event_type", F.col("event_id").cast("string"), F.lit(".py")))
    path = F.concat(choose(["src/", "tests/", "etc/", "srcx/"], "event_id"), choose(["", "../", "deep/", "a..b/"], "event_id DIV 4"), name)
    return t(s, d, "events").select("event_id", I.writable(path, ["src", "tests"], ["config.yaml"]).alias("ok"))


@query("checked_rows", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'event_type' WHEN user_id % 2 = 1 THEN 'parity' END AS bad FROM events")
def checked_rows(s, d):
    x = t(s, d, "events").withColumn("parity", (F.col("user_id") % 2).cast("string"))
    return I.checked(x, {"event_type": ["click", "purchase", "error", "signup"], "parity": ["0"]}).select("event_id", "bad")


@query("scan_targets", "SELECT CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS place, event_type || user_id AS path FROM events WHERE user_id % 4 <> 0 GROUP BY path")
def scan_targets(s, d):
    path = F.when(F.col("user_id") % 4 != 0, F.concat("event_type", F.col("user_id").cast("string"))).when(F.col("event_id") % 2 == 0, "")
    return I.targets(t(s, d, "events").select(path.alias("path"), F.col("event_id").alias("ord")))


@query("priority_order", f"WITH {FIND}, x AS (SELECT *, {B.FP} AS fingerprint FROM f), y AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY {RANK}, ord) AS r FROM x), z AS (SELECT *, CASE {B.COMPLEX} WHEN 'simple' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS c FROM y WHERE r = 1) SELECT CAST(row_number() OVER (ORDER BY {RANK}, c, file, line, ord) AS INTEGER) AS place, ord FROM z ORDER BY 1 LIMIT 50")
def priority_order(s, d):
    place = F.when(F.col("complexity") == "simple", 0).when(F.col("complexity") == "medium", 1).otherwise(2)
    w = Window.orderBy(S.rank(F.col("severity"), 9), place, "file", "line", "ord")
    top = O.assessed(finds(s, d)).orderBy(S.rank(F.col("severity"), 9), place, "file", "line", "ord").limit(50)
    return top.select(F.row_number().over(w).alias("place"), "ord")
