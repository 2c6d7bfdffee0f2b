"""Lookups and chosen scans bound to the driver's tables, each with its SQL."""

from pyspark.sql import functions as F

from ..operators import lookups as L
from ..sources.folders import work_folder
from . import bindings as B
from . import sources as C
from . import workflow as W
from .bindings import query, t


@query("code_windows", f"""WITH {C.LINES} SELECT a.file, a.line_no AS line, string_agg(b.line, chr(10) ORDER BY b.line_no) AS code FROM lines a JOIN lines b ON a.file = b.file AND b.line_no BETWEEN a.line_no - 3 AND a.line_no + 3 WHERE a.stripped = 'except:' GROUP BY ALL""")
def code_windows(s, d):
    files = C.shaped_files(s, d)
    at = C.shaped(s, d).where("stripped = 'except:'").select("file", F.col("line_no").alias("line"))
    return at.join(files, "file").select("file", "line", L.code_window(F.col("text"), F.col("line")).alias("code"))


@query("severity_order", f"""{C.CODE_FOUND}, o AS (SELECT file, line, rule, severity, row_number() OVER (ORDER BY {B.RANK}, file, line, rule) AS place FROM found) SELECT place, file, line, rule FROM o WHERE place <= 500""")
def severity_order(s, d):
    x = C.code_findings(s, d).withColumn("ord", F.struct("file", "line", "rule"))
    first = L.by_severity(x).limit(500)
    place = F.row_number().over(W.Window.orderBy(B.S.rank(F.col("severity")), "ord"))
    return first.select(place.alias("place"), "file", "line", "rule")


@query("file_scan", f"WITH {C.LINES}, k AS (SELECT min(file) AS file FROM lines), x AS ({' UNION ALL '.join(f'SELECT type, severity, file, line FROM ({B.ORACLES[q]})' for q in C.ALL)}) SELECT type, severity, x.file, line FROM x JOIN k USING (file) UNION ALL SELECT 'missing_timeout', 'medium', file, line_no FROM lines JOIN k USING (file) WHERE stripped = 'requests.post(u)'")
def file_scan(s, d):
    files = C.shaped_files(s, d)
    return L.scan_one(files, files.agg(F.min("file")).first()[0])


@query("dimension_phase", f"{C.CODE_FOUND} SELECT file, line, type, severity, dimension, dimension || '_scanner' AS scanner FROM found WHERE dimension IN ('security', 'configuration')")
def dimension_phase(s, d):
    lines = C.code_lines(s, d)
    return L.scan_phase(lines, ["security", "configuration"]).select("file", "line", "type", "severity", "dimension", "scanner")


@query("single_fixes", f"""WITH {B.EX}, {B.CAL}, f(fixer, type, reg) AS (VALUES ('fix3', 'error', 2), ('fix1', 'error', 5), ('fix2', 'click', 1), ('fix7', 'view', 0)),
p AS (SELECT ord AS id, x.type, first.fixer, fixer_of.fixer AS own, success, (ord % 11) / 10 AS given FROM x JOIN (SELECT type, arg_min(fixer, reg) AS fixer FROM f GROUP BY type) first USING (type) LEFT JOIN (SELECT ord AS o, fixer FROM x) fixer_of ON fixer_of.o = x.ord
  UNION ALL SELECT ord, type, NULL, NULL, NULL, NULL FROM x WHERE type NOT IN (SELECT type FROM f)),
r AS (SELECT id, p.fixer, CASE WHEN own = p.fixer THEN success END AS success, CASE WHEN own = p.fixer THEN given END AS given, p.type FROM p),
g AS (SELECT id, r.fixer, success, coalesce(calibrated, given) AS confidence FROM r LEFT JOIN c ON c.type = r.type AND c.fixer = r.fixer),
e AS (SELECT id, fixer, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN fixer IS NULL THEN 'no_fixer' WHEN NOT coalesce(success, false) THEN 'rejected' WHEN confidence >= 0.8 THEN 'auto_apply' WHEN confidence >= 0.5 THEN 'pending_review' ELSE 'rejected' END AS decision FROM g)
SELECT *, decision = 'auto_apply' AS applied FROM e""")
def single_fixes(s, d):
    x = B.experience(s, d)
    fixers = s.createDataFrame([("fix3", "error", 2), ("fix1", "error", 5), ("fix2", "click", 1), ("fix7", "view", 0)], "fixer string, type string, reg int")
    results = x.select(F.col("ord").alias("id"), "fixer", "success", (F.col("ord") % 11 / 10).alias("confidence"))
    return L.single_fixes(x.select(F.col("ord").alias("id"), "type"), fixers, results, B.H.calibrate(x, ["type", "fixer"], "success"))


@query("bug_lookup", "SELECT event_id AS ord, user_id AS id, event_type FROM events WHERE user_id = 7 ORDER BY event_id LIMIT 1")
def bug_lookup(s, d):
    return L.bug(t(s, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("id"), "event_type"), 7)


@query("agent_lookup", f"WITH {W.CAP} SELECT * EXCLUDE (ord) FROM cap WHERE agent = 'a7'")
def agent_lookup(s, d):
    return L.capability(W.agents(s, d), "a7")


@query("kept_tasks", "SELECT event_id AS task_id, event_type FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def kept_tasks(s, d):
    return L.without(t(s, d, "events").select(F.col("event_id").alias("task_id"), "event_type"), t(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("task_id")))


@query("round_metrics", """WITH u AS (SELECT user_id % 40 AS k, count(*) AS n, max(event_id) AS top FROM events GROUP BY 1) SELECT 'round-' || k AS name, CASE WHEN k % 3 = 0 THEN top ELSE k END AS round_num, 'at ' || top AS timestamp, CASE WHEN k % 4 = 0 THEN 0 ELSE n END AS task_count FROM u WHERE k % 5 <> 0""")
def round_metrics(s, d):
    """Metrics files of forty rounds, one in five of them broken, written and read back."""
    k = F.col("k")
    u = t(s, d, "events").groupBy((F.col("user_id") % 40).alias("k")).agg(F.count("*").alias("n"), F.max("event_id").alias("top"))
    parts = F.struct(
        F.struct(F.col("top").alias("last_round"), F.concat(F.lit("at "), F.col("top").cast("string")).alias("generated_at")).alias("summary"),
        F.when(k % 3 != 0, F.struct(k.alias("round_num"))).alias("timer"), F.when(k % 4 != 0, F.struct(F.struct(F.col("n").alias("total")).alias("summary"))).alias("tasks"),
    )
    text = F.to_json(parts)
    folder = work_folder(s, "metrics")
    u.select(F.concat(F.lit("round-"), k.cast("string")).alias("name"), F.when(k % 5 == 0, F.left(text, F.lit(20))).otherwise(text).alias("value")).write.partitionBy("name").text(folder)
    x = L.metrics_files(s, folder, "name=round-*")
    return x.select(F.regexp_extract("path", "name=([^/]*)", 1).alias("name"), "round_num", "timestamp", "task_count")


TREE = B.TREE
# The suffix's language, as project_blueprint has it.
LANG = "CASE WHEN path LIKE 'node_modules/%' OR path LIKE '.%' OR contains(path, '__pycache__') THEN NULL WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' END"
MARKERS = ["requirements.txt", "go.mod", "yarn.lock", "docs/a.md", "pom.xml", "src/x.py"]


@query("project_profiles", f"""WITH {TREE}, m AS (SELECT project, path FROM p UNION ALL SELECT project, ([{B.listed(MARKERS)}])[event_id // 5 % {len(MARKERS)} + 1] FROM p WHERE event_id % 5 = 0),
k AS (SELECT *, {LANG} AS lang FROM m), c AS (SELECT project, lang, count(*) AS n FROM k WHERE lang IS NOT NULL GROUP BY ALL), b AS (SELECT project, arg_min(lang, (-n, lang)) AS lang FROM c GROUP BY project),
f AS (SELECT k.project, any_value(b.lang) AS main, count(k.lang) AS n, bool_or(path = 'requirements.txt') AS pip, bool_or(path = 'yarn.lock') AS npm, bool_or(path = 'pom.xml') AS maven, bool_or(path = 'go.mod') AS go, bool_or(path LIKE 'tests/%') AS tests, bool_or(path LIKE 'docs/%' OR path = 'README.md') AS docs, bool_or(path = 'config.yaml') AS configs FROM k LEFT JOIN b ON b.project = k.project GROUP BY k.project)
SELECT project, concat_ws(',', CASE WHEN pip THEN 'pip' END, CASE WHEN npm THEN 'npm' END, CASE WHEN maven THEN 'maven' END, CASE WHEN go THEN 'go' END) AS managers,
  concat_ws(',', CASE WHEN n >= 5 THEN 'architecture' END, CASE WHEN main IN ('python', 'javascript', 'typescript') THEN 'asyncification' END, CASE WHEN configs THEN 'configuration' END, CASE WHEN n >= 3 THEN 'deadcode' END, CASE WHEN docs THEN 'documentation' END, CASE WHEN main IN ('python', 'javascript', 'typescript') THEN 'performance' END, CASE WHEN n > 0 THEN 'quality' END, CASE WHEN main IN ('python', 'javascript', 'typescript') THEN 'security' END, CASE WHEN tests AND main IN ('python', 'javascript') THEN 'testing' END) AS dimensions FROM f""")
def project_profiles(s, d):
    marks = t(s, d, "events").where("event_id % 5 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project"), W.choose(MARKERS, "event_id DIV 5").alias("path"), F.lit("").alias("text"))
    x = B.P.blueprint(B.tree(s, d).unionByName(marks))
    return x.select("project", F.array_join("package_managers", ",").alias("managers"), F.array_join("dimensions", ",").alias("dimensions"))


@query("history_figures", """WITH r AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'success' WHEN event_type IN ('error', 'view') THEN 'failed' ELSE 'open' END AS result, event_id % 70 AS a, event_id % 13 AS b, CASE WHEN event_id % 3 > 0 THEN event_id % 100 END AS sb, CASE WHEN event_id % 4 > 0 THEN event_id % 97 END AS sa FROM events)
SELECT user_id, count(*) AS total, count_if(result = 'success') AS success, round_even(count_if(result = 'success') / count(*) * 100, 0) AS percent, count_if(result = 'failed') AS failed, CAST(sum(a) AS BIGINT) AS added, CAST(sum(b) AS BIGINT) AS removed,
  round_even(avg(sb), 0) AS score_before, round_even(avg(CASE WHEN sb IS NOT NULL THEN coalesce(sa, 0) END), 0) AS score_after FROM r GROUP BY user_id""")
def history_figures(s, d):
    n = F.col("event_id")
    result = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type").isin("error", "view"), "failed").otherwise("open")
    x = t(s, d, "events").select("user_id", result.alias("result"), (n % 70).alias("lines_added"), (n % 13).alias("lines_removed"), F.when(n % 3 > 0, n % 100).alias("score_before"), F.when(n % 4 > 0, n % 97).alias("score_after"))
    return L.history_figures(x, ["user_id"])


STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END"


@query("task_figures", f"WITH x AS (SELECT user_id, {STATUS} AS status FROM events) SELECT user_id, count_if(status = 'completed') AS completed_tasks, count_if(status <> 'completed') AS pending_tasks, count(*) AS total_tasks, round_even(count_if(status = 'completed') / count(*) * 100, 1) AS success_rate, coalesce(count_if(status = 'completed') / nullif(count_if(status IN ('completed', 'failed')), 0), 0) AS rate FROM x GROUP BY user_id")
def task_figures(s, d):
    x = t(s, d, "events").select("user_id", F.expr(STATUS).alias("status"))
    return L.task_figures(x, ["user_id"]).join(L.sub_agent_rate(x, ["user_id"]), "user_id")


@query("feedback_figures", f"WITH m AS (SELECT count(*) AS marks FROM ({B.ORACLES['feedback_suppression'].replace(' GROUP BY user_id HAVING count(*) >= 2', '').replace('SELECT user_id, count(*) AS marks FROM u', 'SELECT user_id FROM u')}) GROUP BY user_id) SELECT count_if(marks >= 2) AS active_suppressions, count_if(marks = 1) AS pending_suppressions FROM m")
def feedback_figures(s, d):
    op = F.when(F.col("event_type") == "error", "unmark").otherwise("mark")
    marks = B.H.suppressed(t(s, d, "events").select("user_id", op.alias("op"), F.col("event_id").alias("at"), F.col("event_id").alias("ord")), ["user_id"], least=1)
    return L.feedback_figures(marks)


@query("pending_approvals", f"SELECT id FROM ({B.ORACLES['approval_states']}) WHERE status = 'pending'")
def pending_approvals(s, d):
    return L.pending_items(B.approval_states(s, d)).select("id")


FORBIDDEN = [(1, "no money", ["urchase 1", "ERROR 9"]), (2, "too near", ["view 4", "purchase"]), (3, "never", [])]


@query("task_types", "SELECT event_id AS id, event_type || event_id % 3 AS type, CASE event_type WHEN 'view' THEN NULL ELSE upper(event_type) || event_id % 3 END AS definition, CASE WHEN contains(w, 'urchase 1') OR contains(w, 'error 9') THEN 'no money' WHEN contains(w, 'view 4') OR contains(w, 'purchase') THEN 'too near' END AS forbidden FROM (SELECT *, 'do ' || event_type || ' ' || user_id AS w FROM events)")
def task_types(s, d):
    e = t(s, d, "events")
    kind = F.concat("event_type", (F.col("event_id") % 3).cast("string"))
    registry = e.where("event_type <> 'view'").groupBy(kind.alias("id")).agg(F.min("event_id").alias("place")).withColumn("definition", F.upper("id"))
    tasks = e.select(F.col("event_id").alias("id"), kind.alias("type"), F.concat(F.lit("Do "), F.initcap("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("description"))
    return L.task_types(tasks, registry, s.createDataFrame(FORBIDDEN, "place int, reason string, examples array<string>")).drop("description")


@query("json_log_lines", """SELECT event_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","level":"' || upper(event_type) || '","message":"值 ' || user_id || '","task_id":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"t' || event_id || '"' END || '}' AS line FROM events""")
def json_log_lines(s, d):
    from ..operators import variants as J

    x = t(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.upper("event_type").alias("level"), F.concat(F.lit("值 "), F.col("user_id").cast("string")).alias("message"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("task_id"))
    return x.select("event_id", J.json_safe(x, ["timestamp", "level", "message", "task_id"]).alias("line"))


@query("type_errors", """SELECT 'src/' || event_type || '.py' AS file, CAST(user_id AS INTEGER) AS line, left('Value "' || event_id || '" has ' || repeat('no ', CAST(event_id % 40 AS BIGINT)) || 'type', 80) AS message, CASE WHEN event_id % 2 = 0 THEN 'arg-type' ELSE '' END AS code FROM events WHERE event_id % 5 < 3""")
def type_errors(s, d):
    from ..sources import readers

    n = F.col("event_id")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    line = text("src/", F.col("event_type"), ".py:", F.col("user_id"), F.when(n % 3 == 0, text(":", n % 80)).otherwise(""), F.when(n % 5 == 3, ": note: ").when(n % 5 == 4, ": warning: ").otherwise(": error: "))
    line = F.concat(line, text('Value "', n, '" has ', F.repeat(F.lit("no "), (n % 40).cast("int")), "type", F.when(n % 2 == 0, "  [arg-type]").otherwise("")))
    return readers.mypy_lines(t(s, d, "events").select(line.alias("value")))


@query("dated_logs", """SELECT strftime(ts, '%Y-%m-%d') AS date, event_type AS level, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM events ORDER BY 1 LIMIT 4) AND event_id % 7 <> 0 GROUP BY ALL""")
def dated_logs(s, d):
    """JSON lines in folders of four days, one row in seven broken, and a folder that is no date, written and read back."""
    from ..sources import readers

    folder = work_folder(s, "logs")
    e = t(s, d, "events").withColumn("day", F.col("ts").cast("date"))
    line = F.to_json(F.struct(F.col("event_type").alias("level"), F.col("user_id").cast("string").alias("request_id"), F.col("event_id").cast("string").alias("message")))
    line = F.when(F.col("event_id") % 7 == 0, F.left(line, F.lit(15))).otherwise(line)
    days = [r["day"] for r in e.select("day").distinct().orderBy("day").limit(4).collect()]
    for day in days:
        e.where(F.col("day") == F.lit(day)).select(line.alias("value")).write.text(f"{folder}/{day}")
    e.select(line.alias("value")).write.text(f"{folder}/2024-13-45")
    return readers.json_lines(s, folder).groupBy(F.col("date").cast("string").alias("date"), "level").agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("users"))


@query("state_files", "SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1")
def state_files(s, d):
    """A JSON state read back, with an empty one where there is no file."""
    from ..sources import readers

    folder = work_folder(s, "state")
    counts = t(s, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"))
    counts.agg(F.to_json(F.collect_list(F.struct("k", "n"))).alias("value")).write.text(f"{folder}/state.json")
    schema = "k string, n long"
    return readers.json_or_empty(s, f"{folder}/state.json", schema).union(readers.json_or_empty(s, f"{folder}/missing.json", schema))


@query("saved_cache", """WITH x AS (SELECT event_id % 3 AS run, event_type || user_id % 40 AS key, max(event_id) AS answer FROM events GROUP BY ALL) SELECT key, arg_max(run, run) AS run, arg_max(answer, run) AS answer FROM x GROUP BY key""")
def saved_cache(s, d):
    """Answers by key, saved after each of three runs: a run's answers take the place of those before."""
    from ..sources import readers
    from ..streaming import sinks

    cache, schema = sinks.State(s, work_folder(s, "cache"), "json"), "key string, run long, answer long"
    for run in range(3):
        new = t(s, d, "events").where(F.col("event_id") % 3 == run).groupBy(F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("key")).agg(F.lit(run).cast("long").alias("run"), F.max("event_id").alias("answer"))
        cache.replace(readers.upsert(cache.current(schema), new, "key"))
    return cache.current(schema)


@query("source_tree", "SELECT lang AS folder, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id % 10 = 0 GROUP BY lang")
def source_tree(s, d):
    """Texts written as files in folders by language, and in one that is never entered, read back."""
    from ..sources import readers

    folder = work_folder(s, "tree")
    x = t(s, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND doc_id % 10 = 0").select("lang", F.regexp_replace("text", "\n", "\r").alias("value"))
    x.write.partitionBy("lang").text(folder)
    x.drop("lang").write.text(f"{folder}/node_modules/a")
    files = readers.source_files(s, folder, [".txt"])
    lines = files.select(F.regexp_extract("file", "lang=([^/]*)/", 1).alias("folder"), F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))
