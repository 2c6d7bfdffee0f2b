"""The operators bound to the driver's tables, each with its SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import scalars as S
from ..operators import calls as C
from ..operators import experience as E
from ..operators import findings as O
from ..operators import fixers as X
from ..operators import graphs as G
from ..operators import history as H
from ..operators import issues as I
from ..operators import projects as P
from ..operators import reviewers as R

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listed(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_map(table: dict, key: str, default: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default} END"


# ---- source lines and rules

LINES = r"""lines AS (SELECT CAST(doc_id AS VARCHAR) AS file, i AS line_no, l[i] AS line, regexp_replace(regexp_replace(l[i], '^\s+', ''), '\s+$', '') AS stripped,
  length(l[i]) - length(regexp_replace(l[i], '^\s+', '')) AS indent FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def rules_sql() -> str:
    out = []
    for i, (kind, severity, dimension, pattern, on) in enumerate(V.LINE_RULES):
        text = {"stripped": "stripped", "line": "line", "uncommented": "line", "code": "split_part(line, '#', 1)"}[on]
        quoted = pattern.replace("'", "''")
        test = "length(line) > 120" if kind == "long_line" else f"regexp_matches({text}, '{quoted}')"
        if on in ("stripped", "uncommented"):
            test += " AND stripped NOT LIKE '#%'"
        if on == "code":
            test += f" AND NOT regexp_matches({text}, '{V.SKIP_SECRET}')"
        if kind in ("todo_fixme", "hardcoded_ip"):
            test += f" AND NOT regexp_matches(file, '{V.SKIP_FILE}')"
        if kind == "hardcoded_ip":
            test += r""" AND NOT regexp_matches(stripped, '["''](0\.0\.0\.0|127\.0\.0\.1)(:\d+)?["'']')"""
        if kind == "missing_timeout":
            test += " AND NOT contains(stripped, 'timeout')"
        if kind == "naked_env":
            test += " AND NOT contains(lower(stripped), 'default') AND NOT contains(stripped, 'or ')"
        out.append(f"SELECT '{kind}' AS type, '{severity}' AS severity, '{dimension}' AS dimension, file, line_no AS line, {i} AS rule FROM lines WHERE {test}")
    return "found AS (" + " UNION ALL ".join(out) + ")"


FOUND = f"WITH {LINES}, {rules_sql()}"


def doc_lines(s, d):
    return O.source_lines(t(s, d, "documents"), "doc_id", "text")


def doc_findings(s, d):
    return O.scan_lines(doc_lines(s, d))


@query("lines_profile", f"WITH {LINES} SELECT file, count(*) AS n_lines, max(indent) AS deepest, count_if(stripped = '') AS blank, max(length(line)) AS longest FROM lines GROUP BY file")
def lines_profile(s, d):
    return doc_lines(s, d).groupBy("file").agg(F.count("*").alias("n_lines"), F.max("indent").alias("deepest"), F.count_if(F.col("stripped") == "").alias("blank"), F.max(F.length("line")).alias("longest"))


@query("rule_scan", f"{FOUND} SELECT * FROM found")
def rule_scan(s, d):
    return doc_findings(s, d)


SCORE = "greatest(0, least(100, CAST(round_even(100 - 20 * sqrt((15 * critical + 8 * high + 3 * medium + low) / 20), 0) AS INTEGER)))"
COUNTS = ", ".join(f"count_if(severity = '{x}') AS {x}" for x in V.SEVERITIES)


@query("flagship_project_score", f"{FOUND}, c AS (SELECT {COUNTS} FROM found) SELECT *, {SCORE} AS score FROM c")
def flagship(s, d):
    return O.project_score(doc_findings(s, d))


@query("severity_histogram", f"{FOUND} SELECT s.severity, count(found.file) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN found ON found.severity = s.severity GROUP BY s.severity")
def severity_histogram(s, d):
    return H.zero_filled(doc_findings(s, d), "severity", V.SEVERITIES)


DIMENSIONS = "ds AS (SELECT dimension, count(*) AS n, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high FROM found GROUP BY dimension), dd AS (SELECT *, CAST(greatest(0, CASE WHEN dimension = 'security' THEN 100 - 25 * critical - 10 * high ELSE 100 - 5 * n END) AS INTEGER) AS score FROM ds)"


@query("dimension_scores", f"{FOUND}, {DIMENSIONS} SELECT * FROM dd")
def dimension_scores(s, d):
    return O.dimension_scores(doc_findings(s, d))


@query("overall_score", f"{FOUND}, {DIMENSIONS}, w(dimension, weight) AS (VALUES {', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in V.DIMENSION_WEIGHTS.items())}) SELECT CAST(trunc(sum(coalesce(score, 100) * weight) / sum(weight)) AS INTEGER) AS overall, count_if(score < 100) AS below FROM w LEFT JOIN dd USING (dimension)")
def overall_score(s, d):
    return O.overall(O.dimension_scores(doc_findings(s, d)))


@query("review_scores", f"{FOUND} SELECT file, CAST(greatest(0, 100 - sum({sql_map(V.REVIEW_WEIGHTS, 'severity', '2')})) AS INTEGER) AS score, count(*) AS n FROM found GROUP BY file")
def review_scores(s, d):
    return O.review(doc_findings(s, d))


@query("files_per_rule", f"{FOUND} SELECT type, count(DISTINCT file) AS files, count(*) AS n FROM found GROUP BY type")
def files_per_rule(s, d):
    return doc_findings(s, d).groupBy("type").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"))


@query("context_snippets", f"{FOUND} SELECT f.file, f.line, f.rule, string_agg(l.line, chr(10) ORDER BY l.line_no) AS snippet FROM found f JOIN lines l ON l.file = f.file AND l.line_no BETWEEN f.line - 3 AND f.line + 3 GROUP BY ALL")
def context_snippets(s, d):
    return O.snippets(doc_findings(s, d), doc_lines(s, d), 3)


@query("lookback_absent", f"WITH {LINES}, n AS (SELECT *, max(contains(line, 'the')) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS near FROM lines) SELECT 'missing' AS type, 'low' AS severity, file, line_no AS line FROM n WHERE regexp_matches(stripped, '^[A-Z]') AND NOT coalesce(near, false)")
def lookback_absent(s, d):
    return O.missing_nearby(doc_lines(s, d), "^[A-Z]", "the", -12, -1, "missing", "low")


@query("lookahead_absent", f"WITH {LINES}, n AS (SELECT *, max(contains(line, 'the')) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS near FROM lines) SELECT 'missing' AS type, 'low' AS severity, file, line_no AS line FROM n WHERE regexp_matches(stripped, '^[A-Z]') AND NOT coalesce(near, false)")
def lookahead_absent(s, d):
    return O.missing_nearby(doc_lines(s, d), "^[A-Z]", "the", 1, 3, "missing", "low")


# ---- findings at scale: lineitem rows play findings

TYPES = ["bare_except", "broad_except", "sql_injection", "sqli", "print_used", "dead_code", "made_up"]
FIND = f"""f AS (SELECT ([{listed(TYPES)}])[l_partkey % 7 + 1] AS type, (['critical', 'high', 'medium', 'low'])[l_suppkey % 4 + 1] AS severity, (['security', 'quality', 'performance'])[l_suppkey % 3 + 1] AS dimension,
  'f' || (l_orderkey % 500) AS file, CAST(l_partkey % 60 AS INTEGER) AS line, l_discount * 10 AS confidence, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS ord, l_linenumber % 4 AS layer FROM lineitem)"""


def finds(s, d):
    pick = lambda xs, e: F.element_at(F.array(*map(F.lit, xs)), F.expr(e).cast("int"))
    return t(s, d, "lineitem").select(
        pick(TYPES, "l_partkey % 7 + 1").alias("type"), pick(V.SEVERITIES, "l_suppkey % 4 + 1").alias("severity"), pick(["security", "quality", "performance"], "l_suppkey % 3 + 1").alias("dimension"),
        F.concat(F.lit("f"), (F.col("l_orderkey") % 500).cast("string")).alias("file"), (F.col("l_partkey") % 60).cast("int").alias("line"), (F.col("l_discount") * 10).alias("confidence"),
        F.expr("((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey").alias("ord"), (F.col("l_linenumber") % 4).alias("layer"),
    )


BUCKET = "CASE WHEN line > 0 THEN line // 3 ELSE 0 END"
FP = f"left(md5(type || ':' || file || ':' || ({BUCKET})), 16)"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END"
FAMILY = sql_map({x: f for f, xs in V.TYPE_FAMILIES.items() for x in xs}, "type", "type")
SIG = f"file || ':' || ({FAMILY}) || ':' || ({BUCKET})"


@query("normalise_types", f"WITH {FIND}, n AS (SELECT * REPLACE ({sql_map(V.TYPE_ALIASES, 'type', 'type')} AS type) FROM f WHERE coalesce(confidence, 0.5) >= 0.8) SELECT type, count(*) AS n FROM n GROUP BY type")
def normalise_types(s, d):
    return O.normalise(finds(s, d)).groupBy("type").agg(F.count("*").alias("n"))


@query("normalise_types_strict", f"WITH {FIND}, n AS (SELECT * REPLACE ({sql_map(V.TYPE_ALIASES, 'type', 'type')} AS type) FROM f WHERE coalesce(confidence, 0.5) >= 0.8) SELECT type, count(*) AS n FROM n WHERE type IN ({listed(V.VALID_TYPES)}) GROUP BY type")
def normalise_types_strict(s, d):
    return O.normalise(finds(s, d), strict=True).groupBy("type").agg(F.count("*").alias("n"))


@query("dedup_fingerprint", f"WITH {FIND}, x AS (SELECT *, {FP} AS fingerprint FROM f), y AS (SELECT *, min(ord) OVER (PARTITION BY fingerprint) AS seen, row_number() OVER (PARTITION BY fingerprint ORDER BY {RANK}, ord) AS r FROM x) SELECT type, severity, dimension, file, line, ord, fingerprint, seen FROM y WHERE r = 1")
def dedup_fingerprint(s, d):
    return O.most_severe(finds(s, d)).select("type", "severity", "dimension", "file", "line", "ord", "fingerprint", "seen")


@query("merge_layers", f"WITH {FIND}, x AS (SELECT *, {SIG} AS signature, row_number() OVER (PARTITION BY {SIG} ORDER BY layer, ord) AS r FROM f) SELECT signature, type, layer, ord FROM x WHERE r = 1")
def merge_layers(s, d):
    return O.merge_layers(finds(s, d)).select("signature", "type", "layer", "ord")


@query("layer_anti_join", f"WITH {FIND}, x AS (SELECT *, {SIG} AS signature FROM f) SELECT signature, ord FROM x WHERE layer = 3 AND signature NOT IN (SELECT signature FROM x WHERE layer < 2)")
def layer_anti_join(s, d):
    x = finds(s, d)
    return O.unknown_only(x.where("layer = 3"), x.where("layer < 2")).select("signature", "ord")


@query("layer_stats", f"WITH {FIND}, x AS (SELECT *, row_number() OVER (PARTITION BY {SIG} ORDER BY layer, ord) AS r FROM f) SELECT layer, count(*) AS found, count_if(r = 1) AS kept, count(DISTINCT file) AS files FROM x GROUP BY layer")
def layer_stats(s, d):
    x = finds(s, d)
    kept = O.merge_layers(x).groupBy("layer").agg(F.count("*").alias("kept"))
    return x.groupBy("layer").agg(F.count("*").alias("found"), F.countDistinct("file").alias("files")).join(kept, "layer", "left").select("layer", "found", F.coalesce("kept", F.lit(0)).alias("kept"), "files")


CLUSTER = f"""WITH {FIND}, a AS (SELECT *, lag(line) OVER w AS p FROM f WINDOW w AS (PARTITION BY file, type, dimension ORDER BY line, ord)),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR line - p > 3 OR (p = 0) <> (line = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY file, type, dimension ORDER BY line, ord) AS cluster FROM a),
c AS (SELECT file, type, dimension, cluster, first(severity ORDER BY line, ord) AS severity, coalesce(min(CASE WHEN line > 0 THEN line END), 0) AS line, count(*) AS n FROM b GROUP BY file, type, dimension, cluster)"""


@query("gap_clusters", f"{CLUSTER} SELECT file, type, dimension, CAST(cluster AS BIGINT) AS cluster, severity, line, n FROM c")
def gap_clusters(s, d):
    return O.clusters(finds(s, d), most=1 << 30).select("file", "type", "dimension", F.col("cluster").cast("long").alias("cluster"), "severity", "line", "n")


@query("gap_clusters_capped", f"{CLUSTER}, r AS (SELECT *, row_number() OVER (PARTITION BY file, type ORDER BY dimension, cluster) AS k FROM c) SELECT file, type, dimension, severity, line, n FROM r WHERE k = 1")
def gap_clusters_capped(s, d):
    return O.clusters(finds(s, d)).select("file", "type", "dimension", "severity", "line", "n")


@query("findings_sorted_top", f"WITH {FIND} SELECT type, severity, file, line, ord FROM f ORDER BY {RANK}, file, line, ord LIMIT 100")
def findings_sorted_top(s, d):
    return finds(s, d).orderBy(S.rank(F.col("severity"), 9), "file", "line", "ord").limit(100).select("type", "severity", "file", "line", "ord")


@query("severity_threshold", f"WITH {FIND} SELECT severity, count(*) AS n FROM f WHERE {RANK} <= 1 GROUP BY severity")
def severity_threshold(s, d):
    return finds(s, d).where(S.rank(F.col("severity")) <= 1).groupBy("severity").agg(F.count("*").alias("n"))


@query("valid_nonzero_lines", f"WITH {FIND} SELECT count(*) AS n, count_if(line > 0 AND type <> 'made_up') AS valid FROM f")
def valid_nonzero_lines(s, d):
    return finds(s, d).agg(F.count("*").alias("n"), F.count_if((F.col("line") > 0) & (F.col("type") != "made_up")).alias("valid"))


COMPLEX = f"CASE WHEN type IN ({listed(V.SIMPLE_TYPES)}) THEN 'simple' WHEN type IN ({listed(V.COMPLEX_TYPES)}) THEN 'complex' ELSE 'medium' END"


@query("assess_issues", f"""WITH {FIND}, x AS (SELECT *, {FP} AS fingerprint FROM f), y AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY {RANK}, ord) AS r FROM x), z AS (SELECT *, CAST(count(*) OVER (PARTITION BY file) AS INTEGER) - 1 AS related, {COMPLEX} AS complexity FROM y WHERE r = 1)
SELECT ord, related, complexity, greatest(CASE complexity WHEN 'simple' THEN 30 WHEN 'medium' THEN 120 ELSE 600 END - 10 * related, 15) AS effort,
CASE WHEN type IN ({listed(V.SECURITY_TYPES)}) THEN 'high' WHEN type IN ({listed(V.RESOURCE_TYPES)}) THEN 'medium' WHEN type IN ({listed(V.SIMPLE_TYPES[:4])}) THEN 'low' ELSE 'medium' END AS regression,
CASE WHEN type IN ({listed(V.SECURITY_TYPES)}) THEN true WHEN type IN ({listed(V.RESOURCE_TYPES + V.SIMPLE_TYPES[:4])}) THEN false ELSE severity IN ('critical', 'high') END AS confirm FROM z""")
def assess_issues(s, d):
    return O.assessed(finds(s, d)).select("ord", "related", "complexity", "effort", "risk.regression", "risk.confirm")


@query("band_semi_join", f"WITH {FIND} SELECT ord FROM f a WHERE layer = 0 AND EXISTS (SELECT 1 FROM f b WHERE b.layer = 1 AND b.file = a.file AND b.type = a.type AND abs(a.line - b.line) <= 3)")
def band_semi_join(s, d):
    x = finds(s, d)
    return O.still_there(x.where("layer = 0"), x.where("layer = 1")).select("ord")


@query("regression_guard", f"WITH {FIND}, c AS (SELECT severity, count_if(layer = 0) AS before, count_if(layer = 1) AS after FROM f GROUP BY severity) SELECT severity, before, after, after - before AS delta, (severity IN ('critical', 'high') AND after > before) OR after - before >= 3 AS unsafe FROM c")
def regression_guard(s, d):
    x = finds(s, d)
    side = lambda k, n: x.where(f"layer = {k}").groupBy("severity").agg(F.count("*").alias(n))
    y = side(0, "before").join(side(1, "after"), "severity", "full").na.fill(0)
    delta = F.col("after") - F.col("before")
    return y.select("severity", "before", "after", delta.alias("delta"), ((F.col("severity").isin("critical", "high") & (delta > 0)) | (delta >= 3)).alias("unsafe"))


@query("type_mode_per_file", f"WITH {FIND}, c AS (SELECT file, type, count(*) AS n, min(ord) AS o FROM f GROUP BY file, type), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, o) AS k FROM c) SELECT file, type, n FROM r WHERE k = 1")
def type_mode_per_file(s, d):
    return H.mode(finds(s, d), ["file"], "type", "ord")


@query("approval_ids", f"WITH {FIND} SELECT ord, left(md5(type || ':' || file || ':' || line || ':fix'), 12) AS id, left(sha256(file), 16) AS content FROM f")
def approval_ids(s, d):
    return finds(s, d).select("ord", S.approval_id(F.col("type"), F.col("file"), F.col("line"), F.lit("fix")).alias("id"), S.short_hash(F.col("file")).alias("content"))


@query("gate_decisions", f"WITH {FIND} SELECT CASE WHEN severity = 'low' THEN 'rejected' WHEN confidence >= 0.8 THEN 'auto_apply' WHEN confidence >= 0.5 THEN 'pending_review' ELSE 'rejected' END AS decision, count(*) AS n FROM f GROUP BY 1")
def gate_decisions(s, d):
    return finds(s, d).groupBy(S.gate(F.col("severity") != "low", F.col("confidence")).alias("decision")).agg(F.count("*").alias("n"))


@query("triage_bands", f"WITH {FIND} SELECT CASE WHEN confidence >= 0.7 THEN 'true_positive' WHEN confidence < 0.4 THEN 'false_positive' ELSE 'uncertain' END AS verdict, count(*) AS n FROM f GROUP BY 1")
def triage_bands(s, d):
    return finds(s, d).groupBy(S.triage(F.col("confidence")).alias("verdict")).agg(F.count("*").alias("n"))


# ---- logs, tasks, metrics over events

EV = "e AS (SELECT event_id AS ord, ts, CAST(ts AS DATE) AS date, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, user_id, event_type AS level, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'in_progress' END AS status, 'task-' || (event_id % 97) AS task_id, 'u' || user_id AS request_id, value FROM events)"


def logs(s, d):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("in_progress")
    return t(s, d, "events").select(
        F.col("event_id").alias("ord"), "ts", F.to_date("ts").alias("date"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "user_id", F.col("event_type").alias("level"), status.alias("status"),
        F.concat(F.lit("task-"), (F.col("event_id") % 97).cast("string")).alias("task_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("request_id"), "value",
    )


@query("log_query", f"WITH {EV} SELECT ord, timestamp, level, task_id FROM e WHERE upper(level) = 'ERROR' AND contains(task_id, '1') AND status = 'failed' ORDER BY timestamp DESC, ord DESC LIMIT 50")
def log_query(s, d):
    return H.query_logs(logs(s, d), status="failed", task="1", level="Error", limit=50).select("ord", "timestamp", "level", "task_id")


@query("log_histograms", f"WITH {EV} SELECT 'level' AS field, level AS value, count(*) AS n FROM e GROUP BY level UNION ALL SELECT 'status', status, count(*) FROM e GROUP BY status")
def log_histograms(s, d):
    x = logs(s, d)
    part = lambda c: x.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("field"), "value", "n")
    return part("level").unionByName(part("status"))


@query("log_time_part", f"WITH {EV} SELECT ord, substr(timestamp, 12, 8) AS clock FROM e")
def log_time_part(s, d):
    return logs(s, d).select("ord", S.time_part(F.col("timestamp")).alias("clock"))


@query("agent_pivot", f"WITH {EV} SELECT user_id, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, count_if(status = 'skipped') AS skipped, count_if(status = 'in_progress') AS in_progress, count(*) AS total FROM e GROUP BY user_id")
def agent_pivot(s, d):
    return logs(s, d).groupBy("user_id").agg(*(F.count_if(F.col("status") == k).alias(k) for k in ("completed", "failed", "skipped", "in_progress")), F.count("*").alias("total"))


@query("pass_rates", f"WITH {EV}, c AS (SELECT user_id, count_if(status = 'completed') AS a, count_if(status = 'failed') AS b FROM e GROUP BY user_id) SELECT user_id, CASE WHEN a + b > 0 THEN round_even(a / (a + b), 4) END AS pass_rate FROM c")
def pass_rates(s, d):
    return logs(s, d).groupBy("user_id").agg(H.rate(F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")).alias("pass_rate"))


@query("weighted_severity", "SELECT CAST(sum(CASE event_type WHEN 'error' THEN 40 WHEN 'click' THEN 20 ELSE 10 END) AS BIGINT) AS weight, count(*) AS n FROM events")
def weighted_severity(s, d):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "info").otherwise("debug")
    return t(s, d, "events").agg(F.sum(S.lookup(V.ISSUE_WEIGHTS, kind, F.lit(0))).cast("long").alias("weight"), F.count("*").alias("n"))


@query("top_issues", "SELECT event_id, event_type, value FROM events ORDER BY value DESC, ts, event_id LIMIT 5")
def top_issues(s, d):
    return t(s, d, "events").orderBy(F.desc("value"), "ts", "event_id").limit(5).select("event_id", "event_type", "value")


@query("module_frequency", "SELECT CASE WHEN user_id % 10 = 0 THEN 'unknown' ELSE 'm' || (user_id % 10) END AS module, count(*) AS n FROM events GROUP BY 1")
def module_frequency(s, d):
    m = F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")))
    return t(s, d, "events").groupBy(F.coalesce(F.nullif(m, F.lit("")), F.lit("unknown")).alias("module")).agg(F.count("*").alias("n"))


@query("round_durations", "SELECT user_id, count(*) AS rounds, round(sum(value), 3) AS total, round(avg(value), 3) AS mean FROM events GROUP BY user_id")
def round_durations(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("rounds"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 3).alias("mean"))


@query("event_islands", "WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), q AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM p) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_id FROM q GROUP BY user_id, island")
def event_islands(s, d):
    x = O.islands(t(s, d, "events"), ["user_id"], "ts", F.expr("INTERVAL '6' HOUR"), "event_id")
    return x.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


# ---- costs

@query("cost_by_provider", "SELECT c_mktsegment AS provider, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def cost_by_provider(s, d):
    x = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("c_mktsegment").alias("provider"), F.to_date("o_orderdate").cast("string").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("cost_day_total", "SELECT round(coalesce(sum(o_totalprice), 0), 2) AS total FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1900-01-01'")
def cost_day_total(s, d):
    return t(s, d, "orders").where(F.to_date("o_orderdate") == F.lit("1900-01-01").cast("date")).agg(F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


TREND = "WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders), x AS (SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 4) AS total FROM orders, m WHERE CAST(o_orderdate AS DATE) > m.d - 7 GROUP BY 1)"


def cost_days(s, d):
    x = t(s, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice")
    last = x.agg(F.max("date").alias("last"))
    return x.join(F.broadcast(last), F.col("date") > F.date_sub("last", 7)).groupBy("date").agg(F.round(F.sum("o_totalprice"), 4).alias("total"))


@query("cost_trend", f"{TREND} SELECT CAST(date AS VARCHAR) AS date, total FROM x")
def cost_trend(s, d):
    return cost_days(s, d).withColumn("date", F.col("date").cast("string"))


@query("cost_week", f"{TREND} SELECT round(sum(total), 2) AS total, round(sum(total) / greatest(count(*), 1), 2) AS mean FROM x")
def cost_week(s, d):
    return cost_days(s, d).agg(F.round(F.sum("total"), 2).alias("total"), F.round(F.sum("total") / F.greatest(F.count("*"), F.lit(1)), 2).alias("mean"))


@query("cost_tiers", "SELECT CASE WHEN o_totalprice / 100000 >= 4.5 THEN 'red' WHEN o_totalprice / 100000 >= 2 THEN 'yellow' ELSE 'green' END AS tier, count(*) AS n FROM orders GROUP BY 1")
def cost_tiers(s, d):
    return t(s, d, "orders").groupBy(S.cost_tier(F.col("o_totalprice") / 100000).alias("tier")).agg(F.count("*").alias("n"))


@query("task_costs", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 7")
def task_costs(s, d):
    return t(s, d, "orders").where("o_custkey = 7").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("token_cost", "SELECT doc_id, CAST(trunc(0.35::DOUBLE * length(text)) AS INTEGER) AS tokens, round(trunc(0.35::DOUBLE * length(text)) * 0.27::DOUBLE / 1000000, 9) AS cost FROM documents")
def token_cost(s, d):
    n = (F.length("text") * 0.35).cast("int")
    return t(s, d, "documents").select("doc_id", n.alias("tokens"), F.round(n * 0.27 / 1000000, 9).alias("cost"))


# ---- experience: events play records (type, fixer), success from the value

EX = "x AS (SELECT event_id AS ord, event_type AS type, 'fix' || (user_id % 12) AS fixer, value, value < 40 AS success, ts FROM events)"
CAL = "c AS (SELECT type, fixer, count(*) AS samples, round_even(greatest(0.1, least(0.99, avg(CAST(success AS INTEGER)))), 3) AS calibrated FROM x GROUP BY type, fixer HAVING count(*) >= 3)"


def experience(s, d):
    return t(s, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("type"), F.concat(F.lit("fix"), (F.col("user_id") % 12).cast("string")).alias("fixer"), "value", (F.col("value") < 40).alias("success"), "ts")


@query("calibration", f"WITH {EX}, {CAL} SELECT * FROM c")
def calibration(s, d):
    return H.calibrate(experience(s, d), ["type", "fixer"], "success")


@query("calibrated_lookup", f"WITH {EX}, {CAL} SELECT x.ord, coalesce(CASE WHEN samples >= 60 THEN calibrated END, 0.5) AS confidence FROM x LEFT JOIN c USING (type, fixer)")
def calibrated_lookup(s, d):
    x = experience(s, d)
    return H.calibrated(x.withColumn("original", F.lit(0.5)), H.calibrate(x, ["type", "fixer"], "success"), ["type", "fixer"], "original", 60).select("ord", "confidence")


@query("pattern_stats", f"WITH {EX} SELECT type, fixer, count(*) AS total, count_if(success) AS successes, count_if(NOT success) AS failures, round_even(avg(value), 6) AS mean_confidence, min(ts) AS first_seen, max(ts) AS last_seen FROM x GROUP BY type, fixer")
def pattern_stats(s, d):
    return H.pattern_stats(experience(s, d), ["type", "fixer"], "success", "value", "ts")


@query("best_strategy", f"WITH {EX}, s AS (SELECT type, fixer, avg(CAST(success AS INTEGER)) AS rate FROM x WHERE value > 5 GROUP BY type, fixer HAVING count(*) >= 40), k AS (SELECT DISTINCT type, fixer, CAST(substr(fixer, 4) AS INTEGER) AS reg FROM x) SELECT type, fixer, row_number() OVER (PARTITION BY type ORDER BY rate IS NOT NULL DESC, coalesce(rate, -1) DESC, reg) AS place FROM k LEFT JOIN s USING (type, fixer)")
def best_strategy(s, d):
    x = experience(s, d)
    stats = x.where("value > 5").groupBy("type", "fixer").agg(F.avg(F.col("success").cast("int")).alias("rate"), F.count("*").alias("n")).where("n >= 40")
    return H.best_strategy(x.select("type", "fixer", F.substring("fixer", 4, 9).cast("int").alias("reg")).distinct(), stats, "type", "fixer").select("type", "fixer", "place")


@query("relevant_experiences", f"""WITH {EX}, r AS (SELECT type, ord, round((CASE WHEN success THEN 1 ELSE 0.5 END + CASE WHEN fixer = 'fix3' THEN 0.5 ELSE 0 END + CASE WHEN ord % 4 = 1 THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS relevance FROM x)
SELECT type, ord, relevance FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY relevance DESC, ord) AS k FROM r) WHERE k <= 5""")
def relevant_experiences(s, d):
    """The five records of each type that suit a Python file of the folder fix3 best."""
    suffix = F.element_at(F.array(*map(F.lit, ["js", "py", "ts", ""])), (F.col("ord") % 4 + 1).cast("int"))
    r = F.round(H.relevance(F.col("success"), F.col("fixer"), F.lit("fix3"), suffix, F.lit("py")), 6)
    return H.tail(experience(s, d).select("type", "ord", r.alias("relevance")), 5, [F.desc("relevance"), F.col("ord")], ["type"])


@query("running_mean", f"WITH {EX} SELECT ord, round(avg(value) OVER (PARTITION BY type, fixer ORDER BY ord ROWS UNBOUNDED PRECEDING), 10) AS mean, count(*) OVER (PARTITION BY type, fixer ORDER BY ord ROWS UNBOUNDED PRECEDING) AS samples FROM x")
def running_mean(s, d):
    return H.running_mean(experience(s, d), ["type", "fixer"], "value", "ord").select("ord", F.round("mean", 10).alias("mean"), "samples")


@query("retention_tail", f"WITH {EX}, r AS (SELECT ord, type, row_number() OVER (PARTITION BY type ORDER BY ord DESC) AS k FROM x) SELECT ord, type FROM r WHERE k <= 50")
def retention_tail(s, d):
    return H.tail(experience(s, d), 50, ["ord"], ["type"]).select("ord", "type")


@query("trend_rates", f"WITH {EX}, r AS (SELECT *, row_number() OVER (PARTITION BY type, fixer ORDER BY ord DESC) AS k FROM x), q AS (SELECT type, fixer, avg(CASE WHEN k <= 5 THEN CAST(success AS INTEGER) END) AS recent, avg(CASE WHEN k > 5 THEN CAST(success AS INTEGER) END) AS earlier FROM r WHERE k <= 10 GROUP BY type, fixer) SELECT type, fixer, recent, earlier, recent >= earlier AS improving FROM q")
def trend_rates(s, d):
    return H.trend(experience(s, d), ["type", "fixer"], ["ord"], "success")


DAILY = "day AS (SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS score FROM events GROUP BY 1, 2)"


@query("convergence", f"WITH {DAILY} SELECT event_type, CAST(date AS VARCHAR) AS date, score, score - lag(score) OVER w AS delta, count(score) OVER v = 3 AND max(score) OVER v - min(score) OVER v <= 3 AS converged FROM day WINDOW w AS (PARTITION BY event_type ORDER BY date), v AS (PARTITION BY event_type ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def convergence(s, d):
    day = t(s, d, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.count("*").alias("score"))
    return H.converged(day, ["event_type"], "date", "score").withColumn("date", F.col("date").cast("string"))


@query("skill_suggestions", f"""WITH {EX}, s AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER w AS k, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY type, fixer ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT type, fixer, CAST(max(k) AS BIGINT) AS successes, min(CASE WHEN k = 3 THEN ord END) AS suggested_at, round_even(arg_min(3 / n, ord) FILTER (k = 3), 6) AS success_rate FROM s GROUP BY type, fixer HAVING max(k) >= 3""")
def skill_suggestions(s, d):
    return H.suggestions(experience(s, d), ["type", "fixer"], "success", "ord")


@query("operation_caps", "WITH o AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'delete_file' WHEN 'click' THEN 'git_push' WHEN 'view' THEN 'overwrite_file' ELSE 'read' END AS op FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, op ORDER BY event_id) AS place FROM o) SELECT event_id, place <= CASE op WHEN 'delete_file' THEN 3 WHEN 'git_push' THEN 1 WHEN 'overwrite_file' THEN 10 ELSE 1000000000 END AS allowed FROM r")
def operation_caps(s, d):
    op = F.when(F.col("event_type") == "error", "delete_file").when(F.col("event_type") == "click", "git_push").when(F.col("event_type") == "view", "overwrite_file").otherwise("read")
    return H.capped(t(s, d, "events").select("event_id", "user_id", op.alias("op")), ["user_id"], ["event_id"], V.ROUND_CAPS).select("event_id", "allowed")


@query("feedback_suppression", "WITH o AS (SELECT event_id AS ord, user_id, CASE WHEN event_type = 'error' THEN 'unmark' ELSE 'mark' END AS op FROM events), u AS (SELECT *, max(CASE WHEN op = 'unmark' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS gone FROM o) SELECT user_id, count(*) AS marks FROM u WHERE gone = 0 GROUP BY user_id HAVING count(*) >= 2")
def feedback_suppression(s, d):
    op = F.when(F.col("event_type") == "error", "unmark").otherwise("mark")
    return H.suppressed(t(s, d, "events").select("user_id", op.alias("op"), F.col("event_id").alias("at"), F.col("event_id").alias("ord")), ["user_id"])


# ---- text functions, keys, similarity

KEYS = ["api_key", "apikey", "password", "passwd", "token", "secret", "authorization", "credential"]


@query("redaction", "WITH r AS (SELECT doc_id, " + "".join("regexp_replace(" for _ in KEYS) + "text" + "".join(rf""", '({k}\s*[=:]\s*)["'']?([^"'' \n,;}}]{{8,}})["'']?', '\1***', 'gi')""" for k in KEYS) + " AS text, text AS old FROM documents) SELECT doc_id, md5(text) AS digest, text <> old AS changed FROM r")
def redaction(s, d):
    x = t(s, d, "documents").select("doc_id", "text", S.redact(F.col("text"), KEYS).alias("new"))
    return x.select("doc_id", F.md5("new").alias("digest"), (F.col("new") != F.col("text")).alias("changed"))


@query("summaries", "WITH f AS (SELECT doc_id, trim(split_part(trim(text), chr(10), 1)) AS l FROM documents) SELECT doc_id, CASE WHEN length(l) > 80 THEN left(l, 77) || '...' ELSE l END AS summary FROM f")
def summaries(s, d):
    return t(s, d, "documents").select("doc_id", S.first_line(F.col("text")).alias("summary"))


@query("pattern_keys", r"SELECT doc_id, trim(regexp_replace(left(regexp_replace(text, '[\p{L}\p{N}_]+', 'W', 'g'), 50), '\s+', ' ', 'g')) AS key FROM documents")
def pattern_keys(s, d):
    return t(s, d, "documents").select("doc_id", S.pattern_key(F.col("text")).alias("key"))


@query("feedback_keys", r"SELECT doc_id, source || ':input:' || lang || ':' || left(md5(trim(regexp_replace(left(text, 100), '\s+', ' ', 'g'))), 12) AS key FROM documents")
def feedback_keys(s, d):
    return t(s, d, "documents").select("doc_id", S.feedback_key(F.col("source"), F.lit("input"), F.col("lang"), F.col("text")).alias("key"))


@query("content_hashes", "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents")
def content_hashes(s, d):
    return t(s, d, "documents").select("doc_id", S.short_hash(F.col("text")).alias("hash"))


TOKENS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


@query("best_similarity", f"WITH b AS (SELECT item_id, {TOKENS} AS w FROM benchmark), d AS (SELECT doc_id, {TOKENS} AS w FROM documents), p AS (SELECT doc_id, item_id, round(len(list_intersect(d.w, b.w)) / (len(d.w) + len(b.w) - len(list_intersect(d.w, b.w))), 9) AS score FROM d, b), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM p) SELECT doc_id, item_id, score FROM r WHERE k = 1 AND score >= 0.3")
def best_similarity(s, d):
    return E.most_similar(t(s, d, "documents").select("doc_id", "text"), t(s, d, "benchmark").select("item_id", "text"), 0.3)


@query("path_similarity", "WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages), q AS (SELECT page_id, url, lag(url) OVER (ORDER BY page_id) AS prev FROM p) SELECT page_id, CASE WHEN url = prev THEN 1 WHEN regexp_extract(url, '^(.*)/[^/]*$', 1) = regexp_extract(prev, '^(.*)/[^/]*$', 1) THEN 0.5 ELSE 0.1 END::DOUBLE AS score FROM q WHERE prev IS NOT NULL")
def path_similarity(s, d):
    p = t(s, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    q = p.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("prev"))
    return p.join(q, "page_id").select("page_id", S.path_similarity(F.col("url"), F.col("prev")).alias("score"))


@query("failure_classes", "SELECT doc_id, " + "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n in V.FAILURES) + " END AS failure FROM documents")
def failure_classes(s, d):
    return t(s, d, "documents").select("doc_id", S.failure_class(F.col("text")).alias("failure"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(s, d):
    return t(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- joins, sets, vectors, graphs

@query("semi_changed_files", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_changed_files(s, d):
    return t(s, d, "documents").join(t(s, d, "labels").where("quality = 0"), "doc_id", "left_semi").select("doc_id")


@query("anti_not_indexed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_not_indexed(s, d):
    return t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("union_distinct", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return t(s, d, "nation").select(F.col("n_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey")).distinct()


@query("set_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(t(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("mtime_changes", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR n_chars % 5 = 0")
def mtime_changes(s, d):
    from ..sources.readers import changed

    now = t(s, d, "documents").select(F.col("doc_id").alias("file"), F.col("n_chars").alias("mtime"))
    before = now.where("file % 7 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("mtime") % 5 == 0, 1).otherwise(0))
    return changed(now, before).select(F.col("file").alias("doc_id"))


@query("wildcard_dispatch", "WITH f(fixer, type, reg) AS (VALUES ('a', 'error', 0), ('b', '*', 1), ('c', 'click', 2), ('d', 'error', 3)) SELECT event_id, fixer FROM (SELECT event_id, fixer, row_number() OVER (PARTITION BY event_id ORDER BY type = '*', reg) AS k FROM events JOIN f ON f.type = event_type OR f.type = '*') WHERE k = 1")
def wildcard_dispatch(s, d):
    f = s.createDataFrame([("a", "error", 0), ("b", "*", 1), ("c", "click", 2), ("d", "error", 3)], "fixer string, type string, reg int")
    exact = O.first_by(f.where("type <> '*'"), ["type"], [F.col("reg")]).select(F.col("type").alias("event_type"), "fixer")
    any_type = f.where("type = '*'").orderBy("reg").limit(1).select(F.col("fixer").alias("other"))
    return t(s, d, "events").join(exact, "event_type", "left").join(F.broadcast(any_type), F.lit(True), "left").select("event_id", F.coalesce("fixer", "other").alias("fixer"))


@query("vector_top_k", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1), x AS (SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10) SELECT * FROM x WHERE score >= 0.3")
def vector_top_k(s, d):
    e = t(s, d, "embeddings")
    return H.top_inner_products(e, e.where("vec_id = 1"), "vec_id", "embedding", 10).select(F.col("neighbour").alias("vec_id"), F.round("score", 6).alias("score"))


@query("vector_top_k_all", "WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query, vec_id AS neighbour, list_dot_product(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS k FROM x) SELECT query AS vec_id, neighbour, round(s, 6) AS score FROM r WHERE k <= 10 AND s >= 0.3")
def vector_top_k_all(s, d):
    e = t(s, d, "embeddings")
    return H.top_inner_products(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("vec_id", "neighbour", F.round("score", 6).alias("score"))


@query("dag_levels", "WITH RECURSIVE g AS (SELECT n_nationkey AS node FROM nation), e AS (SELECT a.node AS src, b.node AS dst FROM g a JOIN g b ON b.node IN (2 * a.node + 1, 2 * a.node + 2)), l(node, level) AS (SELECT node, 0 FROM g WHERE node NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node) SELECT node, max(level) AS level FROM l GROUP BY node")
def dag_levels(s, d):
    nodes = t(s, d, "nation").select(F.col("n_nationkey").alias("node"))
    edges = nodes.select(F.col("node").alias("src"), F.explode(F.array(2 * F.col("node") + 1, 2 * F.col("node") + 2)).alias("dst"))
    return G.levels(nodes, edges)


@query("batch_plan", "WITH x AS (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a,b' ELSE o_orderpriority END AS g FROM orders), r AS (SELECT o_orderkey, g, row_number() OVER (PARTITION BY g ORDER BY o_orderkey) AS k FROM x) SELECT o_orderkey, CAST(ceil(k / 3) AS BIGINT) AS batch FROM r")
def batch_plan(s, d):
    k = F.col("o_custkey") % 4
    waits = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("a"))).when(k == 2, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array("o_orderpriority"))
    return I.batches(t(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), waits.alias("depends"), F.col("o_orderkey").alias("ord"))).select(F.col("task_id").alias("o_orderkey"), "batch")


@query("status_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def status_cube(s, d):
    return t(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("approval_states", """WITH e AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'queue' WHEN length(text) % 4 = 0 THEN 'reply' WHEN length(text) % 4 = 1 THEN 'approve' WHEN length(text) % 4 = 2 THEN 'reject' ELSE 'expire' END AS op FROM conversations),
l AS (SELECT conv_id, list(op ORDER BY turn, op) AS ops, count(*) AS n_events FROM e GROUP BY conv_id)
SELECT conv_id AS id, list_reduce(list_prepend('', ops), lambda s, o: CASE WHEN s = '' AND o = 'queue' THEN 'pending' WHEN s = 'pending' AND o = 'approve' THEN 'approved' WHEN s = 'pending' AND o = 'reject' THEN 'rejected' WHEN s IN ('pending', 'replied') AND o = 'reply' THEN 'replied' WHEN s IN ('pending', 'replied') AND o = 'expire' THEN 'expired' ELSE s END) AS status, n_events FROM l""")
def approval_states(s, d):
    n = F.length("text") % 4
    op = F.when(F.col("turn") == 0, "queue").when(n == 0, "reply").when(n == 1, "approve").when(n == 2, "reject").otherwise("expire")
    x = H.approvals(t(s, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("at"), F.lit(0).alias("ord"), op.alias("op")))
    return x.withColumn("status", F.coalesce("status", F.lit("")))


# ---- events by time window; streams use the same functions

@query("hourly_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_windows(s, d):
    from ..streaming.windows import windowed_counts

    return windowed_counts(t(s, d, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("user_sessions", "WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), q AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM p) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM q GROUP BY user_id, island")
def user_sessions(s, d):
    from ..streaming.windows import sessions

    return sessions(t(s, d, "events"), "ts", "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("tolerant_json", "SELECT event_id AS response_id, 0 AS ord, event_type AS type, 'low' AS severity, 'f' || user_id AS file, CAST(event_id % 100 AS INTEGER) AS line FROM events")
def tolerant_json(s, d):
    from ..operators.responses import parse_responses

    e = t(s, d, "events")
    one = F.to_json(F.struct(F.col("event_type").alias("type"), F.lit("low").alias("severity"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 100).alias("line")))
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.concat(F.lit("["), one, F.lit("]"))).when(n == 1, F.concat(F.lit("Here:\n```json\n{\"issues\": ["), one, F.lit(",]}\n```"))).when(n == 2, F.concat(F.lit("["), one, F.lit(", {\"type\": \"cut"))).otherwise(one)
    return parse_responses(e.select(F.col("event_id").alias("response_id"), text.alias("text")))


# ---- tails, histories, pressure

@query("queue_stats", ORACLES["approval_states"].replace("SELECT conv_id AS id,", "SELECT status, count(*) AS n FROM (SELECT conv_id AS id,").rstrip() + ") GROUP BY status")
def queue_stats(s, d):
    return approval_states(s, d).groupBy("status").agg(F.count("*").alias("n"))


@query("audit_tail", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 20")
def audit_tail(s, d):
    return H.tail(t(s, d, "conversations").where("role = 'user'"), 20, ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query("phase_spans", "SELECT conv_id, count(*) AS phases, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text)) AS chars FROM conversations GROUP BY conv_id")
def phase_spans(s, d):
    return t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("phases"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("heavy_rounds", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 5")
def heavy_rounds(s, d):
    return t(s, d, "orders").where("o_totalprice > 300000").orderBy("o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("history_overview", "SELECT o_orderstatus, count(*) AS total, count_if(o_totalprice > 150000) AS good, round_even(100 * count_if(o_totalprice > 150000) / count(*), 1) AS percent FROM orders GROUP BY o_orderstatus")
def history_overview(s, d):
    good = F.count_if(F.col("o_totalprice") > 150000)
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("total"), good.alias("good"), F.bround(100 * good / F.count("*"), 1).alias("percent"))


@query("latest_per_user", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_per_user(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("rolling_delegations", "SELECT event_id, count_if(event_type = 'purchase') OVER w AS recent, count(*) OVER w >= 3 AND count_if(event_type = 'purchase') OVER w = 0 AS warn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_delegations(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    recent = F.count_if(F.col("event_type") == "purchase").over(w)
    return t(s, d, "events").select("event_id", recent.alias("recent"), ((F.count("*").over(w) >= 3) & (recent == 0)).alias("warn"))


@query("queue_pressure", "WITH b AS (SELECT user_id, event_id, ts, value >= 20 AS breach FROM events), g AS (SELECT *, count_if(NOT breach) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n FROM g WHERE breach GROUP BY user_id, island HAVING max(ts) - min(ts) >= INTERVAL 6 HOUR")
def queue_pressure(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = t(s, d, "events").withColumn("breach", F.col("value") >= 20).withColumn("island", F.count_if(~F.col("breach")).over(w)).where("breach")
    x = x.groupBy("user_id", "island").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts") >= F.expr("INTERVAL '6' HOUR")).alias("held"))
    return x.where("held").select("user_id", "island", "n")


@query("extension_histogram", "WITH p AS (SELECT regexp_extract(regexp_replace(url, '[?#].*$', ''), '[.]([A-Za-z0-9]+)$', 1) AS ext FROM pages) SELECT ext, count(*) AS n FROM p GROUP BY ext")
def extension_histogram(s, d):
    ext = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[.]([A-Za-z0-9]+)$", 1)
    return t(s, d, "pages").groupBy(ext.alias("ext")).agg(F.count("*").alias("n"))


@query("primary_language", "SELECT lang, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ORDER BY n DESC, lang LIMIT 1")
def primary_language(s, d):
    return t(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(1)


@query("hardcoded_numbers", f"WITH {LINES} SELECT file, line_no AS line, regexp_extract(line, '[0-9]{{4,}}', 0) AS number FROM lines WHERE regexp_matches(line, '[0-9]{{4,}}')")
def hardcoded_numbers(s, d):
    x = doc_lines(s, d).where(F.rlike("line", F.lit("[0-9]{4,}")))
    return x.select("file", F.col("line_no").alias("line"), F.regexp_extract("line", "[0-9]{4,}", 0).alias("number"))


@query("provider_percentiles", "SELECT c_mktsegment, count(*) AS n, round(quantile_cont(c_acctbal, 0.5), 4) AS median FROM customer GROUP BY c_mktsegment")
def provider_percentiles(s, d):
    return t(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.percentile("c_acctbal", 0.5), 4).alias("median"))


# ---- review rules: events play the lines of a user's source file

CODE_LINES = [
    "for row in rows:", "    cur.execute(q)", "async def go():", "    time.sleep(3)", "", "        value = 12345", "def fetch(x):", "    try:", "        data = json.loads(x)", "seen = set()", "    seen.add(x)", "    seen.add(y)",
    "    seen.clear()", "@lru_cache", "@lru_cache(maxsize=8)", "                        if x:", '"""', "    os.system('rm {}'.format(path))", "    subprocess.run(cmd, shell=True)", "    password = 'correcthorse'", "    token = 'your_token'",
    "    url = 'https://shop.org/a'", "    cur.execute(f'SELECT {x}')", "    x.innerHTML = 'a'", "    def inner():", "        pass", "    q = 'SELECT a' + b", "    port = 8080", "    f.read()", "while True:", "    y = float(x) + float(z)", "# done", "def _hidden():",
]
CODE = rf"""cl AS (SELECT 'u' || user_id AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS line_no, ([{listed(CODE_LINES)}])[(event_id * 7919 + event_id // 13) % {len(CODE_LINES)} + 1] AS line FROM events),
lines AS (SELECT *, trim(line) AS stripped, length(line) - length(ltrim(line)) AS indent FROM cl)"""


def code_files(s, d):
    pick = F.element_at(F.array(*map(F.lit, CODE_LINES)), F.expr(f"CAST((event_id * 7919 + event_id DIV 13) % {len(CODE_LINES)} + 1 AS INT)"))
    x = t(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", pick.alias("line")))).alias("ls"))
    return x.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.array_join(F.col("ls.line"), "\n").alias("text"))


def code_lines(s, d):
    return O.source_lines(code_files(s, d), "file", "text")


def text_rules_sql() -> str:
    out = []
    for i, (kind, severity, pattern, flag) in enumerate(V.REVIEW_RULES):
        quoted = pattern.replace("'", "''")
        test = {"": "true", "variable": f"regexp_matches(line, '{V.REVIEW_VARIABLE.replace(chr(39), chr(39) * 2)}')", "unescaped": "NOT contains(lower(line), 'escaped') AND NOT contains(lower(line), 'sanitize')", "untried": "coalesce(tries, 0) = 0"}[flag]
        out.append(f"SELECT '{kind}' AS type, '{severity}' AS severity, file, line_no AS line, {i} AS rule FROM (SELECT *, unnest(regexp_extract_all(line, '{quoted}')) FROM n) WHERE {test}")
    tries = r"n AS (SELECT *, count_if(regexp_matches(line, '^\s*try\s*:')) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) AS tries FROM lines)"
    return f"WITH {CODE}, {tries} " + " UNION ALL ".join(out)


@query("review_text_rules", text_rules_sql())
def review_text_rules(s, d):
    return R.text_rules(code_files(s, d))


def scope_sql(header: str, blank: str) -> str:
    return f"""WITH {CODE}, h AS (SELECT *, regexp_matches(stripped, '{header}') AS head FROM lines), g AS (SELECT *, max(CASE WHEN head THEN line_no END) OVER (PARTITION BY file ORDER BY line_no) AS top FROM h),
k AS (SELECT g.*, count_if(NOT g.head AND g.indent <= h.indent {blank}) OVER (PARTITION BY g.file, g.top ORDER BY g.line_no) AS ended FROM g JOIN h ON h.file = g.file AND h.line_no = g.top), x AS (SELECT * FROM k WHERE ended = 0)"""


@query("review_queries_in_loops", scope_sql(r"^(for|while)\s.*:", "") + rf" SELECT 'n_plus_one' AS type, 'high' AS severity, file, line_no AS line FROM x WHERE regexp_matches(line, '{V.QUERY_CALLS}') AND NOT regexp_matches(left(line, 40), '(for|while|list comp|generator|map\()')")
def review_queries_in_loops(s, d):
    return R.queries_in_loops(code_lines(s, d))


@query("review_blocking_in_async", scope_sql("^async def ", "AND g.stripped <> ''") + " " + " UNION ALL ".join(f"SELECT 'sync_io_in_async' AS type, '{v}' AS severity, file, line_no AS line FROM x WHERE NOT head AND NOT contains(stripped, 'asyncio') AND regexp_matches(stripped, '{p}')" for p, v in V.BLOCKING_CALLS))
def review_blocking_in_async(s, d):
    return R.blocking_in_async(code_lines(s, d))


@query("review_secrets", f"""WITH {CODE}, k AS (SELECT *, lower(regexp_extract(stripped, '{V.SECRET_NAMES}')) AS key, regexp_extract(stripped, '=\\s*["''](.+?)["'']', 1) AS value FROM lines WHERE NOT regexp_matches(stripped, '^(#|//|/\\*)') AND NOT contains(stripped, 'import '))
SELECT 'secret_leak' AS type, CASE WHEN contains(key, 'password') OR contains(key, 'secret') THEN 'critical' ELSE 'high' END AS severity, file, line_no AS line FROM k WHERE key <> '' AND value <> '' AND NOT regexp_matches(value, '{V.SECRET_SKIPPED.replace("'", "''")}')""")
def review_secrets(s, d):
    return R.secrets(code_lines(s, d))


@query("review_nested_blocks", f"""WITH {CODE}, k AS (SELECT *, count_if(starts_with(stripped, '\"\"\"')) OVER (PARTITION BY file ORDER BY line_no) % 2 AS inside FROM lines)
SELECT 'deep_nesting' AS type, 'medium' AS severity, file, line_no AS line FROM k WHERE inside = 0 AND NOT starts_with(stripped, '\"\"\"') AND NOT starts_with(stripped, '#') AND indent // 4 > 4 AND regexp_matches(line, '{V.NESTING}')""")
def review_nested_blocks(s, d):
    return R.nested_blocks(code_lines(s, d))


@query("review_hardcoded", f"""WITH {CODE}, k AS (SELECT *, CAST(nullif(regexp_extract(stripped, '=\\s*(\\d{{4,}})\\s*(?:#|$|\\])', 1), '') AS BIGINT) AS n, regexp_extract(stripped, '["''](https?://[^"'']+)["'']', 1) AS url FROM lines WHERE NOT regexp_matches(stripped, '^(#|\"\"\")') AND NOT contains(stripped, 'import ')),
v AS (SELECT *, CAST(n AS VARCHAR) AS value FROM k WHERE n NOT IN (0, 1, {', '.join(V.KNOWN_NUMBERS)}) UNION ALL SELECT *, url FROM k WHERE url <> '' AND NOT regexp_matches(url, 'localhost|127[.]0[.]0[.]1|example\\.com|test|cdn\\.'))
SELECT 'hardcoded_value' AS type, 'low' AS severity, file, line_no AS line, value FROM v""")
def review_hardcoded(s, d):
    return R.hardcoded(code_lines(s, d))


@query("review_growing_collections", f"""WITH {CODE}, c AS (SELECT file, count_if(contains(line, 'seen.add(')) AS adds, count_if(contains(line, 'seen.clear(')) AS gone, min(CASE WHEN contains(line, 'seen.add(') THEN line_no END) AS line FROM lines GROUP BY file)
SELECT 'memory_leak' AS type, 'medium' AS severity, file, c.line FROM c JOIN lines l USING (file) WHERE l.line = 'seen = set()' AND adds > 3 AND gone < 2 UNION ALL SELECT 'memory_leak', 'low', file, line_no FROM lines WHERE line = '@lru_cache'""")
def review_growing_collections(s, d):
    return R.growing_collections(code_files(s, d))


@query("review_long_functions", f"""WITH {CODE}, f AS (SELECT *, regexp_extract(line, '^\\s*def\\s+(\\w+)\\s*\\(', 1) AS name FROM lines), n AS (SELECT file, max(line_no) AS n FROM lines GROUP BY file),
e AS (SELECT f.file, f.line_no, f.name, coalesce(min(l.line_no), max(n.n) + 1) AS stop FROM f JOIN n USING (file) LEFT JOIN lines l ON l.file = f.file AND l.line_no > f.line_no AND l.stripped <> '' AND l.indent <= f.indent WHERE f.name <> '' GROUP BY ALL)
SELECT 'long_function' AS type, 'low' AS severity, file, line_no AS line, name, stop - line_no AS n FROM e WHERE stop - line_no > 6 AND NOT starts_with(name, '_') AND NOT EXISTS (SELECT 1 FROM e o WHERE o.file = e.file AND o.line_no < e.line_no AND e.line_no < o.stop)""")
def review_long_functions(s, d):
    return R.long_functions(code_files(s, d), most=6)


MODULES = ["def load{}():\n    return 1\n", "from lib.a import load{} as f\nasync def go():\n    f()\n    await g.load{}()\n", "import asyncio\nasync def work():\n    pass\ndef call_sync():\n    asyncio.run(work())\n", "def broken(:\n"]


def modules(s, d):
    k = F.expr("CAST(event_id DIV 16 AS STRING)")
    return t(s, d, "events").select(F.col("event_id").cast("string").alias("file"), F.replace(F.element_at(F.array(*map(F.lit, MODULES)), (F.col("event_id") % 4 + 1).cast("int")), F.lit("{}"), k).alias("text"))


@query("boundary_findings", "SELECT unnest(['asyncio_run_in_loop', 'sync_calls_async']) AS type, 'high' AS severity, CAST(event_id AS VARCHAR) AS file, 5 AS line, 'call_sync' AS name, unnest([NULL, 'work']) AS target FROM events WHERE event_id % 4 = 2")
def boundary_findings(s, d):
    return C.boundary_findings(modules(s, d))


@query("import_chain", "SELECT 'sync_calls_async_cross_file' AS type, 'high' AS severity, CAST(b.event_id AS VARCHAR) AS file, 3 AS line, 'go' AS caller, 'f' AS name, CAST(a.event_id AS VARCHAR) AS defined_in FROM events b JOIN events a ON a.event_id // 16 = b.event_id // 16 WHERE b.event_id % 4 = 1 AND a.event_id % 4 = 0")
def import_chain(s, d):
    return C.import_chain(C.code_facts(modules(s, d)))


# ---- fixes, projects, comments and run states

SNIPPETS = [("print_used", 1, "print(1)", "import logging\nlogging.info(1)"), ("bare_except", 3, "try:\n    a()\nexcept:\n    b()", "try:\n    a()\nexcept Exception:\n    b()"), ("missing_timeout_config", 1, "x = requests.get(u)", "x = requests.get(u, timeout=30)"), ("bare_except", 1, "a = 1", "a = 1")]
TEXTS = "[" + ", ".join("'" + x[3].replace("\n", "' || chr(10) || '") + "'" for x in SNIPPETS) + "]"


@query("fix_texts", f"SELECT CAST(event_id AS VARCHAR) AS file, ({TEXTS})[event_id % 4 + 1] AS text, event_id % 4 <> 3 AS success FROM events")
def fix_texts(s, d):
    of = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in SNIPPETS)), (F.col("event_id") % 4 + 1).cast("int"))
    e = t(s, d, "events").select(F.col("event_id").cast("string").alias("file"), of(0).alias("type"), of(1).alias("line"), of(2).alias("text"), F.lit(0).alias("ord"))
    return X.fix_files(e.select("file", "text"), e.select("file", "type", "line", "ord")).select("file", "text", F.get("results", F.lit(0))["success"].alias("success"))


@query("first_success", "SELECT o_custkey, o_orderkey, tried FROM (SELECT *, row_number() OVER w AS tried, coalesce(count_if(o_totalprice > 200000) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE won = 0")
def first_success(s, d):
    x = t(s, d, "orders").withColumn("success", F.col("o_totalprice") > 200000)
    return X.first_success(x, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "tried")


@query("line_edits", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) >= 2 THEN md5(array_to_string(list_concat(list_concat(l[1:1], ['x']), l[3:]), chr(10))) ELSE md5(array_to_string(l, chr(10))) END AS digest, CAST(greatest(3 - len(l), 0) AS INTEGER) AS added, CAST(greatest(len(l) - 3, 0) AS INTEGER) AS removed FROM l")
def line_edits(s, d):
    added, removed = X.lines_changed(F.col("text"), F.lit("a\nb\nc"))
    return t(s, d, "documents").select("doc_id", F.md5(X.replace_lines(F.col("text"), 2, 2, F.lit("x"))).alias("digest"), added.alias("added"), removed.alias("removed"))


PATHS = ["src/a.py", "tests/test_a.py", "web/b.js", "web/c.ts", "node_modules/d.js", ".git/e.py", "app.py", "src/core/f.go", "README.md", "src/__pycache__/g.py", "lib/Tests/h.py", "config.yaml"]
TREE = f"p AS (SELECT 'u' || user_id AS project, ([{listed(PATHS)}])[(event_id * 7919 + event_id // 13) % {len(PATHS)} + 1] AS path, event_id FROM events)"


def tree(s, d):
    pick = F.element_at(F.array(*map(F.lit, PATHS)), F.expr(f"CAST((event_id * 7919 + event_id DIV 13) % {len(PATHS)} + 1 AS INT)"))
    return t(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project"), pick.alias("path"), F.when(F.col("event_id") % 50 == 0, "async def f(): pass").otherwise("").alias("text"))


@query("module_batches", f"WITH {TREE}, m AS (SELECT project, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) ELSE '(root)' END AS module_dir, path FROM p WHERE path LIKE '%.py' AND path NOT LIKE '.%' AND NOT contains(path, '__pycache__')) SELECT project, module_dir, string_agg(path, ',' ORDER BY path) AS files, contains(lower(module_dir), 'test') AS is_test, count(*) AS file_count FROM m GROUP BY project, module_dir")
def module_batches(s, d):
    return P.module_batches(tree(s, d), keys=["project"]).withColumn("files", F.array_join("files", ","))


@query("project_blueprint", f"""WITH {TREE}, k AS (SELECT *, CASE WHEN path LIKE 'node_modules/%' OR path LIKE '.%' OR contains(path, '__pycache__') THEN NULL WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' END AS lang FROM p),
c AS (SELECT project, lang, count(*) AS n FROM k WHERE lang IS NOT NULL GROUP BY project, lang), b AS (SELECT project, arg_min(lang, (-n, lang)) AS lang FROM c GROUP BY project)
SELECT k.project, coalesce(any_value(b.lang), 'unknown') AS "primary", count(k.lang) AS total_files, CASE WHEN any_value(b.lang) = 'python' THEN concat_ws(',', CASE WHEN count_if(path = 'app.py') > 0 THEN 'fastapi' END, CASE WHEN count_if(path LIKE '%.py' AND event_id % 50 = 0) > 0 THEN 'asyncio' END) ELSE '' END AS frameworks,
  coalesce(any_value(b.lang) IN ('python', 'javascript') AND count_if(path LIKE 'tests/%') > 0, false) AS has_tests FROM k LEFT JOIN b ON b.project = k.project GROUP BY k.project""")
def project_blueprint(s, d):
    return P.blueprint(tree(s, d)).select("project", "primary", "total_files", F.array_join("frameworks", ",").alias("frameworks"), "has_tests")


@query("review_comments", f"""WITH {FIND}, e AS (SELECT file, type, severity, ord, '- **L' || line || '** [' || severity || ']: d' || chr(10) || '  - 💡 s' AS entry FROM f),
b AS (SELECT file, min(ord) AS ord, bool_or(severity IN ('critical', 'high')) AS grave, '### ' || arg_min(CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' ELSE '⚪' END, ord) || ' ' || type || chr(10) || chr(10) || string_agg(entry, chr(10) ORDER BY ord) || chr(10) AS block FROM e GROUP BY file, type)
SELECT file, md5('## Code review report' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY ord) || CASE WHEN bool_or(grave) THEN '' ELSE chr(10) || '---' || chr(10) || '> ⚠️ 未发现严重问题，建议修复以上 low/medium 问题后合并。' END) AS digest FROM b GROUP BY file""")
def review_comments(s, d):
    x = finds(s, d).select("file", "type", "severity", "line", "ord", F.lit("d").alias("description"), F.lit("s").alias("suggestion"), F.lit(None).cast("string").alias("code"))
    return P.review_comment(x, ["file"]).select("file", F.md5("comment").alias("digest"))


@query("run_states", "WITH l AS (SELECT conv_id, turn, length(text) AS n, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations) SELECT conv_id AS run_id, CASE WHEN top = 0 THEN 'running' ELSE max(CASE WHEN turn = top THEN CASE WHEN n % 2 = 0 THEN 'succeeded' ELSE 'failed' END END) END AS state, CASE WHEN top > 0 THEN CAST(top AS DOUBLE) END AS duration_seconds, greatest(top - 1, 0) AS n_phases FROM l GROUP BY conv_id, top")
def run_states(s, d):
    x = t(s, d, "conversations").withColumn("top", F.max("turn").over(Window.partitionBy("conv_id")))
    event = F.when(F.col("turn") == 0, "start").when(F.col("turn") < F.col("top"), "phase").when(F.length("text") % 2 == 0, "succeed").otherwise("fail")
    e = x.select(F.col("conv_id").alias("run_id"), event.alias("event"), F.timestamp_seconds("turn").alias("at"), F.col("turn").alias("ord"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("phase"), F.lit(1.0).alias("seconds"), F.lit("e").alias("error"))
    return P.run_states(e).select("run_id", "state", "duration_seconds", F.size("phase_timings").cast("long").alias("n_phases"))
