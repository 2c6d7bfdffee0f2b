"""State over time, sinks and tables that are kept up, bound to the driver's tables, each with its SQL."""

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import history as H
from ..operators import pressure as P
from ..operators import upkeep as U
from ..operators import variants as J
from ..sources import sqlite_rows
from ..sources.folders import work_folder
from ..streaming import sinks
from .bindings import query, t

HOUR = 3_600_000_000

# ---- pressure held, and approvals that run out; events are in microseconds


def last_event(events) -> int:
    return events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0


@query("pressure_fires", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS tm, coalesce(value >= 10, false) AS breach FROM events),
i AS (SELECT *, coalesce(sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM e),
r AS (SELECT user_id, island, min(tm) FILTER (breach) AS began, min(tm) FILTER (NOT breach) AS ended FROM i GROUP BY user_id, island),
n AS (SELECT user_id, began, (least(coalesce(ended - 1, (SELECT max(tm) FROM e)), (SELECT max(tm) FROM e)) - began) // 7200000000 AS n FROM r WHERE began IS NOT NULL)
SELECT user_id, began, step, began + step * 7200000000 AS fired FROM (SELECT user_id, began, unnest(range(1, n + 1)) AS step FROM n WHERE n >= 1)""")
def pressure_fires(s, d):
    e = t(s, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return P.pressure_fires(e, "user_id", "at", "event_id", F.col("value") >= 10, 2 * HOUR, last_event(e))


def approval_events(s, d):
    """Eight events in turn are those of one item; their types are what is done to it."""
    op = F.element_at(F.create_map(*map(F.lit, ["signup", "queue", "purchase", "approve", "error", "reject", "click", "reply", "view", "look"])), F.col("event_type"))
    return t(s, d, "events").select(F.expr("event_id DIV 8").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("ord"), op.alias("op"))


APPROVAL_MOVES = """e AS (SELECT event_id // 8 AS id, epoch_us(ts) AS tm, event_id AS ord, CASE event_type WHEN 'signup' THEN 'queue' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'reply' ELSE 'look' END AS op FROM events),
o AS (SELECT id, arg_min(tm, ord) AS tm, min(ord) AS ord FROM e WHERE op = 'queue' GROUP BY id),
a AS (SELECT e.id, e.tm, e.ord, e.op FROM e JOIN o ON e.id = o.id WHERE e.op IN ('approve', 'reject', 'reply') AND e.ord > o.ord AND e.tm <= o.tm + 1800000000
  UNION ALL SELECT id, tm + 1800000000, 9223372036854775807, 'expire' FROM o WHERE tm + 1800000000 <= (SELECT max(tm) FROM e)),
n AS (SELECT *, row_number() OVER w AS k, first_value(op) OVER w AS lead FROM a WINDOW w AS (PARTITION BY id ORDER BY tm, ord)),
m AS (SELECT id, tm, ord, 'queue' AS op, NULL AS before FROM o UNION ALL SELECT id, tm, ord, op, 'pending' FROM n WHERE k = 1
  UNION ALL SELECT id, tm, ord, op, 'replied' FROM n WHERE k > 1 AND lead = 'reply' AND op IN ('reply', 'expire'))
"""
APPROVAL_STATES = "CASE op WHEN 'queue' THEN 'pending' WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'reply' THEN 'replied' ELSE 'expired' END"


@query("approval_moves", f"""WITH {APPROVAL_MOVES} SELECT id, tm AS "at", ord, op, before, {APPROVAL_STATES} AS after FROM m""")
def approval_moves(s, d):
    return P.approval_moves(approval_events(s, d), HOUR // 2, last_event(t(s, d, "events")))


# ---- sinks: each epoch once, states as a whole, rows of a SQLite file

@query("approval_callbacks", f"""WITH {APPROVAL_MOVES} SELECT id, tm AS "at", callback FROM m, (VALUES ('apply_fix'), ('notify')) AS c(callback) WHERE op = 'approve'""")
def approval_callbacks(s, d):
    """Callback rows of all approvals, written in four epochs of which each is run twice, as a restarted stream would."""
    table = sinks.EpochTable(s, work_folder(s, "callbacks"))
    moves = approval_moves(s, d)
    for epoch in range(4):
        rows = sinks.approval_callbacks(moves.where(F.col("id") % 4 == epoch), ["apply_fix", "notify"])
        for _ in range(2):
            table.write(rows, epoch)
    return table.read().select("id", "at", "callback")


@query("replaced_state", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last_id FROM events GROUP BY event_type")
def replaced_state(s, d):
    """A JSON state of each event type, three times made from the one before and a third of the events."""
    state = sinks.State(s, work_folder(s, "state"), "json")
    schema = "event_type string, n long, total double, last_id long"
    for k in range(3):
        new = t(s, d, "events").where(F.col("event_id") % 3 == k).select("event_type", F.lit(1).cast("long").alias("n"), F.col("value").alias("total"), F.col("event_id").alias("last_id"))
        state.replace(state.current(schema).union(new).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_id").alias("last_id")))
    return state.current(schema).select("event_type", "n", F.round("total", 4).alias("total"), "last_id")


@query("blocked_audit", """SELECT event_id, event_type AS operation, 'u' || user_id AS target, 'blocked' AS outcome, left(sha256(props), 16) AS content_hash FROM events WHERE event_type IN ('error', 'signup')""")
def blocked_audit(s, d):
    """Audit rows of blocked operations, JSON lines in epochs; a run that broke off before its move is never read."""
    path = work_folder(s, "audit")
    audit = sinks.EpochTable(s, path, "json")
    e = t(s, d, "events").where("event_type IN ('error', 'signup')")
    rows = e.select("event_id", F.col("event_type").alias("operation"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("target"), F.lit("blocked").alias("outcome"), F.left(F.sha2("props", 256), F.lit(16)).alias("content_hash"))
    rows.write.json(f"{path}/{sinks.STAGING}/lost")
    for epoch in range(2):
        audit.write(rows.where(F.col("event_id") % 2 == epoch), epoch)
    audit.write(rows, 1)
    return audit.read("event_id long, operation string, target string, outcome string, content_hash string").drop("epoch")


@query("sqlite_costs", """SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS provider, count(*) AS n, round(sum(o_totalprice), 2) AS cost FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice >= 1000 GROUP BY 1, 2""")
def sqlite_costs(s, d):
    """Orders as cost records, appended to a SQLite file in two jobs; provider and cost are filtered in the file."""
    sqlite_rows.register(s)
    path = f"{work_folder(s, 'costs')}.db"
    rows = t(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("provider"), F.col("o_totalprice").alias("cost"), F.col("o_orderkey").cast("string").alias("task_id"))
    for part in (rows.where("cost < 50000"), rows.where("cost >= 50000 OR cost IS NULL")):
        part.write.format("sqlite_rows").option("path", path).option("table", "cost_records").mode("append").save()
    x = s.read.format("sqlite_rows").option("path", path).option("table", "cost_records").load()
    x = x.where(F.col("provider").isin("1-URGENT", "5-LOW") & (F.col("cost") >= 1000))
    return x.groupBy(F.substring("date", 1, 7).alias("month"), "provider").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("cost"))


# ---- logs, files and vectors kept up

NOW = 1_704_067_200 + 20 * 86_400  # twenty days into the events
FILES = "SELECT 'logs/' || event_type || '/' || event_id || '.log' AS path, 1704067200 + (event_id * 7919 % 2592000) AS mtime, CAST(value * 1000 AS BIGINT) AS size FROM events WHERE value IS NOT NULL"


def log_files(s, d):
    """Files as a listing has them, one an event."""
    path = F.concat(F.lit("logs/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".log"))
    return t(s, d, "events").where("value IS NOT NULL").select(path.alias("path"), (1_704_067_200 + F.col("event_id") * 7919 % 2_592_000).alias("mtime"), F.round(F.col("value") * 1000).cast("long").alias("size"))


@query("dropped_logs", f"""WITH f AS ({FILES}), o AS (SELECT *, sum(size) OVER (ORDER BY mtime, path ROWS UNBOUNDED PRECEDING) AS upto FROM f WHERE mtime < {NOW - 7 * 86400})
SELECT path, mtime, size, CAST(1000000 + upto AS BIGINT) AS free_after FROM o WHERE 1000000 + upto - size < 6000000""")
def dropped_logs(s, d):
    return U.droppable(log_files(s, d), 1_000_000, NOW, need=6_000_000, all_old=False)


@query("newest_logs", f"WITH f AS ({FILES}) SELECT (SELECT path FROM f ORDER BY mtime DESC, path DESC LIMIT 1) AS newest, max(mtime) AS mtime, min(path) FILTER (mtime >= {NOW - 7 * 86400}) AS first_recent FROM f")
def newest_logs(s, d):
    return U.newest(log_files(s, d), NOW)


LINE = """'{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}'"""


@query("sized_log", f"""WITH l AS (SELECT event_id, event_id % 3 AS run, {LINE} AS line FROM events),
s AS (SELECT *, length(line) + 1 AS bytes, sum(length(line) + 1) OVER (ORDER BY run, event_id ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS start FROM l),
g AS (SELECT *, CAST(start AS BIGINT) // 20000 AS segment FROM s)
SELECT segment, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(min(start) AS BIGINT) AS start, arg_min(line, start) AS first FROM g WHERE segment >= (SELECT max(segment) FROM g) - 3 GROUP BY segment""")
def sized_log(s, d):
    """Three runs append to a log of segments of 20,000 bytes; the newest four are held."""
    log = U.SizedLog(s, work_folder(s, "log"), 20_000, 3)
    x = t(s, d, "events").withColumn("line", F.to_json(F.struct("event_id", "user_id", "event_type")))
    for run in range(3):
        log.append(x.where(F.col("event_id") % 3 == run), "line", ["event_id"], F.floor(F.col("event_id") / 50_000))
    return log.read().groupBy("segment").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("start").alias("start"), F.min_by("line", "start").alias("first"))


@query("index_upkeep", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings WHERE vec_id % 11 <> 0 OR vec_id % 10 = 0),
q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 50 = 1),
p AS (SELECT q.vec_id, v.vec_id AS neighbour, list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])), lambda a, b: a + b) AS score FROM q, v)
SELECT vec_id, neighbour, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS place FROM p) WHERE place <= 3 AND score >= 0.3""")
def index_upkeep(s, d):
    """Two appends, a removal, vectors put in anew, a compaction and one more append; then a search of what is left."""
    index = U.VectorIndex(s, work_folder(s, "index"))
    rows = t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    turned = rows.withColumn("v", F.transform("v", lambda x: -x))
    index.append(rows.where("id % 3 <> 0"))
    index.append(rows.where("id % 3 = 0"))
    index.append(turned.where("id % 5 = 0 AND id % 2 = 1"))
    index.remove(rows.where("id % 11 = 0"))
    index.compact()
    index.append(turned.where("id % 10 = 0"))
    queries = rows.where("id % 50 = 1")
    live = index.live().withColumnRenamed("id", "vec_id")
    return H.top_inner_products(live, queries.withColumnRenamed("id", "vec_id"), "vec_id", "v").withColumn("score", F.round("score", 6))


# ---- graphs in one recursive query

GRAPH = """n AS (SELECT c_custkey AS node, c_acctbal < -900 AS fails FROM customer), x AS (SELECT node // 2 AS src, node AS dst FROM n WHERE node > 0 UNION SELECT node // 3 + 1, node FROM n WHERE node > 3 UNION SELECT node, node + 1000000 FROM n),
e AS (SELECT DISTINCT src, dst FROM x JOIN n a ON a.node = src JOIN n b ON b.node = dst),
w(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON w.node = e.src),
b(node) AS (SELECT e.dst FROM n JOIN e ON n.node = e.src WHERE fails UNION SELECT e.dst FROM b JOIN e ON b.node = e.src)"""


def task_graph(s, d):
    """Customers as tasks that depend on one of half their number and one of a third."""
    n = t(s, d, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") < -900).alias("fails"))
    k = F.col("node")
    e = [n.where("node > 0").select(F.expr("node DIV 2").alias("src"), k.alias("dst")), n.where("node > 3").select((F.expr("node DIV 3") + 1).alias("src"), k.alias("dst")), n.select(k.alias("src"), (k + 1_000_000).alias("dst"))]
    return n, e[0].union(e[1]).union(e[2])


@query("graph_levels", f"WITH RECURSIVE {GRAPH} SELECT node, max(level) AS level FROM w GROUP BY node")
def graph_levels(s, d):
    return G.levels(*task_graph(s, d))


@query("graph_run", f"""WITH RECURSIVE {GRAPH} SELECT n.node, CASE WHEN b.node IS NULL THEN l.level END AS wave, CASE WHEN b.node IS NOT NULL THEN 'blocked' WHEN fails THEN 'failed' ELSE 'success' END AS status
FROM n JOIN (SELECT node, max(level) AS level FROM w GROUP BY node) l ON l.node = n.node LEFT JOIN b ON b.node = n.node""")
def graph_run(s, d):
    return G.run_graph(*task_graph(s, d))


# ---- JSON of unknown shape

def edit_text(column, text, number):
    """A model's answer on an event, in one of seven shapes; ``column``, ``text`` and ``number`` say it in Spark's or DuckDB's words."""
    item = [text('{"replacement":"r'), column("event_id"), text('","line_range":['), column("user_id"), text(","), number("user_id + event_id % 9"), text('],"confidence":')]
    return [
        [text(' {"candidates":['), *item, column("value"), text('},{"replacement":"x NaN \\" y"},7]} ')],
        [text("["), *item, column("value"), text(',"explanation":["a",{"b":null}]}, {"line_range":[1],"replacement":["l"]}]')],
        [text('{"candidates":['), *item, text('NaN,"explanation":"-Infinity N"}]}')],
        [text('{"candidates":{'), column("event_id"), text(":1}}")],
        [text('{"candidates":['), *item],
        [text('"candidates"')],
        [text('{"candidates":[{"line_range":"none","replacement":'), column("user_id"), text(',"confidence":"high","explanation":"2024-01-0'), number("1 + event_id % 9"), text('"}]}')],
    ]


def edit_texts():
    words = lambda parts: F.concat(*parts)
    return words, edit_text(lambda c: F.col(c).cast("string"), F.lit, lambda e: F.expr(e).cast("string"))


EDIT_SQL = " ".join(f"WHEN {i} THEN " + " || ".join(parts) for i, parts in enumerate(edit_text(lambda c: f"CAST({c} AS VARCHAR)", lambda x: "'" + x + "'", lambda e: f"CAST({e} AS VARCHAR)")))


@query("candidate_edits", f"""WITH e AS (SELECT event_id, CASE event_id % 7 {EDIT_SQL} END AS txt FROM events WHERE value IS NOT NULL),
p AS (SELECT event_id, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM (SELECT event_id, replace(replace(txt, ':NaN,', ':null,'), ':-Infinity,', ':null,') AS j FROM e)),
a AS (SELECT event_id, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN CASE WHEN json_type(j, '$.candidates') = 'ARRAY' THEN json_extract(j, '$.candidates') END END AS items FROM p),
i AS (SELECT event_id, unnest(from_json(items, '["JSON"]')) AS item, generate_subscripts(from_json(items, '["JSON"]'), 1) AS k FROM a WHERE items IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k) - 1 AS n FROM i WHERE json_type(item) = 'OBJECT' AND json_exists(item, '$.replacement') AND json_exists(item, '$.line_range'))
SELECT event_id, CAST(n AS INTEGER) AS n, TRY_CAST(item->>'$.line_range[0]' AS INTEGER) AS first, TRY_CAST(item->>'$.line_range[1]' AS INTEGER) AS last, item->>'$.replacement' AS replacement,
  coalesce(TRY_CAST(item->>'$.confidence' AS DOUBLE), 0.5) AS confidence, item->>'$.explanation' AS explanation FROM c""")
def candidate_edits(s, d):
    words, shapes = edit_texts()
    k = F.col("event_id") % 7
    text = F.coalesce(*(F.when(k == i, words(parts)) for i, parts in enumerate(shapes)))
    return J.candidates(t(s, d, "events").where("value IS NOT NULL").select("event_id", text.alias("text")), "text").drop("text")


@query("json_safe_rows", """SELECT event_id, '{"id":' || event_id || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","value":' || CASE WHEN event_id % 5 = 0 OR value IS NULL THEN 'null' ELSE CAST(value AS VARCHAR) END
  || ',"nest":[{"raw":"' || to_base64(encode(event_type)) || '","by":{"' || user_id || '":' || CASE WHEN event_id % 5 = 0 OR value IS NULL THEN 'null' ELSE CAST(value AS VARCHAR) END || '}}],"none":null}' AS json FROM events""")
def json_safe_rows(s, d):
    odd = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    nest = F.array(F.struct(F.col("event_type").cast("binary").alias("raw"), F.create_map(F.col("user_id"), odd).alias("by")))
    x = t(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), odd.alias("value"), nest.alias("nest"), F.lit(None).cast("date").alias("none"))
    return x.select(F.col("id").alias("event_id"), J.json_safe(x).alias("json"))
