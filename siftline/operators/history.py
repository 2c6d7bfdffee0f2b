"""Experience, calibration, strategy ranking, trends, gates, logs, costs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def calibrate(history: DataFrame, keys: list[str], success: str, least: int = 3) -> DataFrame:
    """Success rate of each key with ``least`` records or more, held between 0.1 and 0.99, 3 places."""
    x = history.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg(F.col(success).cast("int")).alias("rate")).where(F.col("samples") >= least)
    return x.select(*keys, "samples", F.bround(F.greatest(F.lit(0.1), F.least(F.lit(0.99), F.col("rate"))), 3).alias("calibrated"))


def calibrated(df: DataFrame, table: DataFrame, keys: list[str], original: str, least: int = 3) -> DataFrame:
    """``original`` confidence, replaced where the table has enough samples."""
    x = df.join(table.where(F.col("samples") >= least).select(*keys, "calibrated"), keys, "left")
    return x.withColumn("confidence", F.coalesce("calibrated", original)).drop("calibrated")


def pattern_stats(history: DataFrame, keys: list[str], success: str, confidence: str, at: str) -> DataFrame:
    return history.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col(success)).alias("successes"), F.count_if(~F.col(success)).alias("failures"),
        F.bround(F.avg(confidence), 6).alias("mean_confidence"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"),
    )


def tail(df: DataFrame, n: int, order: list, keys: list[str] = ()) -> DataFrame:
    """The last ``n`` rows (of each key)."""
    back = [F.desc(c) if isinstance(c, str) else c for c in order]
    x = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*back))) if keys else df.orderBy(*back).limit(n).withColumn("_n", F.lit(1))
    return x.where(F.col("_n") <= n).drop("_n")


def running_sum(df: DataFrame, keys: list[str], value: str, ord: str, width: int = 4096) -> DataFrame:
    """Rows with ``total``, the sum of the values up to each, and ``samples``, their number; sums of ranges of ``ord`` come first, so that no key is one task's work alone."""
    x = df.withColumn("_b", F.floor(F.col(ord) / width))
    heads = x.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(heads.schema["_s"].dataType)
    heads = heads.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), zero).alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    upto = Window.partitionBy(*keys, "_b").orderBy(ord).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(heads, [*keys, "_b"])
    return x.withColumns({"total": F.coalesce(F.sum(value).over(upto), zero) + F.col("_s"), "samples": F.count(value).over(upto) + F.col("_n")}).drop("_b", "_s", "_n")


def running_mean(df: DataFrame, keys: list[str], value: str, ord: str, width: int = 4096) -> DataFrame:
    """Rows with the mean of the values up to each and their number, see ``running_sum``."""
    x = running_sum(df, keys, value, ord, width)
    return x.withColumn("mean", F.col("total") / F.nullif(F.col("samples"), F.lit(0))).drop("total").select(*df.columns, "mean", "samples")


def best_strategy(candidates: DataFrame, stats: DataFrame, key: str, fixer: str) -> DataFrame:
    """Candidates of each key in order: those with a record by rate, then the others as registered; place from 1."""
    x = candidates.join(stats.select(key, fixer, "rate"), [key, fixer], "left").withColumn("rate", F.coalesce("rate", F.lit(-1.0)))
    order = Window.partitionBy(key).orderBy(F.desc(F.col("rate") >= 0), F.desc("rate"), "reg")
    return x.withColumn("place", F.row_number().over(order))


def suggestions(history: DataFrame, keys: list[str], success: str, ord: str, least: int = 3) -> DataFrame:
    """Keys with ``least`` successes or more: their successes so far, and of the record that brought the ``least``-th its order and the success rate up to it, which stays."""
    x = running_sum(history.withColumn("_ok", F.col(success).cast("int")), keys, "_ok", ord)
    first = F.min(F.when(F.col("total") == least, F.struct(F.col(ord).alias("at"), (F.col("total") / F.col("samples")).alias("rate"))))
    x = x.groupBy(*keys).agg(F.max("total").alias("successes"), first.alias("_f")).where(F.col("successes") >= least)
    return x.select(*keys, "successes", F.col("_f.at").alias("suggested_at"), F.bround("_f.rate", 6).alias("success_rate"))


def mode(df: DataFrame, keys: list[str], value: str, ord: str) -> DataFrame:
    """The most frequent value of each key, of equals the first seen."""
    x = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(ord).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "first")


def relevance(success: Column, folder: Column, here: Column, suffix: Column, ending: Column) -> Column:
    return F.when(success, 1.0).otherwise(0.5) + F.when(folder == here, 0.5).otherwise(0.0) + F.when(suffix == ending, 0.3).otherwise(0.0)


def converged(scores: DataFrame, keys: list[str], order: str, score: str, window: int = 3, most: float = 3) -> DataFrame:
    """Rows with the change from the one before and whether the last ``window`` differ by ``most`` at most."""
    by = Window.partitionBy(*keys).orderBy(order)
    near = by.rowsBetween(1 - window, 0)
    full = F.count(score).over(near) == window
    return scores.withColumn("delta", F.col(score) - F.lag(score).over(by)).withColumn("converged", full & (F.max(score).over(near) - F.min(score).over(near) <= most))


def trend(rounds: DataFrame, keys: list[str], order: list, success: str, n: int = 5) -> DataFrame:
    """Success rate of the last ``n`` rows and of the ``n`` before, and whether it has not fallen."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    x = rounds.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * n)
    ok = F.col(success).cast("int")
    x = x.groupBy(*keys).agg(F.avg(F.when(F.col("_r") <= n, ok)).alias("recent"), F.avg(F.when(F.col("_r") > n, ok)).alias("earlier"))
    return x.withColumn("improving", F.col("recent") >= F.col("earlier"))


def query_logs(logs: DataFrame, request=None, status=None, task=None, level=None, dates=None, limit: int | None = None) -> DataFrame:
    """Log rows that meet all given terms, by time as text; the last ``limit``."""
    x = logs
    for name, value in (("request_id", request), ("status", status)):
        x = x.where(F.col(name) == value) if value is not None else x
    x = x.where(F.contains("task_id", F.lit(task))) if task is not None else x
    norm = lambda c: F.when(F.upper(c) == "WARNING", "WARN").otherwise(F.upper(c))
    x = x.where(norm(F.col("level")) == norm(F.lit(level))) if level is not None else x
    x = x.where(F.col("date").isin(dates)) if dates is not None else x
    return x.orderBy(F.desc("timestamp"), F.desc("ord")).limit(limit).orderBy("timestamp", "ord") if limit else x.orderBy("timestamp", "ord")


def zero_filled(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts of the listed values, absent ones 0."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return dim.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rate(done: Column, failed: Column, places: int = 4) -> Column:
    """done / (done + failed); null without either."""
    return F.bround(F.try_divide(done.cast("double"), done + failed), places)


def approvals(events: DataFrame) -> DataFrame:
    """State of each approval item from its events (id, op, at, ord), in one fold.

    ``queue`` opens an item; approve and reject act on pending ones, reply on
    pending and replied ones, expire likewise; other moves are ignored.
    """
    ops = F.array_sort(F.collect_list(F.struct("at", "ord", "op")))
    live = lambda s: s.isin("pending", "replied")

    def move(s, e):
        op = e["op"]
        return (
            F.when(s.isNull() & (op == "queue"), "pending").when((s == "pending") & (op == "approve"), "approved").when((s == "pending") & (op == "reject"), "rejected")
            .when(live(s) & (op == "reply"), "replied").when(live(s) & (op == "expire"), "expired").otherwise(s)
        )

    return events.groupBy("id").agg(F.aggregate(ops, F.lit(None).cast("string"), move).alias("status"), F.count("*").alias("n_events"))


def suppressed(feedback: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Keys marked ``least`` times or more since they were last unmarked."""
    w = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    x = feedback.withColumn("_u", F.max((F.col("op") == "unmark").cast("int")).over(w)).where("_u = 0")
    return x.groupBy(*keys).agg(F.count("*").alias("marks")).where(F.col("marks") >= least)


def capped(ops: DataFrame, keys: list[str], order: list, caps: dict) -> DataFrame:
    """Whether each operation still lies within its cap for its keys."""
    n = F.row_number().over(Window.partitionBy(*keys, "op").orderBy(*order))
    return ops.withColumn("place", n).withColumn("allowed", F.col("place") <= S.lookup(caps, F.col("op"), F.lit(1 << 30)))


#: Queries and rows that meet at a time.
QUERY_BLOCK, ROW_BLOCK = 512, 4096


def top_inner_products(vectors: DataFrame, queries: DataFrame, id: str, vector: str, k: int = 3, least: float = 0.3) -> DataFrame:
    """(vec_id, neighbour, score): for each query the ``k`` rows of largest inner product, of these those of ``least`` or more.

    Every block of queries meets every block of rows of its dimension.  Vectors
    that are null or hold nulls take no part.  Ties go to the smaller id.
    """
    usable = lambda x: x.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND NOT exists(v, e -> e IS NULL)").withColumn("d", F.size("v"))
    rows, asked = usable(vectors), usable(queries)
    n_rows, n_asked = -(-rows.count() // ROW_BLOCK) or 1, -(-asked.count() // QUERY_BLOCK) or 1
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_asked)).cast("int")).withColumn("rb", span(n_rows))
    right = rows.withColumn("rb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_rows)).cast("int")).withColumn("qb", span(n_asked))
    schema = pa.schema([("vec_id", pa.int64()), ("neighbour", pa.int64()), ("score", pa.float64())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        b = b.sort_by("id")
        q, x = (np.array(t.column("v").combine_chunks().flatten()).reshape(len(t), -1) for t in (a, b))
        score = np.zeros((len(q), len(x)))
        for j in range(q.shape[1]):  # in the order of the elements, so that equal vectors score alike
            score += q[:, j, None] * x[None, :, j]
        best = np.argsort(-score, 1, kind="stable")[:, :k]
        ids = a.column("id").to_numpy(), b.column("id").to_numpy()
        return pa.table([np.repeat(ids[0], best.shape[1]), ids[1][best.ravel()], np.take_along_axis(score, best, 1).ravel()], schema=schema)

    found = left.groupBy("d", "qb", "rb").cogroup(right.groupBy("d", "qb", "rb")).applyInArrow(meet, "vec_id long, neighbour long, score double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("place", place).where((F.col("place") <= k) & (F.col("score") >= least)).drop("place")
