"""Queue pressure and approval items as event logs, closed form; `streaming.stateful` has the same on streams."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of the ranges of time that a key's events are first summed up by.
RANGE = 86_400_000_000
#: An order number behind all others of its instant.
LAST = (1 << 63) - 1


def carried(df: DataFrame, keys: list[str], at: str, ord: str, value: Column, name: str, width: int = RANGE) -> DataFrame:
    """``df`` with the largest ``value`` of the rows of its keys before each, by (at, ord).

    The maxima of ranges of time come first, so that a key's rows are spread
    over as many groups as it has ranges.
    """
    x = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(at) / width))
    heads = x.groupBy(*keys, "_b").agg(F.max("_v").alias("_v"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*keys, "_b", F.max("_v").over(earlier).alias("_h"))
    inside = Window.partitionBy(*keys, "_b").orderBy(at, ord, "_v").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_v", F.max("_v").over(inside)).join(heads, [*keys, "_b"])
    return x.withColumn(name, F.coalesce("_v", "_h")).drop("_v", "_h", "_b")


def pressure_fires(events: DataFrame, key: str, at: str, ord: str, breach: Column, wait: int, until: int) -> DataFrame:
    """(key, began, step, fired): each time that a threshold has been held for another ``wait``, in microseconds.

    A run begins with a breach and ends with the first row that is none; a null
    breach is none. It fires at began + wait, began + 2 wait and so on, before its end and
    no later than ``until``, whether or not an event comes at that time.  Rows
    are in order by (at, ord), ``at`` in microseconds; rows without key or time play no part.
    """
    x = events.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.col(ord).cast("long").alias("ord"), F.coalesce(breach, F.lit(False)).alias("breach")).where("key IS NOT NULL AND at IS NOT NULL")
    # a run and the row that ends it follow the same last row without breach
    x = carried(x, ["key"], "at", "ord", F.when(~F.col("breach"), F.struct("at", "ord")), "after")
    runs = x.groupBy("key", "after").agg(F.min(F.when(F.col("breach"), F.col("at"))).alias("began"), F.max(F.when(~F.col("breach"), F.struct("at", "ord"))).alias("ended")).where("began IS NOT NULL")
    # repeated rows without breach follow themselves, and end nothing
    ended = F.when(F.col("after").isNull() | (F.col("ended") > F.col("after")), F.col("ended.at"))
    last = F.least(F.coalesce(ended - 1, F.lit(until)), F.lit(until))
    steps = F.floor((last - F.col("began")) / wait)
    fires = runs.where(steps >= 1).select("key", "began", F.explode(F.sequence(F.lit(1).cast("long"), steps)).alias("step"))
    return fires.select(F.col("key").alias(key), "began", "step", (F.col("began") + F.col("step") * wait).alias("fired"))


#: What may act on a pending item, and the state that each makes.
MOVES = {"approve": "approved", "reject": "rejected", "reply": "replied", "expire": "expired"}


def approval_moves(events: DataFrame, ttl: int, until: int) -> DataFrame:
    """(id, at, ord, op, before, after): the moves that the events of each item (id, at, ord, op) make.

    The first ``queue`` opens an item as pending.  Approve and reject act on
    pending items, reply and expire on pending and replied ones; all else does nothing.
    ``ttl`` microseconds after it was queued an item still open expires, behind
    all events of that instant, if that is no later than ``until``.  Of an item
    only the least events of some kinds matter, so it may have any number: nothing is
    collected or sorted by item.  Rows without id, time or op play no part.
    """
    e = events.select("id", F.col("at").cast("long").alias("at"), F.col("ord").cast("long").alias("ord"), "op").where("id IS NOT NULL AND at IS NOT NULL AND op IS NOT NULL")
    here = F.struct("at", "ord", "op")
    opened = e.where("op = 'queue'").groupBy("id").agg(F.min(here).alias("opened"))
    after = e.where(F.col("op").isin(*MOVES)).join(opened, "id").where(here > F.col("opened")).select("id", "at", "ord", "op")
    stale = F.col("opened.at") + ttl
    acts = after.union(opened.where(stale <= until).select("id", stale, F.lit(LAST), F.lit("expire")))
    first = acts.groupBy("id").agg(F.min(here).alias("first"))
    acts = acts.join(first, "id")
    later = acts.where((F.col("first.op") == "reply") & (here > F.col("first")) & F.col("op").isin("reply", "expire"))
    ends = later.where("op = 'expire'").groupBy("id").agg(F.min(here).alias("end"))
    later = later.join(ends, "id", "left").where(F.col("end").isNull() | (here <= F.col("end"))).select("id", "at", "ord", "op", F.lit("replied").alias("before"))
    begun = opened.select("id", "opened.*", F.lit(None).cast("string").alias("before"))
    moves = begun.union(first.select("id", "first.*", F.lit("pending").alias("before"))).union(later)
    state = F.element_at(F.create_map(*(F.lit(x) for kv in {"queue": "pending", **MOVES}.items() for x in kv)), F.col("op"))
    return moves.withColumn("after", state)
