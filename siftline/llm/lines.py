"""Line dedup: repeated windows of consecutive lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """Remove later occurrences of runs of ``window`` lines.

    Lines are parted by newlines and compared as they are.  Every window of
    ``window`` consecutive lines of a document is hashed (128 bits); of equal
    windows the first, by id (null last), then text, then position, stands and
    the later ones go: a line covered by any later occurrence is removed.  A
    removed line has a copy earlier in the order, so no content is lost.

    Adds n_lines, n_removed and kept (the text that is left, null for a null
    text) to the columns of ``docs``, replacing columns so named.  Documents
    of fewer lines than a window stay whole.  Repeated rows, alike in id and
    text, count as one document and get one result.  Only hashes and positions
    are shuffled by window; hot windows are pre-aggregated and rejoined.
    """
    kept = [c for c in docs.columns if c.lower() not in {"n_lines", "n_removed", "kept"}]
    lines, h, starts = fresh(docs, "l_lines", "l_hash", "l_starts")
    x = docs.select(*(col(c) for c in kept), F.xxhash64(col(text)).alias(h))
    t = docs.select(col(id).alias("id"), F.xxhash64(col(text)).alias("h"), F.split(col(text), "\n", -1).alias("lines"))
    t = t.where(F.size("lines") >= window)

    def pair(i):
        part = F.slice(F.col("lines"), i + 1, window)
        return F.struct(F.xxhash64(part).alias("a"), F.xxhash64(F.lit(7), part).alias("b"))

    w = t.select("id", "h", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - window), pair)).alias("at", "key"))
    w = w.select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), F.struct(F.col("id").isNull().alias("none"), "id", "h", "at").alias("place"))
    first = w.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("a", "b", "first")
    later = w.join(first, ["a", "b"]).where("place <> first").select("place.id", "place.h", "place.at")
    gone = later.groupBy("id", "h").agg(F.collect_set("at").alias(starts))
    gone = gone.select(F.coalesce(F.col("id"), F.lit(0).cast(dict(docs.dtypes)[id])).alias("l_id"), F.col("id").isNull().alias("l_none"), F.col("h").alias("l_h"), starts)
    on = (F.coalesce(col(id), F.lit(0).cast(dict(docs.dtypes)[id])) == F.col("l_id")) & (col(id).isNull() == F.col("l_none")) & (F.col(h) == F.col("l_h"))
    x = x.join(gone, on, "left").withColumn(lines, F.split(col(text), "\n", -1))
    covered = F.array_distinct(F.flatten(F.transform(F.col(starts), lambda s: F.sequence(s, s + (window - 1)))))
    # a set difference of places, so that the work grows with the lines and not with their square
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered), lambda i: F.get(F.col(lines), i))
    some = F.col(starts).isNotNull()
    return x.select(
        *(col(c) for c in kept),
        F.when(col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(some, F.size(covered)).otherwise(0).cast("long").alias("n_removed"),
        F.when(some, F.array_join(left, "\n")).otherwise(col(text)).alias("kept"),
    )
