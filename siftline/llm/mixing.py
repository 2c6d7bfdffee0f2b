"""Mixing sources to target weights by weighted fair queueing."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, drop_tables, fresh, shared_table, word_count

WEIGHTS = (3, 1, 2)
#: Digits of the shuffle key that name a bucket; 16**3 buckets split each source.
BUCKET_DIGITS = 3
#: Ranges of finish in a unit of virtual time; the last one up to 2 holds all behind.
RANGES = 1 << 12
#: Words of one copy that become rows of their own, at most.
WORD_ROWS = 4096


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """Target words of each source: (source, source_size, target).

    Sources take ``weights`` in turn by code point, null last, and share
    ``share`` times all words.  A source's target stops at ``repeats`` times its
    size; the excess goes to the others by weight until none is above.  That
    fixed point is a water level: target = min(repeats * size, level * weight).
    The windows run over one row per source.
    """
    s = sizes.groupBy(col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", w.cast("double").alias("w"), (F.lit(float(repeats)) * F.col("source_size")).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(all_rows)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    s = s.withColumn("level", level)
    # past the first source that stays below its stop, levels only fall
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(all_rows)
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def served(before: Column, size: Column, total: Column) -> Column:
    """Words of a document among the first ``total`` of its source's queue, ``before`` of which are earlier ones."""
    return F.greatest(F.lit(0).cast("long"), F.least(size, total - before))


def whole_words(x: Column) -> Column:
    return F.floor(x).cast("long")


def in_ranges(queue: DataFrame, low: float, step: float, n: int) -> DataFrame:
    """Rows of ``queue`` with the range of finish, counted from ``low`` in ``step``; the last one, ``n``, holds all behind.

    A split copy becomes a row for each range in which some of its words finish.
    The words that finish before v are those whose end lies before v * target,
    so their number is had without counting them.
    """
    at = lambda finish: F.greatest(F.lit(0), F.least(F.floor((finish - low) / step), F.lit(n))).cast("int")
    first, last = at((F.col("begin") + 1) / F.col("target")), at(F.col("finish"))
    upto = lambda r: F.when(r <= first, F.lit(0).cast("long")).when(r > last, F.col("size")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.ceil((low + r * step) * F.col("target") - F.col("begin")).cast("long") - 1)))
    part = lambda r: F.struct(r.alias("range"), (F.col("begin") + upto(r)).alias("begin"), (upto(r + 1) - upto(r)).alias("size"))
    parts = F.when(F.col("split"), F.transform(F.sequence(first, last), part)).otherwise(F.array(F.struct(last.alias("range"), "begin", "size")))
    x = queue.select("name", "none", "target", "split", F.explode(parts).alias("q")).select("name", "none", "target", "split", "q.*").where("size > 0")
    return x.withColumn("finish", (F.col("begin") + F.col("size")) / F.col("target"))


def cut_at_budget(queue: DataFrame, budget: int) -> DataFrame:
    """(name, none, served): words of each source in the global order by finish up to ``budget`` words.

    ``queue`` has name, none, begin, size, target, finish and split, a row a
    copy; a split copy's words each have their own place in the order.  It is
    sorted by ranges of finish: totals of the ranges, one row each, are summed
    up; ranges that end within the budget are served whole, those behind it
    not, and only the range in which it ends is sorted and summed row by row.
    While split copies have more than WORD_ROWS words in that range, it is parted
    into ranges itself, so no copy becomes more rows than that, however long.
    """
    low, step, n, sold, left = 0.0, 1.0 / RANGES, 2 * RANGES, [], budget
    rows = queue
    while True:
        x = in_ranges(rows, low, step, n)
        upto = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        ranges = x.groupBy("range").agg(F.sum("size").alias("words"), F.max(F.when(F.col("split"), F.col("size"))).alias("longest")).withColumn("upto", upto)
        cut = ranges.where(F.col("upto") > left).orderBy("range").first()
        sold.append((x if cut is None else x.where(F.col("range") < cut["range"])).select("name", "none", "size"))
        if cut is None:
            break
        rows, left = x.where(F.col("range") == cut["range"]).drop("range"), left - (cut["upto"] - cut["words"])
        if (cut["longest"] or 0) > WORD_ROWS and cut["range"] < n:
            low, step, n = low + cut["range"] * step, step / RANGES, RANGES
            continue
        words = F.when(F.col("split"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda k: F.struct((F.col("begin") + k).alias("begin"), F.lit(1).cast("long").alias("size")))).otherwise(F.array(F.struct("begin", "size")))
        last = rows.select("name", "none", "target", F.explode(words).alias("q")).select("name", "none", "q.*", ((F.col("q.begin") + F.col("q.size")) / F.col("target")).alias("finish"), F.lit(0).alias("one"))
        order = Window.partitionBy("one").orderBy("finish", "none", "name", "begin").rowsBetween(Window.unboundedPreceding, 0)
        last = last.withColumn("upto", F.sum("size").over(order))
        sold.append(last.select("name", "none", served(F.col("upto") - F.col("size"), F.col("size"), F.lit(left)).alias("size")))
        break
    return reduce(DataFrame.union, sold).groupBy("name", "none").agg(F.sum("size").alias("served"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """Schedule every document for a mixture and say how much of it the budget takes.

    A source's documents queue in shuffled order (by MD5 of seed and id), again
    and again up to ``repeats`` rounds.  A copy's virtual finish time is the
    words queued in its source up to its end, divided by the source's target.
    All copies are sorted by finish over all sources and the order is cut where
    its words reach the total budget, the whole words of all targets.  A copy
    that virtual time 1 finds in service is queued word by word: its words finish at
    even distances, so that the cut leaves every source within a word of its target.
    Rows come range-sorted by ``finish``, that of the first copy.

    Adds to the columns of ``docs``: size, source_size, target, taken (words
    the mix takes, repeats counted) and finish; columns of ``docs`` so named
    are replaced.  Null or blank texts have size 0 and are never taken; null
    sources form one source; null ids queue together; repeated rows queue one
    after the other.  No source makes a window of its own: a source is split
    by shuffle key into buckets, whose totals are summed first.
    """
    added = {"size", "source_size", "target", "taken", "finish"}
    kept = [c for c in docs.columns if c.lower() not in added]
    key, name, none, bucket, before, pre, target, total, got = fresh(docs, "q_key", "q_source", "q_null", "q_bucket", "q_before", "q_pre", "q_target", "q_total", "q_served")
    size, = fresh(docs, "q_size")
    shuffled = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(col(id).cast("string"), F.lit(""))))
    group = [name, none, bucket]
    order = Window.partitionBy(*group).orderBy(key, col(id).asc_nulls_last(), size)

    def queued(columns):
        """Rows with the words of their bucket that come before."""
        x = docs.select(*(col(c) for c in columns), word_count(col(text)).alias(size), shuffled.alias(key), F.coalesce(col(source), F.lit("")).alias(name), col(source).isNull().alias(none))
        x = x.withColumn(bucket, F.substring(key, 1, BUCKET_DIGITS))
        return x.withColumn(before, F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))

    heads = docs.select(word_count(col(text)).alias(size), col(source).alias("source"), F.substring(shuffled, 1, BUCKET_DIGITS).alias(bucket))
    heads = shared_table(heads.groupBy("source", bucket).agg(F.sum(size).alias(size)))
    targets = shared_table(source_targets(heads, "source", size, weights, share, repeats).select(F.coalesce("source", F.lit("")).alias(name), F.col("source").isNull().alias(none), F.col("source_size").alias(total), F.col("target").alias(target)))
    heads = heads.select(
        F.coalesce("source", F.lit("")).alias(name), F.col("source").isNull().alias(none), bucket,
        (F.sum(size).over(Window.partitionBy("source").orderBy(bucket)) - F.col(size)).alias(pre),
    )
    x = queued([id]).where(F.col(size) > 0).join(heads.join(targets, [name, none]), group)
    x = x.select(F.col(name).alias("name"), F.col(none).alias("none"), F.col(target).alias("target"), F.col(size).alias("size"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: F.col(before) + F.col(pre) + k * F.col(total))).alias("begin"))
    end = F.col("begin") + F.col("size")
    split = (F.col("begin") < F.col("target")) & (end > F.col("target"))
    x = shared_table(x.where("target > 0").select("name", "none", "target", "begin", "size", (end / F.col("target")).alias("finish"), split.alias("split")))
    budget = targets.agg(F.sum(whole_words(F.col(target)))).first()[0] or 0
    sold = shared_table(cut_at_budget(x, budget))
    drop_tables(x)
    sold = sold.select(F.col("name").alias(name), F.col("none").alias(none), F.col("served").alias(got))
    x = queued(kept).join(heads.join(targets.join(sold, [name, none], "left"), [name, none]), group)
    at, words = F.col(before) + F.col(pre), F.coalesce(F.col(got), F.lit(0).cast("long"))
    taken = sum((served(at + F.col(total) * k, F.col(size), words) for k in range(1, repeats)), served(at, F.col(size), words))
    finish = F.when(F.col(target) > 0, (at + F.col(size)) / F.col(target)).otherwise(F.lit(float("inf")))
    out = x.select(*(col(c) for c in kept), F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(target).alias("target"), taken.alias("taken"), finish.alias("finish"))
    return out.orderBy("finish", col(id).asc_nulls_last())
