"""Logs and files kept within bounds, and an index kept up in segments."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.sinks import EpochTable, State

GIGABYTE = 1 << 30
DAY = 86_400


def running_sum(df: DataFrame, order: list[Column], range_of: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, in ``order``; ``range_of`` rises with the order.

    Sums of the ranges, a row each, come first, so that only a range is one task's.
    """
    x = df.withColumn("_g", range_of).withColumn("_v", value)
    heads = x.groupBy("_g").agg(F.sum("_v").alias("_h"))
    heads = heads.select("_g", (F.sum("_h").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_h")).alias("_h"))
    inside = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_s", F.sum("_v").over(inside) - F.col("_v")).join(heads, "_g")
    return x.withColumn(name, F.col("_s") + F.col("_h")).drop("_g", "_v", "_s", "_h")


def file_table(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of all files below ``root`` that have content, mtime in seconds; none of it is read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return x.select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))


def droppable(files: DataFrame, free: int, now: int, need: int = 5 * GIGABYTE, days: int = 7, all_old: bool = True) -> DataFrame:
    """Files (path, mtime, size) to drop, with the bytes free behind each: none while ``need`` bytes are free, else those older than ``days``.

    With ``all_old`` off, only as many, oldest first (ties by path), as it takes.
    Files without time stay.
    """
    if free >= need:
        return files.limit(0).withColumn("free_after", F.lit(0).cast("long"))
    old = files.where(F.col("mtime") < now - days * DAY)
    old = running_sum(old, [F.col("mtime"), F.col("path")], F.floor(F.col("mtime") / DAY), F.col("size"), "_b")
    old = old.withColumn("free_after", F.col("_b") + F.col("size") + free)
    return (old if all_old else old.where(F.col("_b") + free < need)).drop("_b")


def newest(files: DataFrame, now: int, days: int = 7) -> DataFrame:
    """One row: the newest file (ties: the last path), and of those of the last ``days`` the first path."""
    return files.agg(F.max(F.struct("mtime", "path")).alias("m"), F.min(F.when(F.col("mtime") >= now - days * DAY, F.col("path"))).alias("first_recent")).select(F.col("m.path").alias("newest"), F.col("m.mtime").alias("mtime"), "first_recent")


class SizedLog:
    """A log in segments of ``most`` bytes, of which the newest and ``keep`` more are held.

    A line belongs to the segment in which it starts, counted over all that was
    ever appended; bytes are those of the line and its break.  An append is an
    epoch, written whole or not at all; epochs with no line left are dropped.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 10 << 20, keep: int = 3):
        self.table, self.most, self.keep = EpochTable(spark, path), most, keep

    def append(self, lines: DataFrame, line: str, order: list[str], range_of: Column) -> None:
        """Append rows in ``order`` as lines; ``range_of`` rises with it, see ``running_sum``."""
        held = self.table.epochs()
        before = self.table.read(epochs=held[-1:]).agg(F.max(F.col("start") + F.col("bytes"))).first()[0] if held else None
        x = lines.where(F.col(line).isNotNull()).withColumn("bytes", F.octet_length(line) + 1)
        x = running_sum(x, [F.col(c) for c in order], range_of, F.col("bytes"), "start").withColumn("start", F.col("start") + (before or 0))
        x = x.select(F.floor(F.col("start") / self.most).alias("segment"), "start", "bytes", F.col(line).alias("line"))
        if x.isEmpty():
            return
        self.table.write(x, held[-1] + 1 if held else 0)
        newest = self.newest()
        for epoch in held:
            if self.table.read(epochs=[epoch]).agg(F.max("segment")).first()[0] < newest - self.keep:
                self.table.folder.drop(f"epoch={epoch}")

    def newest(self) -> int:
        return self.table.read(epochs=self.table.epochs()[-1:]).agg(F.max("segment")).first()[0]

    def read(self) -> DataFrame:
        """(segment, start, bytes, line) of the segments that are held; lines come in order by start."""
        return self.table.read("segment long, start long, bytes int, line string").where(F.col("segment") >= (self.newest() if self.table.epochs() else 0) - self.keep).drop("epoch")


class VectorIndex:
    """Vectors by id in segments: appends and removals add one, compaction makes one of all.

    Of rows alike in id the one of the newest segment counts, or none if that is a
    removal.  A state lists the live segments in order; it is replaced in one
    move, so a reader sees all of an append or compaction or nothing of it.
    """

    LISTED = "segment long, place int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table, self.state = EpochTable(spark, f"{path}/segments"), State(spark, f"{path}/listed", "json")

    def segments(self) -> list[int]:
        return [r["segment"] for r in self.state.current(self.LISTED).orderBy("place").collect()]

    def add(self, rows: DataFrame, keep: list[int]) -> None:
        new = max([-1, *self.table.epochs()]) + 1
        self.table.write(rows, new)
        self.state.replace(self.spark.createDataFrame([(s, i) for i, s in enumerate([*keep, new])], self.LISTED))

    def append(self, rows: DataFrame) -> None:
        """Put rows (id, v) in, in place of those of their ids; of rows alike in id the greatest."""
        self.add(rows.groupBy("id").agg(F.max("v").alias("v")).withColumn("gone", F.lit(False)), self.segments())

    def remove(self, ids: DataFrame) -> None:
        self.add(ids.select("id").distinct().select("id", F.lit(None).cast("array<double>").alias("v"), F.lit(True).alias("gone")), self.segments())

    def live(self) -> DataFrame:
        """(id, v) of all vectors that count."""
        held = self.segments()
        x = self.table.read("id long, v array<double>, gone boolean", held)
        place = F.array_position(F.array(*map(F.lit, held)), F.col("epoch")) if held else F.lit(0)
        x = x.groupBy("id").agg(F.max_by(F.struct("v", "gone"), place).alias("r"))
        return x.where("NOT r.gone").select("id", "r.v")

    def compact(self) -> None:
        """One segment of what counts; what it stands for goes."""
        old = self.segments()
        self.add(self.live().withColumn("gone", F.lit(False)), [])
        for segment in old:
            self.table.folder.drop(f"epoch={segment}")

    def rebuild(self, rows: DataFrame) -> None:
        """Start anew from all rows."""
        old = self.segments()
        self.add(rows.groupBy("id").agg(F.max("v").alias("v")).withColumn("gone", F.lit(False)), [])
        for segment in old:
            self.table.folder.drop(f"epoch={segment}")
