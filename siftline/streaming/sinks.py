"""Sinks that take each epoch of a stream once, and states replaced as a whole."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import Folder

STAGING = "_staging"


class EpochTable:
    """A table of epochs, each written whole or not at all.

    An epoch's rows are written to a staging folder, which then becomes
    ``epoch=<n>`` in one move. An epoch that is there already stays as it is, so a batch that a
    restarted stream runs again leaves no second copy; what broken runs left in
    staging is never read.  The file system must move folders atomically; one
    writer at a time is taken for granted, as a stream's checkpoint has it.
    """

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet"):
        self.spark, self.path, self.format = spark, path.rstrip("/"), format
        self.folder = Folder(spark, self.path)

    def epochs(self) -> list[int]:
        return sorted(int(n.removeprefix("epoch=")) for n in self.folder.names() if n.startswith("epoch="))

    def write(self, df: DataFrame, epoch: int) -> bool:
        """Write an epoch; False if it was there."""
        if self.folder.holds(f"epoch={epoch}"):
            return False
        staged = f"{STAGING}/{uuid.uuid4().hex}"
        df.write.format(self.format).save(f"{self.path}/{staged}")
        self.folder.move(staged, f"epoch={epoch}")
        return True

    def read(self, schema=None, epochs: list[int] | None = None) -> DataFrame:
        """Rows of the given or all epochs, with the column ``epoch``."""
        names = [f"{self.path}/epoch={e}" for e in (self.epochs() if epochs is None else epochs)]
        reader = self.spark.read.format(self.format).option("basePath", self.path)
        reader = reader.schema(schema) if schema is not None else reader
        if not names:
            if schema is None:
                raise ValueError(f"{self.path} has no epoch yet; give a schema")
            return self.spark.createDataFrame([], schema).withColumn("epoch", F.lit(None).cast("int"))
        return reader.load(names)

    def clean(self) -> None:
        """Drop what broken runs left behind."""
        self.folder.drop(STAGING)


class State(EpochTable):
    """A state that is replaced as a whole: the newest epoch.

    Readers have the old or the new state, never a part; a JSON state is
    ``format="json"``.  The ``keep`` newest are kept for readers under way.
    """

    keep = 2

    def replace(self, df: DataFrame) -> int:
        """Put ``df`` in place of the state; ``df`` may be made from it."""
        held = self.epochs()
        new = held[-1] + 1 if held else 0
        self.write(df, new)
        for old in held[: len(held) + 1 - self.keep]:
            self.folder.drop(f"epoch={old}")
        return new

    def current(self, schema=None) -> DataFrame:
        """The state; empty with the given schema if there is none yet."""
        return self.read(schema, self.epochs()[-1:]).drop("epoch")


def to_table(stream: DataFrame, table: EpochTable, checkpoint: str, put: Callable[[DataFrame], DataFrame] = lambda df: df, **trigger):
    """Start a stream whose batches, put through ``put``, are the epochs of ``table``."""
    return stream.writeStream.foreachBatch(lambda df, epoch: table.write(put(df), epoch) and None).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def approval_callbacks(moves: DataFrame, callbacks: list[str]) -> DataFrame:
    """(id, at, callback): a row for each approved item and each registered callback, for whoever acts on it.

    ``moves`` are those of ``approval_moves``, of which each item is approved
    once at most.  Approvals in bulk have op ``approve_all`` and call nobody.
    """
    names = F.array(*map(F.lit, dict.fromkeys(callbacks))) if callbacks else F.array().cast("array<string>")
    return moves.where("after = 'approved' AND op <> 'approve_all'").select("id", "at", F.explode(names).alias("callback"))
