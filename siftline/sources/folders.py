"""Folders that all executors share, and what is done to whole folders there."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; on one machine with nothing set, below its temporary directory."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "siftline-work")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """A folder in any file system that Spark reaches, for moves and listings."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def holds(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(""))) if self.holds("") else []

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{self.path}/{old} could not be moved to {new}")

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
