"""Helpers that the operators share: word counts, fresh names, shared tables."""

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    edge = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
    parts = F.size(F.split(text, SPACE + "+", -1))
    ends = F.when(F.substring(text, 1, 1).isin(edge), 1).otherwise(0) + F.when(F.substring(text, -1, 1).isin(edge), 1).otherwise(0)
    blank = text.isNull() | (F.length(text) == 0)
    return F.when(blank, F.lit(0)).otherwise(parts - ends).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas inside use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    The setting is the cluster's.  Only where it is unset and all runs on one
    machine, as in tests, a folder of the system's temporary directory takes its
    place; elsewhere other executors couldn't read it, and that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = held if held else "file://" + os.path.join(tempfile.gettempdir(), "siftline-checkpoints")
    return f"{root.rstrip('/')}/siftline-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Delete shared tables that nothing still to be run reads."""
    for df in frames:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            jvm = spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
            if folder.getName().startswith("siftline-"):
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
