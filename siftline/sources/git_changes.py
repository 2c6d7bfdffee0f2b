"""Changed files of a git work tree as a source, and scans that read only them.

The work tree must be on a mount that executors share.
"""

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .readers import SKIP_DIRS

SECONDS = 30
#: Changed files up to this number are read by name; more are looked up among all.
BY_NAME = 50_000
LETTERS = {"A": "added", "M": "modified", "D": "deleted", "T": "modified", "R": "modified", "C": "added", "U": "modified"}


@dataclass
class Kind(D.InputPartition):
    """What a task asks git for: changes to what is tracked, or what isn't."""

    tracked: bool


def git(root: str, *words: str) -> list[str]:
    """The parts of git's answer; none if it fails, as outside a work tree."""
    done = subprocess.run(["git", "-C", root, *words], capture_output=True, timeout=SECONDS)
    return done.stdout.decode("utf-8", "surrogateescape").split("\0")[:-1] if done.returncode == 0 else []


def literal(text: str) -> str:
    return "".join("\\" + c if c in "*?[]\\" else c for c in text)


class GitReader(D.DataSourceReader):
    def __init__(self, root: str):
        self.root, self.specs = root, []

    def pushFilters(self, filters) -> Iterator:
        """Starts and ends of paths go to git, of each the first; Spark applies the rest, and these anew where there are several."""
        for f in filters:
            if f.__class__ in (D.StringStartsWith, D.StringEndsWith) and f.attribute == ("path",) and not self.specs:
                text = literal(f.value)
                self.specs = [f":(top,glob){text}**", f":(top,glob){text}**/*", f":(top,glob){text}*"] if isinstance(f, D.StringStartsWith) else [f":(top,glob)**/*{text}"]
                if "/" in f.value and isinstance(f, D.StringEndsWith):
                    self.specs = []
                    yield f
            else:
                yield f

    def partitions(self) -> list[Kind]:
        return [Kind(True), Kind(False)]

    def read(self, partition: Kind) -> Iterator[tuple]:
        if partition.tracked:
            parts = iter(git(self.root, "diff", "--name-status", "--no-renames", "-z", "HEAD", "--", *self.specs))
            yield from ((path, LETTERS.get(letter[:1], "modified")) for letter, path in zip(parts, parts))
        else:
            yield from ((path, "untracked") for path in git(self.root, "ls-files", "--others", "--exclude-standard", "--full-name", "-z", "--", *self.specs))


class GitChanges(D.DataSource):
    """(path, change) of a work tree against its last commit; option: path, the root of the tree.

    Tracked files that were added, modified or deleted, staged or not, and
    untracked ones that aren't ignored.  A folder that isn't a work tree has no changes.
    """

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return "path string, change string"

    def reader(self, schema) -> GitReader:
        return GitReader(self.options["path"].removeprefix("file://"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitChanges)


def mtimes(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime) below a root, paths relative to it; contents aren't read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.substr(F.regexp_replace("path", "^file:/*", "/"), F.lit(len(root.rstrip("/")) + 2))
    return x.select(path.alias("path"), F.col("modificationTime").alias("mtime")).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIP_DIRS))))


def changed_paths(spark: SparkSession, root: str, endings: list[str], before: DataFrame | None = None) -> DataFrame:
    """(path) of changed files with one of the ``endings``, each once.

    Without git, or where it takes too long, files are compared with
    ``before`` (path, mtime), and all have changed if there is none.
    """
    register(spark)
    ends = F.lit(False)
    for e in endings:
        ends = ends | F.endswith("path", F.lit(e))
    try:
        git(root, "--version")
    except (FileNotFoundError, subprocess.TimeoutExpired):
        now = mtimes(spark, root)
        new = now if before is None else now.join(before.select("path", "mtime"), ["path", "mtime"], "left_anti")
        return new.where(ends).select("path").distinct()
    changes = spark.read.format("git_changes").load(root)
    return changes.where(ends & (F.col("change") != "deleted")).select("path").distinct()


def changed_texts(spark: SparkSession, root: str, endings: list[str], before: DataFrame | None = None) -> DataFrame:
    """(file, text) of the changed files, to run rules over; no other file is opened.  text is null where it isn't UTF-8."""
    root = root.rstrip("/")
    paths = changed_paths(spark, root, endings, before)
    named = [r["path"] for r in paths.limit(BY_NAME + 1).collect()]
    reader = spark.read.format("binaryFile")
    if len(named) > BY_NAME:
        x = reader.option("recursiveFileLookup", True).load(root)
    else:
        there = [f"{root}/{p}" for p in named if os.path.isfile(f"{root}/{p}")]
        if not there:
            return spark.createDataFrame([], "file string, text string")
        x = reader.load([p.replace("\\", "\\\\").replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?") for p in there])
    file = F.substr(F.regexp_replace("path", "^file:/*", "/"), F.lit(len(root) + 2))
    x = x.select(file.alias("file"), F.try_validate_utf8("content").alias("text"))
    return x.join(paths.withColumnRenamed("path", "file"), "file", "left_semi") if len(named) > BY_NAME else x
