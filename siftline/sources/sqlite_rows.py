"""Rows of a SQLite table as a source and a sink.

The file must be on a mount that all executors share. One file has one writer
at a time, so this is for tables of the size of a cost log; what is larger
belongs in Parquet.
"""

import contextlib
import glob
import os
import pickle
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

#: Rows that are read or written at a time.
ROWS = 10_000
KINDS = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}
COMPARE = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str, write: bool = False):
    if write:
        return contextlib.closing(sqlite3.connect(path, timeout=60, isolation_level=None))
    return contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=60))


@dataclass
class Rows(D.InputPartition):
    """Rows of a range of row ids."""

    first: int
    last: int


@dataclass
class Staged(D.WriterCommitMessage):
    path: str
    rows: int


class SqliteReader(D.DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, partitions: int):
        self.path, self.table, self.columns, self.n = path, table, [f.name for f in schema.fields], partitions
        self.terms, self.values = [], []

    def pushFilters(self, filters) -> Iterator:
        """Comparisons, null tests and lists of numbers and strings become part of the query; Spark applies the rest."""
        for f in filters:
            name = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool)
            if name and type(f) in COMPARE and plain(f.value):
                self.terms.append(f"{name} {COMPARE[type(f)]} ?")
                self.values.append(f.value)
            elif name and isinstance(f, D.In) and all(map(plain, f.value)) and len(f.value) < 900:
                self.terms.append(f"{name} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif name and isinstance(f, (D.IsNull, D.IsNotNull)):
                self.terms.append(f"{name} IS {'NOT ' if isinstance(f, D.IsNotNull) else ''}NULL")
            else:
                yield f

    def partitions(self) -> list[Rows]:
        with connect(self.path) as c:
            first, last = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if first is None:
            return [Rows(1, 0)]
        step = -(-(last - first + 1) // self.n)
        return [Rows(lo, min(lo + step - 1, last)) for lo in range(first, last + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.terms])
        with connect(self.path) as c:
            found = c.execute(f"SELECT {', '.join(map(quoted, self.columns)) or '1'} FROM {quoted(self.table)} WHERE {where}", (partition.first, partition.last, *self.values))
            while rows := found.fetchmany(ROWS):
                yield from rows


class SqliteWriter(D.DataSourceWriter):
    """Tasks write rows to files of their own beside the database; the commit puts all into the table in one transaction.

    A row file of a task that is run twice counts once, as only those named in
    the commit messages are read; an abort drops all files of the job.
    """

    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.overwrite = path, table, overwrite
        self.columns = [f.name for f in schema.fields]
        self.kinds = [next(k for k, v in KINDS.items() if v == f.dataType) if f.dataType in KINDS.values() else "INTEGER" if isinstance(f.dataType, T.IntegralType) else "TEXT" for f in schema.fields]
        self.stage = f"{path}.staged-{uuid.uuid4().hex}"

    def write(self, rows) -> Staged:
        name, n = f"{self.stage}-{uuid.uuid4().hex}", 0
        with open(name, "wb") as f:
            held = []
            for row in rows:
                held.append(tuple(row))
                n += 1
                if len(held) == ROWS:
                    pickle.dump(held, f)
                    held = []
            if held:
                pickle.dump(held, f)
        return Staged(name, n)

    def commit(self, messages) -> None:
        columns = ", ".join(map(quoted, self.columns))
        try:
            with connect(self.path, write=True) as c:
                c.execute("BEGIN IMMEDIATE")
                try:
                    c.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({', '.join(f'{quoted(n)} {k}' for n, k in zip(self.columns, self.kinds))})")
                    if self.overwrite:
                        c.execute(f"DELETE FROM {quoted(self.table)}")
                    for m in messages:
                        with open(m.path, "rb") as f:
                            left = m.rows
                            while left:
                                rows = pickle.load(f)
                                left -= len(rows)
                                c.executemany(f"INSERT INTO {quoted(self.table)} ({columns}) VALUES ({', '.join('?' * len(self.columns))})", rows)
                    c.execute("COMMIT")
                except BaseException:
                    c.execute("ROLLBACK")
                    raise
        finally:
            self.drop()

    def abort(self, messages) -> None:
        self.drop()

    def drop(self) -> None:
        for name in glob.glob(glob.escape(self.stage) + "-*"):
            os.remove(name)


class SqliteRows(D.DataSource):
    """Options: path, table, and partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def place(self) -> tuple[str, str]:
        path = self.options["path"].removeprefix("file://")
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return path, self.options["table"]

    def schema(self) -> T.StructType:
        path, table = self.place()
        with connect(path) as c:
            return T.StructType([T.StructField(name, KINDS.get(kind.upper().partition("(")[0], T.StringType())) for _, name, kind, *_ in c.execute(f"PRAGMA table_info({quoted(table)})")])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(*self.place(), schema, int(self.options.get("partitions", 8)))

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(*self.place(), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``sqlite_rows`` known to a session, and let it have filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteRows)
