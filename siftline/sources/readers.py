"""Sources: file trees, JSON lines, snapshots, tool output."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

# Directories that are never entered.
SKIP_DIRS = [".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build", ".tox"]
LOG_SCHEMA = "timestamp string, level string, request_id string, message string, task_id string, status string, module string, _corrupt_record string"


def source_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(file, ext, mtime, text) below ``root``; text is null where it isn't UTF-8."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kept = ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIP_DIRS))) & ext.isin([e.lstrip(".") for e in extensions])
    return x.where(kept).select(F.col("path").alias("file"), ext.alias("ext"), F.col("modificationTime").alias("mtime"), F.try_validate_utf8("content").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Rows of JSON-lines files below date folders; bad lines and other folders drop out."""
    x = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1)
    return x.select("*", F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date").alias("date")).where("date IS NOT NULL AND _corrupt_record IS NULL").drop("_corrupt_record")


def json_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array or object file; empty where it is missing or broken."""
    try:
        x = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # a path that does not exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return x


def changed(now: DataFrame, before: DataFrame, key: str = "file", state: str = "mtime") -> DataFrame:
    """Rows of ``now`` that are new or differ in ``state``."""
    b = before.select(F.col(key).alias("_k"), F.col(state).alias("_s"))
    return now.join(b, F.col(key).eqNullSafe(F.col("_k")) & F.col(state).eqNullSafe(F.col("_s")), "left_anti")


def mypy_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(file, line, message, code) of the errors in a type checker's text output."""
    p = r"^(.+?):(\d+)(?::\d+)?: error: (.*?)(?:\s+\[([\w-]+)\])?$"
    x = lines.where(F.rlike(F.col(line), F.lit(p)))
    return x.select(F.regexp_extract(line, p, 1).alias("file"), F.regexp_extract(line, p, 2).cast("int").alias("line"), F.left(F.regexp_extract(line, p, 3), F.lit(80)).alias("message"), F.regexp_extract(line, p, 4).alias("code"))


def append_json(df: DataFrame, path: str, rows_a_file: int = 100_000) -> None:
    """Append JSON lines, files kept to a number of rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows_a_file).json(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of their keys; of rows of ``new`` alike in key the last by ``order``, or else the greatest."""
    rest = F.struct(*(c for c in new.columns if c != key))
    one = new.groupBy(key).agg(F.max_by(rest, F.col(order) if order else rest).alias("_r")).select(key, "_r.*").select(*new.columns)
    return old.join(one.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def patched(rows: DataFrame, id: str, value, changes: dict) -> DataFrame:
    """Rows with fields of those of one id changed."""
    hit = F.col(id).eqNullSafe(F.lit(value))
    return rows.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in changes.items()})


def write_state(df: DataFrame, path: str) -> None:
    """Replace a state by JSON files; readers see the old or the new ones, as the commit moves them in one step."""
    df.write.mode("overwrite").json(path)


def audit_row(at, operation, target, outcome, text):
    """One audit record as JSON: what was done to what, with a summary and the start of a hash of the text."""
    return F.to_json(F.struct(at.alias("at"), operation.alias("operation"), target.alias("target"), outcome.alias("outcome"), S.summary(text).alias("summary"), S.short_hash(text).alias("content_hash")))


def log_line(at, level, module, message):
    """A log record as a line of text, its level in five places."""
    return F.format_string("%s %-5s [%s] %s", at, level, module, message)
