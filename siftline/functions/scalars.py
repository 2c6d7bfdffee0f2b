"""Scalar expressions: keys, text clean-up, decisions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V


def rank(severity: Column, unknown: int = 99) -> Column:
    """Place of a severity, the most severe 0."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, V.SEVERITIES)), severity), F.lit(0)).cast("int") - 1, F.lit(unknown))


def lookup(table: dict, key: Column, default: Column) -> Column:
    """A value from a small fixed table."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), default)


def lookup_struct(table: dict, key: Column, default: Column) -> Column:
    """The same where the values are columns."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return default if out is None else out.otherwise(default)


def family(kind: Column) -> Column:
    """Family of a finding type; unknown types are their own."""
    return lookup({t: f for f, ts in V.TYPE_FAMILIES.items() for t in ts}, kind, kind)


def bucket(line: Column) -> Column:
    """Three neighbouring lines share a bucket; 0, 1 and 2 the first."""
    return F.when(line > 0, F.floor(line / 3)).otherwise(0).cast("int")


def fingerprint(kind: Column, file: Column, line: Column) -> Column:
    return F.left(F.md5(F.concat_ws(":", kind, file, bucket(line).cast("string"))), F.lit(16))


def short_hash(text: Column, n: int = 16) -> Column:
    return F.left(F.sha2(text, 256), F.lit(n))


def feedback_key(file: Column, source: Column, sink: Column, code: Column) -> Column:
    norm = F.trim(F.regexp_replace(F.left(code, F.lit(100)), r"\s+", " "))
    return F.concat_ws(":", file, source, sink, F.left(F.md5(norm), F.lit(12)))


def pattern_key(code: Column) -> Column:
    """Words become W, then the first 50 characters, then single spaces."""
    return F.trim(F.regexp_replace(F.left(F.regexp_replace(code, r"[\p{L}\p{N}_]+", "W"), F.lit(50)), r"\s+", " "))


def approval_id(kind: Column, file: Column, line: Column, action: Column) -> Column:
    return F.left(F.md5(F.concat_ws(":", kind, file, line.cast("string"), action)), F.lit(12))


def redact(text: Column, keys: list[str]) -> Column:
    """Values of eight characters or more that follow one of ``keys`` give way to three stars."""
    return reduce(lambda t, k: F.regexp_replace(t, rf"(?i)({k}\s*[=:]\s*)[\"']?([^\"' \n,;}}]{{8,}})[\"']?", "$1***"), keys, text)


def first_line(text: Column, most: int = 80) -> Column:
    """The first line, cut to ``most`` characters with three dots."""
    line = F.trim(F.substring_index(F.trim(text), "\n", 1))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 3)), F.lit("..."))).otherwise(line)


def summary(text: Column, most: int = 80) -> Column:
    """The first five keys of a JSON object, else the first line; empty for nothing."""
    keys = F.when(F.startswith(F.trim(text), F.lit("{")), F.json_object_keys(text))
    listed = F.concat(F.lit("JSON: keys=["), F.array_join(F.transform(F.slice(keys, 1, 5), lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))
    return F.coalesce(listed, first_line(text, most), F.lit(""))


def time_part(ts: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(ts), "HH:mm:ss"), ts)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def path_similarity(a: Column, b: Column) -> Column:
    """1 for one path, 0.5 for one parent, else 0.1."""
    parent = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when(a == b, 1.0).when(parent(a) == parent(b), 0.5).otherwise(0.1)


def gate(success: Column, confidence: Column, auto: float = 0.8, review: float = 0.5) -> Column:
    return F.when(~success, "rejected").when(confidence >= auto, "auto_apply").when(confidence >= review, "pending_review").otherwise("rejected")


def cost_tier(cost: Column) -> Column:
    return F.when(cost >= 4.5, "red").when(cost >= 2, "yellow").otherwise("green")


def triage(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "true_positive").when(confidence < 0.4, "false_positive").otherwise("uncertain")


def complexity(kind: Column) -> Column:
    return F.when(kind.isin(V.SIMPLE_TYPES), "simple").when(kind.isin(V.COMPLEX_TYPES), "complex").otherwise("medium")


def effort(kind: Column, related: Column) -> Column:
    return F.greatest(lookup(V.EFFORT, complexity(kind), F.lit(120)) - 10 * related, F.lit(15))


def risk(kind: Column, severity: Column) -> Column:
    make = lambda r, b, c: F.struct(F.lit(r).alias("regression"), F.lit(b).alias("radius"), c.alias("confirm"))
    return (
        F.when(kind.isin(V.SECURITY_TYPES), make("high", "global", F.lit(True)))
        .when(kind.isin(V.RESOURCE_TYPES), make("medium", "module", F.lit(False)))
        .when(kind.isin(V.SIMPLE_TYPES[:4]), make("low", "local", F.lit(False)))
        .otherwise(make("medium", "local", severity.isin("critical", "high")))
    )


def failure_class(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(V.FAILURES):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out
