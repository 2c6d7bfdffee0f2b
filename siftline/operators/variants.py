"""JSON of unknown shape, by the VARIANT type, and nested values made safe for JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to a number that JSON lacks, outside strings.
ODD = r'\G((?:[^"NI-]++|"(?:[^"\\]++|\\.)*+"|-(?!Infinity)|N(?!aN)|I(?!nfinity))*+)(?:NaN|-?Infinity)'


def parsed(text: Column) -> Column:
    """A text's JSON as a variant, null where it is broken; NaN and infinities, which some writers leave in, are null."""
    plain = F.when(F.rlike(text, F.lit("NaN|Infinity")), F.regexp_replace(text, ODD, "$1null")).otherwise(text)
    return F.try_parse_json(F.trim(plain))


def candidates(df: DataFrame, text: str) -> DataFrame:
    """Rows of ``df`` with the edits that each text proposes: n (from 0), first, last, replacement, confidence, explanation.

    The text is an object with a list ``candidates``, or a list itself; items
    that are objects with ``replacement`` and ``line_range`` count, other
    texts give nothing.  Fields of another type are null, confidence is 0.5
    where it is missing.
    """
    x = df.withColumn("_v", parsed(F.col(text)))
    item = lambda path: F.try_variant_get("_v", path, "array<variant>")
    items = F.when(F.expr("schema_of_variant(_v) LIKE 'ARRAY%'"), item("$")).otherwise(item("$.candidates"))
    has = lambda v, key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    kept = F.filter(items, lambda v: has(v, "replacement") & has(v, "line_range"))
    x = x.select(*df.columns, F.posexplode(kept).alias("n", "_c"))
    get = lambda path, kind: F.try_variant_get("_c", path, kind)
    return x.select(
        *df.columns, "n", get("$.line_range[0]", "int").alias("first"), get("$.line_range[1]", "int").alias("last"), get("$.replacement", "string").alias("replacement"),
        F.coalesce(get("$.confidence", "double"), F.lit(0.5)).alias("confidence"), get("$.explanation", "string").alias("explanation"),
    )


def safe(value: Column, kind: T.DataType) -> Column:
    """``value`` in types that JSON has: numbers that are none null, keys and times text, bytes in Base64, whatever holds them."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: safe(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(F.coalesce(safe(e["key"], kind.keyType).cast("string"), F.lit("null")), safe(e["value"], kind.valueType))))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.DecimalType, T.VariantType, T.NullType)):
        return value
    return value.cast("string")


def json_safe(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Rows of ``df`` as JSON objects, nulls included."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.to_json(F.struct(*(safe(F.col(c), kinds[c]).alias(c) for c in columns or df.columns)), {"ignoreNullFields": "false"})
