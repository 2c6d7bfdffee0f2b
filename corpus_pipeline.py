"""The corpus pipeline: five stages, each over all that its predecessor kept.

1. language ID drops documents without a recognisable language
2. line dedup removes later copies of repeated runs of lines
3. n-gram Jaccard join keeps one document of each near-duplicate group
4. benchmark decontamination drops documents that hold a benchmark item
5. mixing schedules what is left by target weights

Stages 1 to 4 return the columns of ``documents``; the last adds size,
source_size, target, taken and finish, in mixing order.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, langid, lines, mixing, ngram_join
from siftline.llm.common import col, fresh, shared_table

#: The least probability at which a language is taken as recognised.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the network learns from their own labels, outside the held-out part."""
    part = langid.held_out("doc_id", 4, 2)
    net = langid.train(docs.where(~part & F.col("doc_id").isNotNull()), "text", "lang")
    clash = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    x = langid.identify(docs.withColumnsRenamed(clash), net, clash["text"])
    x = x.where((F.col("lang_pred") != langid.NO_LANGUAGE) & (F.col("score") >= LEAST_SCORE))
    return x.select(*(F.col(v).alias(k) for k, v in clash.items()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with later copies of repeated three-line runs cut out; those left without a word go."""
    clash = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    x = lines.line_dedup(docs.withColumnsRenamed(clash), clash["doc_id"], clash["text"])
    x = x.where((F.col("n_removed") == 0) | (mixing.word_count(F.col("kept")) > 0))
    put = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(clash["n_chars"])).cast(dict(docs.dtypes)["n_chars"]) if "n_chars" in clash else None}
    return x.select(*((put[k] if k in put else F.col(v)).alias(k) for k, v in clash.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by five-word shingles at similarity 0.8.

    Rows are told apart by a key of their own, so that null and repeated ids
    cost no row but copies; null ids come last.
    """
    row, = fresh(docs, "row")
    keyed = shared_table(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = shared_table(ngram_join.ngram_join(keyed.select(row, "text"), id=row)).select(F.col(row), F.col("component_id").alias("c"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))
    kept = groups.join(keyed.select(row, "doc_id"), row).groupBy("c").agg(first.alias("first")).select(F.col(f"first.{row}").alias(row))
    gone = groups.select(row).join(kept, row, "left_anti")
    return keyed.join(gone, row, "left_anti").select(*(col(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a near copy of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document, in its order; documents of which it takes nothing go."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
]

#: Language ID and decontamination can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
