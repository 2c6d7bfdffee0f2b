"""Dependency graphs in one recursive query: levels, and how failures spread."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import work_folder

#: Levels at most; a longer chain is taken for a cycle.
DEEPEST = 10_000


def walked(starts: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node, level): all that edges (src, dst) lead to from ``starts`` (node), with every number of steps up to ``most`` that does.

    One recursive query, whose every level has a node once.  The rows of all
    levels may be many, so the session's limit of rows is lifted.
    """
    spark = starts.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        f"""WITH RECURSIVE walk(node, level) MAX RECURSION LEVEL {most + 2} AS (
            SELECT node, 0 FROM {{starts}} UNION ALL
            SELECT DISTINCT e.dst, walk.level + 1 FROM walk JOIN {{edges}} AS e ON walk.node = e.src WHERE walk.level < {most})
        SELECT node, level FROM walk""",
        starts=starts, edges=edges,
    )


def known(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between nodes of the graph, as a table in the work folder, since every level reads them."""
    n = nodes.select("node")
    e = edges.select("src", "dst").join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    path = work_folder(nodes.sparkSession, "edges")
    e.write.parquet(path)
    return nodes.sparkSession.read.schema(e.schema).parquet(path)


def levels(nodes: DataFrame, edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(node, level): 0 without dependencies, else one more than the deepest of them, for ``nodes`` (node) and edges (src, dst).

    Edges to unknown nodes are ignored, repeats count once.  Reading the result
    raises if the graph has a cycle, or a chain of more than ``deepest`` edges.
    Null nodes play no part.
    """
    n = nodes.select("node").where("node IS NOT NULL").distinct()
    return placed(n, known(n, edges), deepest)


def placed(n: DataFrame, e: DataFrame, deepest: int) -> DataFrame:
    most = min(n.count(), deepest + 1)
    roots = n.join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    found = walked(roots, e, most).groupBy("node").agg(F.max("level").alias("level"))
    # on a cycle, levels reach the limit or are never reached at all
    bad = F.raise_error(F.concat(F.lit("the graph has a cycle, or a chain that is too long, at "), F.col("node").cast("string")))
    return n.join(found, "node", "left").select("node", F.when(F.col("level").isNull() | (F.col("level") >= most), bad.cast("int")).otherwise(F.col("level")).alias("level"))


def run_graph(nodes: DataFrame, edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(node, wave, status): a run of the graph, where ``nodes`` has node and fails, whether it fails when it is run.

    A node runs a wave behind the last of its dependencies, if all succeeded;
    what a failed node leads to is blocked and has no wave.
    """
    n = nodes.select("node").where("node IS NOT NULL").distinct()
    e = known(n, edges)
    failed = nodes.where("fails AND node IS NOT NULL").select("node").distinct()
    blocked = walked(failed, e, deepest).where("level > 0").select("node").distinct().withColumn("blocked", F.lit(True))
    x = placed(n, e, deepest).join(blocked, "node", "left").join(failed.withColumn("failed", F.lit(True)), "node", "left")
    status = F.when(F.col("blocked"), "blocked").when(F.col("failed"), "failed").otherwise("success")
    return x.select("node", F.when(F.col("blocked").isNull(), F.col("level")).alias("wave"), status.alias("status"))
