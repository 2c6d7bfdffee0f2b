"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, shared_table


def step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v), giving edges (u > v) again."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    x = near.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    if large:
        moved = x.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = x.select("u", F.col("m").alias("v")).union(x.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each linked node reaches.

    ``edges`` has longs u and v in any direction, repeats and loops allowed.
    Every round rewrites the edges in the shared folder; the rounds grow with
    the logarithm of the longest chain, and end when a round changes nothing.
    """
    now = shared_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        new = shared_table(step(step(now, True), False))
        found = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_tables(now)
        now = new
        if found == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = found
