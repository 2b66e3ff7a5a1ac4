"""Connected components of large edge tables by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so hot vertices are combined on the map side and split by adaptive
joins; edges never reach the driver.  Intermediate edges are written to the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.llm.common import discard, materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Edges (u, v) to (id, component), the smallest id reachable, for every id that has a link."""
    edges = materialize(spark, links.select("u", "v").where("u != v").distinct(), "cc")
    mark = None
    for _ in range(MAX_ROUNDS):
        before, edges = edges, materialize(spark, _small_star(_large_star(edges)), "cc")
        discard(spark, before)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def roots(spark: SparkSession, forest: DataFrame) -> DataFrame:
    """A forest (id, parent), at most one parent an id and smaller than it, to (id, component): the root of every id.

    Paths are halved in each round, so the rounds grow with the logarithm of the depth."""
    cur = materialize(spark, forest.select("id", F.col("parent").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        up = cur.select(F.col("id").alias("root"), F.col("root").alias("up"))
        before, cur = cur, materialize(spark, cur.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        discard(spark, before)
        if cur.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("roots did not settle")
    own = cur.select(F.col("root").alias("id")).distinct()
    return cur.select("id", F.col("root").alias("component")).unionByName(own.select("id", F.col("id").alias("component")))
