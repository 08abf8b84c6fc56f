"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a join and an aggregate with map-side combining; each round is written to the shared folder, so lineage
stays short and a lost executor costs one round at most. Nothing is collected but the count that ends the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tree, work_dir


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long): root is the smallest node that it reaches.

    Self-links and repeated links are allowed; without links the result is empty.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = work_dir(spark, "links")
    edges.write.parquet(path)
    edges = spark.read.schema("u long, v long").parquet(path)
    last = None
    for _ in range(max_rounds):
        stars = small_star(large_star(edges))
        to = work_dir(spark, "links")
        stars.write.parquet(to)
        edges = spark.read.schema("u long, v long").parquet(to)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_tree(spark, path)
        path = to
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now
    raise RuntimeError(f"components: no end after {max_rounds} rounds")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest among the node and its neighbours."""
    both = both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these; edges go from larger to smaller already."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
