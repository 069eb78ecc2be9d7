"""Connected components by alternating large-star and small-star steps on written edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _stars(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    one = e.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("high"))
    return not one.where("v < high").limit(1).count() and not e.join(e.select(F.col("u").alias("k")), F.col("v") == F.col("k"), "left_semi").limit(1).count()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of `edges` (u, v); component is the smallest node that
    links reach. Rows are edges between any two nodes, in any order, repeated or not; null ends
    and loops say nothing. A node's neighbours are never gathered: each step is a partly
    pre-aggregated minimum and an equi-join, which AQE splits where a hub is hot. Every step's
    edges are written to the shared folder, so that a lost executor costs one step."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = scratch.save(e)
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(e)
        e = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
