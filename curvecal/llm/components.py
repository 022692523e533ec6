"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregates and joins over the edges and is written to the shared folder,
so lineage stays short and a lost executor costs one round. Edges only move to smaller
ids, and the rounds end when nothing changes; their number grows with the logarithm of the
longest chain. The vertices never meet on the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvecal.session import materialize


def _state(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b): the smallest id it is connected to.

    Loops, repeated edges and either direction may occur; rows with a null end are left out.
    """
    edges = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(down.select("a", F.col("m").alias("b"))).distinct())
        edges = materialize(small, "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
