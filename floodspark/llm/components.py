"""Connected components of an edge table by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Rounds of large-star and small-star hang every node below the least of its neighbours; each keeps at most one
    row per edge, combines minima before shuffling, and is written to the shared folder. The end is exact: no
    parent is itself a child and no child has two parents. Nodes without edges do not appear; nulls and loops are
    left out. Extra columns are ignored.
    """
    links = stored(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("v") != F.col("m"))).distinct(), "edges")
    while True:
        links = stored(_small_star(_large_star(links)), "star")
        parents = links.select(F.col("m").alias("p")).distinct()
        deeper = links.join(parents, links["v"] == parents["p"], "left_semi").limit(1).count()
        twice = 0 if deeper else links.groupBy("v").count().filter("count > 1").limit(1).count()
        if not deeper and not twice:
            break
    return links.select(F.col("v").alias("node"), F.col("m").alias("component")).union(
        links.select("m", "m").distinct())


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the least node of its neighbourhood."""
    both = links.union(links.select("m", "v")).toDF("u", "n")
    least = both.groupBy("u").agg(F.min("n").alias("least")).select("u", F.least("u", "least").alias("r"))
    return both.filter("n > u").join(least, "u").select(F.col("n").alias("v"), F.col("r").alias("m")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, below the least of them."""
    least = links.groupBy("v").agg(F.min("m").alias("r"))
    joined = links.join(least, "v")
    return (joined.filter("m > r").select(F.col("m").alias("v"), F.col("r").alias("m"))
            .union(least.select("v", F.col("r").alias("m"))).distinct())
