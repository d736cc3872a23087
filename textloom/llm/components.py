"""Connected components of a link table by alternating large-star / small-star steps.

Each step is one shuffle of the links with map-side combination; a hub with a
third of all links is reduced to its minimum before the shuffle. Nothing is
collected to the driver but a count of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import written


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for every id in links(a, b); component is the smallest id reachable.

    An empty link table gives an empty result; self links and repeats are harmless.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked with u's smallest neighbour
        both = edges.union(edges.select("v", "u")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.least("m", "x").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, are linked with the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = large.join(least, "u").select(F.explode(F.when(F.col("v") > F.col("m"), F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("u"), F.col("m").alias("v"))))).alias("e")).select("e.u", "e.v").distinct()
        new = written(small, "links")
        stars = new.select("v").distinct().join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        multiple = new.groupBy("u").count().where("count > 1").limit(1).count()
        edges = new
        if not stars and not multiple:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
