"""Connected components of a graph that no task holds whole."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node of the edges (u, v): the least node that it hangs together with.

    Large star and small star in turn, until no edge changes. Each step is a minimum for each node,
    summed before it is shuffled, and a join with it that adaptive execution can split at a hot
    node. Edges shrink to one for each node, so nothing grows with the size of a component.
    """
    now = materialise(_down(edges))
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = state["n"], state["h"]
        now = materialise(_small(_large(now)))
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    own = roots.select(F.col("root").alias("u")).distinct().withColumn("root", F.col("u"))
    return roots.unionByName(own)


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its greater node to its smaller one."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Hang the greater neighbours of each node on its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return _down(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(moved.unionByName(least.select("u", F.col("m").alias("v"))))
