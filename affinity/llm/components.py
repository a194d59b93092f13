"""Connected components by alternating large-star and small-star.

Each round hangs the neighbours of every node on the least node around it: the
large star does so for neighbours above the node, the small star for those below
it.  The edges end as stars around the least node of each component, after a
number of rounds that grows with the logarithm of the longest path.  A node's
least neighbour comes from an aggregate that combines before the shuffle, and
goes back to its edges by a join whose large partitions Spark splits, so a node
with very many neighbours is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges``: u above v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node that has an edge; component: the least id reachable.

    Repeated edges, loops and either direction are allowed; null ends are ignored.
    """
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "edges")
    state = _state(now)
    while True:
        after = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        then = _state(after)
        forget(now)
        now = after
        if then == state:
            break
        state = then
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
