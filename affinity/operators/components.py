"""Connected components of an undirected edge list, as stars around the least nodes.

Each round first hangs the neighbours above every node on the least node around
it, then those below.  The rounds end when every component is a star around its
least node, which takes about as many as the logarithm of the longest path.  A
node's least neighbour comes from an aggregate that combines before the shuffle,
and is joined back by the node, not by its component: a giant component is no
key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.storage import forget, written


def _round(edges: DataFrame) -> DataFrame:
    """``edges``: hi above lo, each once."""
    ways = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
    least = ways.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("least"))
    above = ways.filter("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo")).distinct()
    low = above.groupBy("hi").agg(F.min("lo").alias("least"))
    rest = above.join(low, "hi").filter("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return rest.union(low.select("hi", F.col("least").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(node, component) of every node; component: the least node of it.

    Edges may repeat and point either way; loops count as their node, edges with a
    missing end do not count.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    given = written(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    now, state = given, None
    while True:
        after = written(_round(now.filter("hi > lo")), "edges")
        then = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now is not given:
            forget(now)
        now = after
        if then == state:
            break
        state = then
    nodes = given.select(F.col("hi").alias("node")).union(given.select("lo")).distinct()
    found = written(nodes.join(now.select(F.col("hi").alias("node"), "lo"), "node", "left").select("node", F.coalesce("lo", "node").alias("component")), "components")
    forget(given)
    forget(now)
    return found
