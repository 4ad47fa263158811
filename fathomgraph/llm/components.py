"""Connected components of links, as DataFrame steps.

Each round every node takes its smallest neighbour (or itself) as parent, parents are followed to their root by pointer
jumping, and the links between different roots go on to the next round. Hot nodes are pre-aggregated by the minimum, and
the joins on them are skew joins of rows of two numbers. All tables are written in the shared folder; superseded ones
are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): the root is the smallest node reachable. Self-links and nulls are ignored."""
    links = durable(links.select("a", "b").filter("a <> b").distinct(), "links")
    roots: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parents = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("parent")), "parents")
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = parents.select("node", "parent", F.col("parent").alias("before"))
            for _ in range(2):  # two jumps in a job
                jumped = jumped.join(above, "parent").select("node", F.col("above").alias("parent"), "before")
            jumped = durable(jumped.select("node", "parent", (F.col("parent") != F.col("before")).alias("moved")), "parents")
            discard(parents)
            parents = jumped
            if parents.filter("moved").isEmpty():
                break
        at = parents.select("node", "parent")
        if roots is None:
            following = durable(at.withColumnRenamed("parent", "root"), "roots")
        else:
            above = at.select(F.col("node").alias("root"), "parent")
            following = durable(roots.join(above, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
            discard(roots)
        roots = following
        first, second = at.select(F.col("node").alias("a"), F.col("parent").alias("p")), at.select(F.col("node").alias("b"), F.col("parent").alias("q"))
        contracted = links.join(first, "a").join(second, "b").filter("p <> q")
        following = durable(contracted.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "links")
        discard(links, parents)
        links = following
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
