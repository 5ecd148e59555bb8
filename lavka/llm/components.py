"""Connected components of a graph given as links, by contraction.

Every round each node takes the smallest of itself and its neighbours for its
parent and then its parent's parent; links are carried over to the parents,
loops and repeats dropped, until no link is left. Each round leaves at most
half of the nodes that still have links, so that there are few rounds.
Smallest neighbours are partial aggregates and the joins read stored tables on
both sides, which lets Spark split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka.llm.stored import stored


def component_roots(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (columns ``a``, ``b``).

    The root is one node of the component, the same for all its nodes. Rows
    with a null end and loops link nothing and name no node.
    """
    links = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parents = stored(smallest.select("node", F.least("node", "least").alias("parent")), "parents")
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = stored(parents.join(above, "parent").select("node", F.col("above").alias("parent")), "parents")
        if roots is None:
            roots = parents.withColumnRenamed("parent", "root")
        else:
            moved = parents.select(F.col("node").alias("root"), "parent")
            found = roots.join(moved, "root", "left")
            roots = stored(found.select("node", F.coalesce("parent", "root").alias("root")), "roots")
        ends = links
        for end in ("a", "b"):
            ends = ends.join(parents.withColumnRenamed("node", end), end)
            ends = ends.drop(end).withColumnRenamed("parent", end)
        links = stored(ends.select("a", "b").filter("a <> b").distinct(), "links")
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
