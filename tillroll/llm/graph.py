"""Connected components of links that stay distributed.

Rounds of contraction: every node points to the smallest node among itself and its neighbours,
and links move to where their ends point. A round at least halves the nodes that still have links.
Pointers are staged per round and followed back afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.plans.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is one node of the component."""
    links = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = stage(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("least"))
            .select("node", F.least("node", "least").alias("to")),
            "pointers",
        )
        rounds.append(points)
        left = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(left, "a").join(right, "b")
        links = stage(
            moved.filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[-1].select("node", F.col("to").alias("root"))
    for points in reversed(rounds[:-1]):
        onward = found.select(F.col("node").alias("to"), "root")
        found = stage(
            points.join(onward, "to", "left").select("node", F.coalesce("root", "to").alias("root")),
            "roots",
        )
    return found
