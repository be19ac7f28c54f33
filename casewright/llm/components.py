"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.session import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node with a link.

    ``links`` has integer columns a, b. Every round points each node at the smallest node
    that it or a neighbour points at, then follows pointers twice. Rounds are written to the
    shared folder; only the number of changes reaches the driver.
    """
    both = links.filter("a <> b").distinct()
    both = materialize(both.union(both.select("b", "a")).distinct())
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
    roots = materialize(roots)
    for _ in range(rounds):
        near = (
            both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("other").alias("least"))
        )
        hooked = roots.join(near, "node").select("node", "root", F.least("root", "least").alias("least"))
        # the old root learns of the smaller one too
        told = hooked.groupBy(F.col("root").alias("up")).agg(F.min("least").alias("down"))
        jumped = (
            hooked.join(told, F.col("least") == F.col("up"), "left")
            .select("node", F.col("root").alias("before"), F.least("least", F.coalesce("down", "least")).alias("root"))
        )
        fresh = materialize(jumped)
        if fresh.filter("root <> before").isEmpty():
            return fresh.select("node", "root")
        roots = fresh.select("node", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
