"""Connected components of a link table, by repeated contraction.

Every node with a smaller neighbour hooks onto its smallest one; the hooks
form a forest, which pointer jumping shortens; links are rewritten between the
roots, made distinct, and the next round starts from fewer nodes. A round at
least halves the nodes of every unfinished component, so the rounds grow with
the logarithm of the largest one. Nothing is gathered on the driver but one
"is anything left" answer a round; lineage is cut by tables in the shared
folder. Joins meet unique keys on one side, so adaptive execution can split a
hot root on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

JUMPS = 3


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(id, root)`` for every id in a link; ``root`` is the smallest id reachable.

    Links may repeat, run either way or join an id to itself; an empty table gives an empty table.
    """
    edges = materialise(_oriented(links.select("a", "b")))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    rounds = []
    while not edges.isEmpty():
        hooks = materialise(edges.groupBy("a").agg(F.min("b").alias("p")))
        for _ in range(JUMPS):
            nxt = hooks.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            hooks = hooks.join(nxt, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        hooks = materialise(hooks)
        rounds.append(hooks)
        to_b = hooks.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = (edges.join(hooks, "a").join(to_b, "b", "left")
                 .select(F.col("p").alias("a"), F.coalesce("pb", "b").alias("b")))
        edges = materialise(_oriented(moved))
    out = nodes.withColumn("root", F.col("id"))
    for hooks in rounds:
        out = (out.join(hooks.withColumnRenamed("a", "root"), "root", "left")
               .select("id", F.coalesce("p", "root").alias("root")))
    return materialise(out)


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links from the larger id to the smaller one."""
    return (links.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
