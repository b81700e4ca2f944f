"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    Every round each node of the contracted graph points to its smallest
    neighbour, pointers are followed to their roots, and the graph is contracted
    again. All steps are joins and pre-aggregated groupings; nothing is
    collected, and the tables of a round are written to the shared folder.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = links.union(links.select("b", "a")).distinct()
    edges = written(both, "links")
    labels = None
    while not edges.isEmpty():
        up = edges.groupBy("a").agg(F.min("b").alias("least"))
        up = written(up.select(F.col("a").alias("node"), F.least("a", "least").alias("to")), "pointers")
        while True:
            over = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            further = up.join(over, "to", "left").select(
                "node", F.coalesce("next", "to").alias("to"), (F.col("next") < F.col("to")).alias("moved"))
            further = written(further, "pointers")
            moved = not further.filter("moved").isEmpty()
            up = further.select("node", "to")
            if not moved:
                break
        if labels is None:
            labels = up.select("node", F.col("to").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "to")
            labels = written(labels.join(step, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")), "labels")
        left = up.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = written(
            edges.join(left, "a").join(right, "b").filter("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels
