"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label) for every node that has an edge to another; label is the component's smallest node.

    Each round joins every node to its smallest neighbour, follows these pointers until they rest, and contracts the
    edges. Edges shrink from round to round; all that is kept between rounds is in the checkpoint folder.
    """
    edges = saved(edges.filter("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"))
        while True:
            ahead = point.select(F.col("node").alias("at"), F.col("to").alias("next"))
            moved = saved(point.join(ahead, F.col("to") == F.col("at")).select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            point = moved.select("node", "to")
            if moved.filter("moved").isEmpty():
                break
        if labels is None:
            labels = point.withColumnRenamed("to", "label")
        else:
            labels = saved(labels.join(point, F.col("label") == point.node, "left").select(labels.node, F.coalesce("to", "label").alias("label")))
        ends = [point.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab"]
        edges = saved(edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).filter("a <> b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
