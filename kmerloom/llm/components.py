"""Connected components of a link table, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component, moved) for every node of ``links``; a component is named by its least node (moved is false).

    Labels go to neighbours and are then followed to their own labels (pointer jumping), so chains
    shrink at least by half a round. Each round is a table in the shared folder, and only counts reach the driver.
    Nulls and loops are ignored; an empty table has no nodes. A node with very many links, or a component with very many nodes, is a
    frequent key of the larger side of a join only: the other side has one row for it, so adaptive execution can split it, and
    aggregations by node merge in each task first.
    """
    one_way = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = written(one_way.union(one_way.select("v", "u")).distinct(), "edges")
    labels = edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component"))
    labels = written(labels.withColumn("moved", F.lit(True)), "labels")
    while not labels.where("moved").isEmpty():
        told = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        nearer = labels.join(told, labels.node == told.u).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        nearer, older = written(nearer, "labels"), labels
        ends = nearer.select(F.col("node").alias("component"), F.col("component").alias("end"))
        least = F.least("component", "end")
        labels = written(nearer.join(ends, "component").select("node", least.alias("component"), (least < F.col("old")).alias("moved")), "labels")
        dropped(older, nearer)
    dropped(edges)
    return labels
