"""Graphs given as edge tables, such as the words that follow one another in texts: components, chains, nothing listed beyond the edges.

Every loop keeps a table of what it has found and moves a frontier: a round reads the edges of its frontier and writes only what changed. Nodes are
longs; several graphs are told apart by ``set_id``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.kspace import KmerSpace
from ..shared import dropped, written

NODE = ["set_id", "node"]


def word_edges(rows: DataFrame, space: KmerSpace, *, text: str = "text", alphabet: str = "acgt", lower: bool = True) -> DataFrame:
    """(src, dst): pairs of words of k symbols that follow one another somewhere, each once."""
    table, alpha = arrays.symbol_table(alphabet, lower), space.alpha

    def tasks(batches):
        for batch in arrays.batches_of(batches, "text", 1 << 20):
            digits = arrays.digits_of(batch.column("text"), table)
            places, _ = arrays.word_places(digits, space.k + 1)
            longer = np.unique(arrays.codes(digits.values, space.k + 1, alpha)[places])
            yield pa.RecordBatch.from_arrays([pa.array(longer // alpha), pa.array(longer % space.size)], names=["src", "dst"])

    if space.size * alpha >= 2**63:
        raise ValueError("words of k + 1 symbols do not fit a long")
    return rows.select(F.col(text).alias("text")).mapInArrow(tasks, "src long, dst long").distinct()


def without(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """Edges (set_id, src, dst) of which neither end is a ``taken`` node (set_id, mer)."""
    for end in ("src", "dst"):
        edges = edges.join(taken.select("set_id", F.col("mer").alias(end)), ["set_id", end], "left_anti")
    return edges.select("set_id", "src", "dst")


def _ends(edges: DataFrame, end: str) -> DataFrame:
    return edges.select("set_id", F.col(end).alias("node"))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


SIDED = ["set_id", "side", "node"]


def _peeled(arcs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(levels, tables): (set_id, side, node, level) of nodes that go when those without an arc (set_id, side, a, b) into b go, round after round; level from 1.

    A node counts its arcs; each round sends one decrement for each arc of its frontier, and the nodes whose decrements add up are the next one. So
    every arc is written once over all rounds. A node's level is one more than the last round that sent it a decrement.
    """
    degree = written(arcs.groupBy("set_id", "side", F.col("b").alias("node")).agg(F.count("*").alias("degree")), "degrees")
    free = written(nodes.join(degree, SIDED, "left_anti").select(*SIDED), "front")
    front, sent, level = free, [], 1
    total = F.sum("gone").alias("gone"), F.max("level").alias("level")
    while True:
        level += 1
        ahead = arcs.join(front.select("set_id", "side", F.col("node").alias("a")), ["set_id", "side", "a"])
        told = ahead.groupBy("set_id", "side", F.col("b").alias("node")).agg(F.count("*").alias("gone")).withColumn("level", F.lit(level))
        sent.append(written(told, "gone"))
        if sent[-1].isEmpty():
            break
        if len(sent) > 16:  # few tables to read
            held, sent = sent, [written(_union(sent).groupBy(*SIDED).agg(*total), "gone")]
            dropped(*held)
            recent = sent[0].where(F.col("level") == level)
        else:
            recent = sent[-1]
        front = _union(sent).join(recent.select(*SIDED), SIDED, "left_semi").groupBy(*SIDED).agg(*total).join(degree, SIDED).where("gone = degree").select(*SIDED)
    later = _union(sent).groupBy(*SIDED).agg(*total).join(degree, SIDED).where("gone = degree").select(*SIDED, "level")
    return free.select(*SIDED, F.lit(1).alias("level")).union(later), [degree, free, *sent]


def _arcs(edges: DataFrame, *sides: int) -> DataFrame:
    """Edges as arcs a to b, on side 1 the other way round."""
    ends = [("src", "dst"), ("dst", "src")]
    return _union([edges.select("set_id", F.lit(i).alias("side"), F.col(ends[i][0]).alias("a"), F.col(ends[i][1]).alias("b")) for i in sides])


def chains(edges: DataFrame) -> DataFrame:
    """(set_id, n_nodes, longest): nodes on the longest chain of edges (set_id, src, dst) of each graph; null where it has a cycle.

    The level at which a node is freed is the number of nodes of the longest chain that ends in it.
    """
    edges = written(edges.distinct(), "edges")
    nodes = written(_ends(edges, "src").union(_ends(edges, "dst")).distinct().withColumn("side", F.lit(0)), "nodes")
    levels, tables = _peeled(_arcs(edges, 0), nodes)
    every = nodes.groupBy("set_id").agg(F.count("*").alias("n_nodes"))
    found = levels.groupBy("set_id").agg(F.count("*").alias("freed"), F.max("level").alias("longest"))
    out = every.join(found, "set_id", "left").select("set_id", "n_nodes", F.when(F.col("freed") == F.col("n_nodes"), F.col("longest")).cast("bigint").alias("longest"))
    out = written(out, "chains")
    dropped(edges, nodes, *tables)
    return out


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when nodes that no cycle can go through, for want of a way in or out, are gone. Both directions are peeled at once."""
    nodes = _ends(edges, "src").union(_ends(edges, "dst")).distinct()
    gone, tables = _peeled(_arcs(edges, 0, 1), nodes.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))))
    gone, left = gone.select(*NODE).distinct(), edges
    for end in ("src", "dst"):
        left = left.join(gone.withColumnRenamed("node", end), ["set_id", end], "left_anti")
    left = written(left.select("set_id", "src", "dst"), "edges")
    dropped(*tables)
    return left


def _labelled(edges: DataFrame) -> DataFrame:
    """(set_id, node, label): the greatest node that reaches each node, itself included; only nodes whose label rose tell their successors."""
    nodes = _ends(edges, "src").union(_ends(edges, "dst")).distinct()
    front = written(nodes.withColumn("label", F.col("node")), "labels")
    known = [front]
    while not front.isEmpty():
        told = edges.join(front.select("set_id", F.col("node").alias("src"), "label"), ["set_id", "src"])
        told = told.groupBy("set_id", F.col("dst").alias("node")).agg(F.max("label").alias("told"))
        labels = _union(known).groupBy(*NODE).agg(F.max("label").alias("label"))
        front = written(told.join(labels, NODE).where("told > label").select(*NODE, F.col("told").alias("label")), "labels")
        known.append(front)
        if len(known) > 16:  # few tables to read
            held, known = known, [written(_union(known).groupBy(*NODE).agg(F.max("label").alias("label")), "labels")]
            dropped(*held[:-1])
    labels = written(_union(known).groupBy(*NODE).agg(F.max("label").alias("label")), "labels")
    dropped(*known)
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(set_id, scc_id, node): strongly connected components of edges (set_id, src, dst), named by their least node; a single node counts only with a loop.

    Nodes on no cycle are trimmed away. Each node left takes the greatest label that reaches it; a node that keeps its own is the root of a component,
    which is found backward inside the label, for all roots at once. What is left goes on.
    """
    left = written(edges.distinct(), "edges")
    parts: list[DataFrame] = []
    while True:
        before, left = left, _trimmed(left)
        dropped(before)
        if left.isEmpty():
            break
        labels = _labelled(left)
        inside = left
        for end in ("src", "dst"):
            inside = inside.join(labels.select("set_id", F.col("node").alias(end), F.col("label").alias(f"{end}_label")), ["set_id", end])
        inside = written(inside.where("src_label = dst_label").select("set_id", "src", "dst", F.col("src_label").alias("root")), "inside")
        front = written(labels.where("label = node").select(*NODE, F.col("label").alias("root")), "members")
        found = [front]
        while not front.isEmpty():
            back = inside.join(front.select("set_id", F.col("node").alias("dst"), "root"), ["set_id", "dst", "root"])
            back = back.select("set_id", F.col("src").alias("node"), "root").distinct().join(_union(found).select(*NODE), NODE, "left_anti")
            front = written(back, "members")
            found.append(front)
        part = written(_union(found), "components")
        parts.append(part)
        before = left
        for end in ("src", "dst"):
            left = left.join(part.select("set_id", F.col("node").alias(end)), ["set_id", end], "left_anti")
        left = written(left.select("set_id", "src", "dst"), "edges")
        dropped(before, labels, inside, *found)
    if not parts:
        return left.select("set_id", F.col("src").alias("scc_id"), F.col("src").alias("node"))
    every = _union(parts)
    named = every.groupBy("set_id", "root").agg(F.min("node").alias("scc_id"), F.count("*").alias("n"))
    loops = edges.where("src = dst").select("set_id", F.col("src").alias("scc_id")).distinct().withColumn("loop", F.lit(True))
    real = named.join(loops, ["set_id", "scc_id"], "left").where("n > 1 OR loop").select("set_id", "root", "scc_id")
    return every.join(real, ["set_id", "root"]).select("set_id", "scc_id", "node")
