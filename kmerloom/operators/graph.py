"""The de Bruijn graph minus a set: edges, reachability, paths and strongly connected components.

Many sets (set_id, mer) are handled at once. Loops keep their state in shared tables; components of spaces of up to ``MOST_NODES`` are found in
one task a set, those of larger ones by joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kspace import KmerSpace
from ..shared import dropped, written
from .sets import members, with_reverse_complements

MOST_NODES = 1 << 20


def edges(spark: SparkSession, space: KmerSpace) -> DataFrame:
    """(src, dst, base): all edges of the graph."""
    return space.universe(spark).select(F.col("mer").alias("src"), F.posexplode(space.successors("mer")).alias("base", "dst")).select("src", "dst", "base")


def edges_outside(space: KmerSpace, mers: DataFrame, *, mode: str = "straight") -> DataFrame:
    """Edges of which neither end is in the set under ``mode``."""
    every = edges(mers.sparkSession, space)
    left = members(space, every, mers, mode=mode, mer="src", keep=False)
    return members(space, left, mers, mode=mode, mer="dst", keep=False)


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): nodes that each start (column ``start``) reaches over ``links`` (src, dst) in one step or more."""
    steps = links.select(F.col("src").alias("node"), "dst").distinct()
    front = written(starts.select("start", F.col("start").alias("node")).distinct().join(steps, "node").select("start", F.col("dst").alias("node")).distinct())
    found = front
    while front.limit(1).count():
        ahead = front.join(steps, "node").select("start", F.col("dst").alias("node")).distinct()
        front = written(ahead.join(found, ["start", "node"], "left_anti"))
        found = written(found.union(front))
    return found


def effective(space: KmerSpace, rows: DataFrame, mode: str) -> DataFrame:
    """(set_id, mer): the mers that a set takes out of the graph under a mode."""
    rows = rows.select("set_id", "mer").distinct()
    if mode == "straight":
        return rows
    rc = rows.select("set_id", space.reverse_complement("mer").alias("mer"))
    if mode == "union":
        return rows.union(rc).distinct()
    if mode == "canonical":
        own = rows.where(F.col("mer") == space.canonical("mer"))
        return own.union(own.select("set_id", space.reverse_complement("mer").alias("mer"))).distinct()
    raise ValueError(f"no such mode: {mode}")


def _alive(space: KmerSpace, sets: DataFrame, taken: DataFrame) -> DataFrame:
    every = sets.select("set_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(space.size - 1).cast("bigint"))).alias("mer"))
    return every.join(taken, ["set_id", "mer"], "left_anti")


def _trimmed(space: KmerSpace, alive: DataFrame) -> DataFrame:
    """Nodes without a predecessor or a successor among them go, round after round, until all have both."""
    n, left = -1, alive.count()
    while n != left and left:
        n = left
        for step in (space.successors, space.predecessors):
            fed = alive.select("set_id", F.explode(step("mer")).alias("mer")).distinct()
            before, alive = alive, written(alive.join(fed, ["set_id", "mer"], "left_semi"), "alive")
            dropped(before)
        left = alive.count()
    return alive


def scc_by_joins(space: KmerSpace, rows: DataFrame, *, mode: str = "straight") -> DataFrame:
    """The same as ``scc`` for spaces of any size, by joins only.

    Trimmed nodes take the greatest label that reaches them. A node that keeps its own label is a root; its component is what reaches it
    inside its label. All roots of all sets are found at once; their components leave, and the rest goes on.
    """
    alive = written(_alive(space, rows.select("set_id").distinct(), effective(space, rows, mode)), "alive")
    found = alive.select("set_id", F.col("mer").alias("root"), "mer").limit(0)
    while not (alive := _trimmed(space, alive)).isEmpty():
        labels = written(alive.withColumn("label", F.col("mer")), "labels")
        moved = True
        while moved:
            told = labels.select("set_id", F.explode(space.successors("mer")).alias("mer"), "label").groupBy("set_id", "mer").agg(F.max("label").alias("told"))
            after = labels.join(told, ["set_id", "mer"]).select("set_id", "mer", F.greatest("label", "told").alias("label"), (F.col("told") > F.col("label")).alias("moved"))
            after, before = written(after, "labels"), labels
            moved, labels = not after.where("moved").isEmpty(), after.drop("moved")
            dropped(before)
        front = written(labels.where("label = mer"), "members")
        members = front
        while not front.isEmpty():
            back = front.select("set_id", F.explode(space.predecessors("mer")).alias("mer"), "label").distinct()
            front = written(back.join(labels, ["set_id", "mer", "label"], "left_semi").join(members, ["set_id", "mer"], "left_anti"), "members")
            members = written(members.union(front.select(*members.columns)), "members")
        found = written(found.union(members.select("set_id", F.col("label").alias("root"), "mer")), "components")
        alive = written(alive.join(members, ["set_id", "mer"], "left_anti"), "alive")
    named = found.groupBy("set_id", "root").agg(F.min("mer").alias("scc_id"), F.count("*").alias("n"))
    real = named.where((F.col("n") > 1) | space.is_homopolymer("scc_id"))
    return found.join(real, ["set_id", "root"]).select("set_id", "scc_id", "mer")


def scc(space: KmerSpace, rows: DataFrame, *, mode: str = "straight", most_nodes: int = MOST_NODES) -> DataFrame:
    """(set_id, scc_id, mer): strongly connected components outside each set, named by their least mer; a single
    node counts only with a loop. Sets with nothing left have no rows. Spaces of up to ``most_nodes`` are one task a set, larger ones are
    worked on by joins (``scc_by_joins``)."""
    if space.size > most_nodes:
        return scc_by_joins(space, rows, mode=mode)
    sets = effective(space, rows, mode).groupBy("set_id").agg(F.collect_list("mer").alias("mers"))
    n, alpha, fmoves = space.size, space.alpha, space.fmoves

    def components(taken: set[int]):
        order = {m: -1 for m in range(n) if m not in taken}
        low: dict[int, int] = {}
        stack, count = [], 0
        for root in list(order):
            if order[root] >= 0:
                continue
            work = [(root, 0)]
            while work:
                m, b = work.pop()
                if b == 0 and order[m] < 0:
                    order[m] = low[m] = count
                    count += 1
                    stack.append(m)
                while b < alpha:
                    nxt = m % fmoves * alpha + b
                    b += 1
                    if nxt in order:
                        if order[nxt] < 0:
                            work.extend(((m, b - 1), (nxt, 0)))
                            break
                        if nxt in low:
                            low[m] = min(low[m], low[nxt])
                else:
                    if low[m] == order[m]:
                        part = []
                        while not part or part[-1] != m:
                            part.append(stack.pop())
                            low.pop(part[-1])
                        if len(part) > 1 or m % fmoves * alpha + m // fmoves == m:
                            yield part

    def kernel(batches):
        for pdf in batches:
            out = [(s, min(part), m) for s, mers in zip(pdf["set_id"], pdf["mers"], strict=True) for part in components(set(map(int, mers))) for m in part]
            yield pd.DataFrame(out, columns=["set_id", "scc_id", "mer"])

    kind = rows.schema["set_id"].dataType.simpleString()
    return sets.mapInPandas(kernel, f"set_id {kind}, scc_id long, mer long")


def scc_counts(space: KmerSpace, rows: DataFrame, *, mode: str = "straight") -> DataFrame:
    """(set_id, n_scc, n_nodes) for every set, 0 where it takes every cycle."""
    found = scc(space, rows, mode=mode).groupBy("set_id").agg(F.countDistinct("scc_id").alias("n_scc"), F.count("*").alias("n_nodes"))
    zero = F.lit(0).cast("bigint")
    return rows.select("set_id").distinct().join(found, "set_id", "left").select("set_id", F.coalesce("n_scc", zero).alias("n_scc"), F.coalesce("n_nodes", zero).alias("n_nodes"))


def is_decycling(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, decycling) by peeling: nodes without a predecessor outside the set go, until none does.

    What is left has a cycle. The rounds are as many as the longest path, and each works on all sets.
    """
    sets = rows.select("set_id").distinct()
    every = sets.select("set_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(space.size - 1).cast("bigint"))).alias("mer"))
    alive = written(every.join(rows.select("set_id", "mer"), ["set_id", "mer"], "left_anti"), "alive")
    n = alive.count()
    while True:
        fed = alive.select("set_id", F.explode(space.successors("mer")).alias("mer")).distinct()
        before, alive = alive, written(alive.join(fed, ["set_id", "mer"], "left_semi"), "alive")
        dropped(before)
        left = alive.count()
        if left == n or not left:
            break
        n = left
    stuck = alive.select("set_id").distinct().withColumn("stuck", F.lit(True))
    return sets.join(stuck, "set_id", "left").select("set_id", F.col("stuck").isNull().alias("decycling"))


def longest_path(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, decycling, longest): nodes on the longest path outside each set; the space's size if a cycle is left."""
    ok = written(is_decycling(space, rows), "decycling")
    good = rows.join(ok.where("decycling"), "set_id", "left_semi")
    every = good.select("set_id").distinct().select("set_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(space.size - 1).cast("bigint"))).alias("mer"))
    front = written(every.join(good, ["set_id", "mer"], "left_anti"), "front")
    lengths, step = [], 1
    while front.limit(1).count():
        lengths.append(front.select("set_id").distinct().withColumn("n", F.lit(step)))
        ahead = front.select("set_id", F.explode(space.successors("mer")).alias("mer")).distinct()
        front, step = written(ahead.join(good, ["set_id", "mer"], "left_anti"), "front"), step + 1
    found = lengths[0] if lengths else ok.limit(0).select("set_id", F.lit(0).alias("n"))
    for more in lengths[1:]:
        found = found.union(more)
    best = found.groupBy("set_id").agg(F.max("n").alias("n"))
    longest = F.when(F.col("decycling"), F.coalesce("n", F.lit(0))).otherwise(F.lit(space.size)).cast("bigint")
    return ok.join(best, "set_id", "left").select("set_id", "decycling", longest.alias("longest"))


def shortest_path(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, shortest): nodes from the head of a possible F-move to the first node all of whose successors are in
    the set, breadth first; null if there is none."""
    from .moves import possible_fmoves

    heads = possible_fmoves(space, rows).select("set_id", F.explode(space.right_companions("fm")).alias("mer"))
    front = written(heads.distinct(), "front")
    seen, step, found = front, 1, None
    inside = rows.select("set_id", "mer").distinct()
    while front.limit(1).count():
        out = front.select("set_id", "mer", F.explode(space.successors("mer")).alias("next"))
        free = out.join(inside.withColumnRenamed("mer", "next"), ["set_id", "next"], "left_anti")
        done = front.join(free, ["set_id", "mer"], "left_anti").select("set_id").distinct().withColumn("n", F.lit(step))
        found = done if found is None else found.union(done)
        ahead = free.select("set_id", F.col("next").alias("mer")).distinct()
        front = written(ahead.join(seen, ["set_id", "mer"], "left_anti"), "front")
        seen, step = written(seen.union(front), "seen"), step + 1
    if found is None:  # no set has a possible F-move
        found = front.select("set_id", F.lit(step).alias("n"))
    best = found.groupBy("set_id").agg(F.min("n").alias("n"))
    return rows.select("set_id").distinct().join(best, "set_id", "left").select("set_id", F.col("n").cast("bigint").alias("shortest"))


__all__ = ["edges", "edges_outside", "effective", "is_decycling", "longest_path", "reachable", "scc", "scc_by_joins", "scc_counts", "shortest_path", "with_reverse_complements"]
