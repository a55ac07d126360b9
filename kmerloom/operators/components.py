"""Minimum decycling sets as nodes: F-move layers, components and the graph between components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kspace import KmerSpace
from ..shared import written
from .graph import is_decycling
from .moves import as_rows, fmove, fmove_edges, fmove_order, fmoves_of, rfmove, rfmoves_of, signatures


def exhaustive(spark: SparkSession, space: KmerSpace) -> DataFrame:
    """(set_id, mers): every minimum decycling set. One word of each register is chosen, heaviest registers first; after each
    register the choices with a cycle among the words already passed over are dropped, before they multiply."""
    registers = (
        space.universe(spark).groupBy(space.pcr("mer").alias("pcr"))
        .agg(F.array_sort(F.collect_list("mer")).alias("words"), F.max(space.weight("mer")).alias("weight"))
        .orderBy(F.desc("weight"), "pcr").collect()
    )
    partial = spark.createDataFrame([([], [])], "mers array<bigint>, passed array<bigint>")
    for r in registers:
        words = F.array(*[F.lit(w).cast("bigint") for w in r["words"]])
        chosen = partial.withColumn("one", F.explode(words))
        partial = chosen.select(
            F.concat("mers", F.array("one")).alias("mers"),
            F.concat("passed", F.array_except(words, F.array("one"))).alias("passed"),
        )
        partial = _acyclic(space, written(partial, "choices"))
    keyed = partial.select(F.array_sort("mers").alias("mers")).distinct()
    return keyed.select(F.xxhash64(F.to_json("mers")).alias("set_id"), "mers")


def _acyclic(space: KmerSpace, choices: DataFrame) -> DataFrame:
    """Choices whose passed-over words span no cycle, by peeling words without a predecessor among them, inside the row."""

    def peel(alive):
        fed = F.flatten(F.transform(alive, space.successors))
        return F.array_intersect(alive, fed)

    state = choices.withColumn("alive", F.col("passed")).withColumn("before", F.lit(-1))
    while True:
        state = written(state.select("mers", "passed", peel(F.col("alive")).alias("alive"), F.size("alive").alias("before")), "peel")
        if not state.where((F.size("alive") > 0) & (F.size("alive") < F.col("before"))).limit(1).count():
            return state.where(F.size("alive") == 0).select("mers", "passed")


def first_layer(space: KmerSpace, start: DataFrame) -> DataFrame:
    """(mers): the sets from which all F-moves and then all RF-moves lead back into the layer, from the sets of ``start``."""
    layer = written(start.select("mers").distinct(), "layer")
    while True:
        ahead = layer.select(F.explode(fmoves_of(space, "mers")).alias("fm"), "mers").select(fmove(space, "mers", "fm").alias("mers")).distinct()
        back = ahead.select(F.explode(rfmoves_of(space, "mers")).alias("fm"), "mers").select(rfmove(space, "mers", "fm").alias("mers")).distinct()
        new = written(back.join(layer, "mers", "left_anti"), "layer")
        if not new.limit(1).count():
            return layer
        layer = written(layer.union(new), "layer")


def layers(space: KmerSpace, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (layer, mers) of the layers that follow the first, one for each F-move, and edges (layer, src, dst, fm); the
    last layer's edges close on layer 0."""
    layer = first_layer(space, start)
    nodes, links = [], []
    for i in range(space.fmoves):
        out = written(fmove_edges(space, layer), "edges")
        nodes.append(layer.select(F.lit(i).alias("layer"), "mers"))
        links.append(out.select(F.lit(i).alias("layer"), "src", "dst", "fm"))
        layer = out.select(F.col("dst").alias("mers")).distinct()
    all_nodes, all_links = nodes[0], links[0]
    for n, e in zip(nodes[1:], links[1:], strict=True):
        all_nodes, all_links = all_nodes.union(n), all_links.union(e)
    return all_nodes, all_links


def fmove_ranges(links: DataFrame) -> DataFrame:
    """(fm, first, last): runs of consecutive layers in which an F-move occurs."""
    once = links.select("fm", "layer").distinct()
    w = Window.partitionBy("fm").orderBy("layer")
    island = once.withColumn("island", F.col("layer") - F.row_number().over(w))
    return island.groupBy("fm", "island").agg(F.min("layer").alias("first"), F.max("layer").alias("last")).select("fm", "first", "last")


def layer_report(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: n_layers, sets in all, the least and greatest width of a layer, and how long F-moves stay possible at least and at most."""
    widths = nodes.groupBy("layer").agg(F.count("*").alias("width"))
    wide = widths.agg(F.count("*").alias("n_layers"), F.sum("width").alias("n_sets"), F.min("width").alias("least_width"), F.max("width").alias("most_width"))
    length = F.col("last") - F.col("first") + 1
    return wide.join(fmove_ranges(links).agg(F.min(length).cast("bigint").alias("shortest_range"), F.max(length).cast("bigint").alias("longest_range")), F.lit(True))


def across(space: KmerSpace, crossings: DataFrame, orders: DataFrame) -> DataFrame:
    """(src, fm, mask, mers): the set on the other side of each I-move of ``crossings`` (set_id, fm, mask).

    ``orders`` (set_id, fmoves) has an order of all F-moves of each set; time is counted from ``fm`` on, around the order. A word
    that a move puts in place is taken on by one move, the next on its register. Moves that follow in this way from the unmasked
    right companions belong to the new set. The rest is late: what happens before the masked left companions have come round comes after
    everything else. The set is what this sequence leaves, the last move that touches a word deciding.
    """
    n = space.fmoves
    timed = orders.select("set_id", F.posexplode("fmoves").alias("pos", "f"))
    start = timed.withColumnsRenamed({"f": "fm", "pos": "from"})
    moves = crossings.select("set_id", "fm", "mask").distinct().join(start, ["set_id", "fm"]).join(timed, "set_id")
    moves = written(moves.select("set_id", "fm", "mask", "f", F.pmod(F.col("pos") - F.col("from"), F.lit(n)).alias("t")), "timed")
    key = ["set_id", "fm", "mask"]
    bases = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(space.alpha - 1).cast("bigint"))).alias("b")
    placed = crossings.select(*key, bases).distinct().withColumn("word", F.col("fm") * space.alpha + F.col("b"))
    masked = F.expr("shiftright(mask, cast(b AS int)) & 1 = 1")
    placed = placed.where(~masked).select(*key, "word")

    def next_moves(words: DataFrame, t) -> DataFrame:
        on = words.where(~space.is_homopolymer("word")).select(*key, space.suffix("word").alias("f"), t.alias("after"))
        return on.join(moves, [*key, "f"]).where("t > after").select(*key, "f", "t").distinct()

    follows = written(next_moves(placed, F.lit(0)), "follows")
    front = follows
    while not front.isEmpty():
        words = front.select(*key, "t", F.explode(space.right_companions("f")).alias("word"))
        front = written(next_moves(words, F.col("t")).join(follows, [*key, "f"], "left_anti"), "follows")
        follows = written(follows.union(front), "follows")
    round_words = crossings.select(*key, bases).distinct().where(masked).select(*key, space.prefix(F.col("fm") + F.col("b") * n).alias("f"))
    until = round_words.join(moves, [*key, "f"]).groupBy(*key).agg(F.max("t").alias("until"))
    sequence = moves.join(follows.withColumn("own", F.lit(True)).drop("t"), [*key, "f"], "left").join(until, key).where("t > 0")
    late = (F.col("t") <= F.col("until")) & F.col("own").isNull()
    steps = sequence.select(*key, F.when(late, F.col("t") + n).otherwise(F.col("t")).alias("pos"), "f")
    touched = steps.select(
        *key, "pos", F.explode(F.concat(
            F.transform(space.left_companions("f"), lambda m: F.struct(m.alias("word"), F.lit(0).alias("there"))),
            F.transform(space.right_companions("f"), lambda m: F.struct(m.alias("word"), F.lit(1).alias("there"))),
        )).alias("x"),
    ).select(*key, "pos", "x.word", "x.there")
    homopolymers = F.explode(F.array(*[F.lit(b * ((space.size - 1) // (space.alpha - 1))).cast("bigint") for b in range(space.alpha)])).alias("word")
    begun = placed.union(crossings.select(*key, homopolymers).distinct()).select(*key, F.lit(-1).alias("pos"), "word", F.lit(1).alias("there"))
    left = touched.union(begun).groupBy(*key, "word").agg(F.max_by("there", F.struct("pos", "there")).alias("there")).where("there = 1")
    return left.groupBy(*key).agg(F.array_sort(F.collect_list("word")).alias("mers")).withColumnRenamed("set_id", "src")


def traverse(space: KmerSpace, start: DataFrame, *, most_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Components reachable over I-moves from the sets of ``start`` (column mers): nodes (comp_id, mers, signature) and
    edges (src, dst, fm, mask). Components are numbered by round, then by signature."""
    keyed = start.select(F.xxhash64(F.to_json("mers")).alias("set_id"), "mers").distinct()

    def described(sets: DataFrame) -> DataFrame:
        sets = written(sets, "sets")
        signed = sets.join(signatures(space, as_rows(sets)), "set_id")
        one = signed.groupBy("signature").agg(F.min("mers").alias("mers"))
        return written(one.select(F.xxhash64(F.to_json("signature")).alias("comp"), "mers", "signature"), "components")

    front = described(keyed)
    seen, raw, rounds = front.withColumn("round", F.lit(0)), None, 0
    while front.limit(1).count() and rounds < most_rounds:
        rounds += 1
        orders = fmove_order(space, front.select(F.col("comp").alias("set_id"), "mers"))
        crossings = front.select("comp", F.explode("signature").alias("im")).select(F.col("comp").alias("set_id"), "im.fm", "im.mask")
        crossed = written(across(space, crossings, orders).withColumn("set_id", F.xxhash64(F.to_json("mers"))), "crossed")
        sets = crossed.select("set_id", "mers").distinct()
        named = signatures(space, as_rows(sets)).withColumn("comp", F.xxhash64(F.to_json("signature")))
        named = written(named.join(sets, "set_id"), "named")
        links = crossed.join(named.select("set_id", F.col("comp").alias("dst")), "set_id").select("src", "dst", "fm", "mask")
        raw = links if raw is None else raw.union(links)
        fresh = named.join(seen, "comp", "left_anti").groupBy("comp", "signature").agg(F.min("mers").alias("mers"))
        front = written(fresh.select("comp", "mers", "signature"), "front")
        seen = written(seen.union(front.withColumn("round", F.lit(rounds))), "seen")
    number = F.row_number().over(Window.orderBy("round", "signature")) - 1
    nodes = seen.withColumn("comp_id", number).select("comp_id", "comp", "mers", "signature")
    nodes = written(nodes, "nodes")
    a, b = nodes.select(F.col("comp").alias("src"), F.col("comp_id").alias("s")), nodes.select(F.col("comp").alias("dst"), F.col("comp_id").alias("d"))
    links = raw.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "fm", "mask")
    return nodes.drop("comp"), links


__all__ = ["across", "exhaustive", "first_layer", "fmove_ranges", "is_decycling", "layers", "traverse"]
