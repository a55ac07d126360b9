"""F-moves, RF-moves and I-moves on sets of mers: rows (set_id, mer), or sorted arrays ``mers``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kspace import KmerSpace, col
from ..shared import written


def as_rows(sets: DataFrame) -> DataFrame:
    return sets.select("set_id", F.explode("mers").alias("mer"))


def as_arrays(rows: DataFrame) -> DataFrame:
    return rows.groupBy("set_id").agg(F.array_sort(F.collect_set("mer")).alias("mers"))


def possible_fmoves(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, fm) whose left companions are all in the set."""
    by = rows.select("set_id", "mer").distinct().groupBy("set_id", space.suffix("mer").alias("fm")).agg(F.count("*").alias("n"))
    return by.where(F.col("n") == space.alpha).select("set_id", "fm")


def possible_rfmoves(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, fm) whose right companions are all in the set."""
    by = rows.select("set_id", "mer").distinct().groupBy("set_id", space.prefix("mer").alias("fm")).agg(F.count("*").alias("n"))
    return by.where(F.col("n") == space.alpha).select("set_id", "fm")


def fmove(space: KmerSpace, mers, fm) -> Column:
    """The array after a move: the left companions of ``fm`` give way to its right companions."""
    return F.array_sort(F.array_union(F.array_except(col(mers), space.left_companions(fm)), space.right_companions(fm)))


def rfmove(space: KmerSpace, mers, fm) -> Column:
    return F.array_sort(F.array_union(F.array_except(col(mers), space.right_companions(fm)), space.left_companions(fm)))


def fmoves_of(space: KmerSpace, mers) -> Column:
    """Possible F-moves of an array-valued set, sorted."""
    m = col(mers)
    ends = F.array_sort(F.array_distinct(F.transform(m, space.suffix)))
    return F.filter(ends, lambda f: reduce(Column.__and__, [F.array_contains(m, f + b * space.fmoves) for b in range(space.alpha)]))


def rfmoves_of(space: KmerSpace, mers) -> Column:
    m = col(mers)
    ends = F.array_sort(F.array_distinct(F.transform(m, space.prefix)))
    return F.filter(ends, lambda f: reduce(Column.__and__, [F.array_contains(m, f * space.alpha + b) for b in range(space.alpha)]))


def classify_fmoves(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, fm, n_left, n_right, kind): F if all left companions are there, RF if all right ones, I if together
    they make a mixed move (as many as the alphabet), else none; fm appears if any companion is in the set."""
    left = rows.select("set_id", space.suffix("mer").alias("fm"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    right = rows.select("set_id", space.prefix("mer").alias("fm"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    n = left.union(right).groupBy("set_id", "fm").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    extra = F.when(space.is_homopolymer_fmove("fm"), 1).otherwise(0)
    kind = (
        F.when(F.col("n_left") == space.alpha, "F")
        .when(F.col("n_right") == space.alpha, "RF")
        .when(F.col("n_left") + F.col("n_right") == space.alpha + extra, "I")
        .otherwise("none")
    )
    return n.withColumn("kind", kind)


def companion_mask(space: KmerSpace, mers, fm) -> Column:
    """Bits of the bases whose left companion of ``fm`` is in the array-valued set."""
    m = col(mers)
    return reduce(Column.__add__, [F.when(F.array_contains(m, col(fm) + b * space.fmoves), 1 << b).otherwise(0) for b in range(space.alpha)])


def completeness(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, fm, kind) of every F-move: ``complete`` with all its left companions in the set, ``incomplete`` with some, ``no`` with none."""
    held = rows.select("set_id", "mer").distinct().groupBy("set_id", space.suffix("mer").alias("fm")).agg(F.count("*").alias("n"))
    every = rows.select("set_id").distinct().select("set_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(space.fmoves - 1).cast("bigint"))).alias("fm"))
    kind = F.when(F.col("n") == space.alpha, "complete").when(F.col("n") > 0, "incomplete").otherwise("no")
    return every.join(held, ["set_id", "fm"], "left").select("set_id", "fm", kind.alias("kind"))


def moved_word(space: KmerSpace, mers, mer, *, back: bool = False) -> Column:
    """The array with one of its words gone on (or back) by one place on its register."""
    other = space.rotate_prev(mer) if back else space.rotate_next(mer)
    return F.array_sort(F.array_distinct(F.concat(F.array_remove(col(mers), col(mer)), F.array(other))))


def random_word(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(set_id, mer): one word of each set, by a hash of the word and the seed."""
    return rows.groupBy("set_id").agg(F.min_by("mer", F.struct(F.xxhash64("mer", F.lit(seed)), "mer")).alias("mer"))


def fmoves_to_set(space: KmerSpace, lists: DataFrame) -> DataFrame:
    """(list_id, mer) after replaying moves (list_id, pos, fm) from nothing: the last move that touches a mer decides."""
    companions = F.flatten(F.array(
        F.transform(space.left_companions("fm"), lambda m: F.struct(m.alias("mer"), F.lit(0).alias("state"))),
        F.transform(space.right_companions("fm"), lambda m: F.struct(m.alias("mer"), F.lit(1).alias("state"))),
    ))
    touched = lists.select("list_id", "pos", F.explode(companions).alias("t")).select("list_id", "pos", "t.mer", "t.state")
    last = touched.groupBy("list_id", "mer").agg(F.max_by("state", F.struct("pos", "state")).alias("state"))
    return last.where("state = 1").select("list_id", "mer")


def fmove_order(space: KmerSpace, sets: DataFrame) -> DataFrame:
    """(set_id, fmoves): an order in which every F-move can be done once, from each array-valued set (set_id, mers).

    Each round does all moves that are possible and not yet done, for all sets at once. Fewer than
    alpha**(k-1) moves mean that the set is not a decycling one.
    """
    state = written(sets.select("set_id", "mers", F.array().cast("array<bigint>").alias("fmoves")), "order")
    while True:
        ready = F.array_except(fmoves_of(space, "mers"), F.col("fmoves"))
        moved = state.select("set_id", "mers", "fmoves", ready.alias("ready"))
        after = F.aggregate("ready", F.col("mers"), lambda acc, f: fmove(space, acc, f))
        moved = written(moved.select("set_id", after.alias("mers"), F.concat("fmoves", "ready").alias("fmoves"), (F.size("ready") > 0).alias("moved")), "order")
        state = moved.select("set_id", "mers", "fmoves")
        if not moved.where("moved").limit(1).count():
            return state.select("set_id", "fmoves")


def fmove_edges(space: KmerSpace, sets: DataFrame) -> DataFrame:
    """(src, dst, fm): F-moves between array-valued sets (column ``mers``)."""
    each = sets.select(F.col("mers").alias("src"), F.explode(fmoves_of(space, "mers")).alias("fm"))
    return each.select("src", fmove(space, "src", "fm").alias("dst"), "fm")


def constrained_edges(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, fm, i, j): edges from left companion i to right companion j != i that lie on a cycle through exactly
    one member of the set: some member reaches the one, and is reached from the other, outside the set."""
    members = rows.select("set_id", "mer").distinct()

    def closure(step) -> DataFrame:
        found = written(members.select("set_id", F.col("mer").alias("s"), F.col("mer").alias("m")), "reach")
        front = found
        while True:
            ahead = front.select("set_id", "s", F.explode(step("m")).alias("m")).distinct()
            ahead = ahead.join(members, (ahead.set_id == members.set_id) & (ahead.m == members.mer), "left_anti")
            front = written(ahead.join(found, ["set_id", "s", "m"], "left_anti"), "reach")
            if not front.limit(1).count():
                return found
            found = written(found.union(front), "reach")

    forth = closure(space.successors).select("set_id", "s", F.col("m").alias("u"))
    back = closure(space.predecessors).select("set_id", "s", F.col("m").alias("v"))
    out = forth.select("set_id", "s", "u", space.suffix("u").alias("fm"), space.left_base("u").alias("i"))
    into = back.select("set_id", "s", space.prefix("v").alias("fm"), space.right_base("v").alias("j"))
    return out.join(into, ["set_id", "s", "fm"]).where("i <> j").select("set_id", "fm", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).distinct()


def imoves(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, fm, mask): mixed moves, those with no constrained edge from a masked base to one outside the mask.

    For the homopolymer of base b, masks that hold b alone, or all but b, are no moves between components.
    """
    spark = rows.sparkSession
    a = space.alpha
    masks = [(m, i, j) for m in range(1, 2**a - 1) for i in range(a) for j in range(a) if m >> i & 1 and not m >> j & 1]
    forbidden = F.broadcast(spark.createDataFrame(masks, "mask int, i int, j int"))
    every = (
        rows.select("set_id").distinct()
        .select("set_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(space.fmoves - 1).cast("bigint"))).alias("fm"))
        .select("set_id", "fm", F.explode(F.sequence(F.lit(1), F.lit(2**a - 2))).alias("mask"))
    )
    base = F.pow(F.lit(2), (F.col("fm") % a)).cast("int")
    full = 2**a - 1
    degenerate = space.is_homopolymer_fmove("fm") & ((F.col("mask") == base) | (F.col("mask") == F.lit(full) - base))
    hit = constrained_edges(space, rows).join(forbidden, ["i", "j"]).select("set_id", "fm", "mask").distinct()
    return every.where(~degenerate).join(hit, ["set_id", "fm", "mask"], "left_anti")


def signatures(space: KmerSpace, rows: DataFrame) -> DataFrame:
    """(set_id, signature): the sorted I-moves of each set, which name its component."""
    found = imoves(space, rows).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("fm", "mask"))).alias("signature"))
    empty = F.array().cast("array<struct<fm:bigint,mask:int>>")
    return rows.select("set_id").distinct().join(found, "set_id", "left").select("set_id", F.coalesce("signature", empty).alias("signature"))
