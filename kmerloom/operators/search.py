"""Randomised searches, one task for each seed: decycling sets, canonical reduction, long or short remaining paths."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kspace import KmerSpace
from ..shared import dropped, written
from .components import across
from .moves import as_rows, fmove, fmove_order, fmoves_of, imoves
from .sets import generate, in_mykkeltveit
from .sketch import bound

MOST_NODES = 1 << 16


def seeds(spark: SparkSession, n: int | DataFrame, first: int = 0) -> DataFrame:
    """(seed): ``n`` successive numbers from ``first`` on, or the column seed of a table, such as ``fresh_seeds`` or ``sources.text.read_seeds``."""
    if isinstance(n, DataFrame):
        return n.select(F.col("seed").cast("bigint").alias("seed")).distinct()
    return spark.range(first, first + n, 1, n).withColumnRenamed("id", "seed")


def fresh_seeds(spark: SparkSession, n: int) -> DataFrame:
    """(seed): ``n`` new random seeds, drawn once into a table so that every reader sees the same ones."""
    return written(spark.range(n).select(F.xxhash64("id", F.expr("uuid()")).alias("seed")), "seeds")


def _neighbours(space: KmerSpace, m: int) -> Iterator[int]:
    return (m % space.fmoves * space.alpha + b for b in range(space.alpha))


def random_decycling_sets(spark: SparkSession, space: KmerSpace, n: int | DataFrame, first_seed: int = 0, *, steps: int | None = None, crossings: int = 0) -> DataFrame:
    """(seed, mers): a minimum decycling set for each seed, by random F-moves from the Mykkeltveit set.

    A move keeps a set minimum and decycling, so nothing is drawn in vain and the number of ``steps`` (by default four rounds of all
    F-moves, and up to one more by the seed) bounds the time. Each step takes one of the possible moves by a hash of the seed and the step's number.
    F-moves stay inside a component; each of the ``crossings`` goes over to another one by a random mixed move, and walks on there.
    """
    begin = generate(spark, space, in_mykkeltveit(space, F.col("mer"))).agg(F.array_sort(F.collect_list("mer")).alias("mers"))
    count = 4 * space.fmoves if steps is None else steps

    def walk(found: DataFrame, done: int) -> DataFrame:
        def step(mers: Column, i: Column) -> Column:
            def moved(possible: Column) -> Column:
                chosen = F.element_at(possible, (F.pmod(F.xxhash64("seed", i), F.size(possible)) + 1).cast("int"))
                return F.when(F.size(possible) > 0, fmove(space, mers, chosen)).otherwise(mers)

            return bound(fmoves_of(space, mers), moved)

        if not count:
            return found.select("seed", "mers")
        last = F.lit(count) + F.pmod(F.xxhash64("seed"), F.lit(space.fmoves)).cast("int")  # walks of one length can all end in one layer
        return found.select("seed", F.aggregate(F.sequence(F.lit(1), last), F.col("mers"), lambda mers, i: step(mers, i + done)).alias("mers"))

    found = walk(seeds(spark, n, first_seed).join(begin, F.lit(True)), 0)
    for turn in range(crossings):
        found = walk(crossed(space, found, turn), (turn + 1) * (count + space.fmoves))
    return found


def crossed(space: KmerSpace, found: DataFrame, turn: int = 0) -> DataFrame:
    """(seed, mers): the set on the other side of one mixed move of each minimum decycling set (seed, mers), for all seeds at once.

    The move is chosen by a hash of the seed, the turn and the move; a set that has none stays as it is.
    """
    here = written(found.select(F.col("seed").alias("set_id"), "mers"), "walkers")
    turns = F.struct(F.xxhash64("set_id", F.lit(turn), "fm", "mask").alias("turn"), "fm", "mask")
    chosen = imoves(space, as_rows(here)).groupBy("set_id").agg(F.min(turns).alias("m"))
    chosen = written(chosen.select("set_id", "m.fm", "m.mask"), "crossings")
    there = across(space, chosen, fmove_order(space, here.join(chosen, "set_id", "left_semi"))).select(F.col("src").alias("set_id"), F.col("mers").alias("there"))
    out = written(here.join(there, "set_id", "left").select(F.col("set_id").alias("seed"), F.coalesce("there", "mers").alias("mers")), "crossed")
    dropped(here, chosen)
    return out


def _closes_cycle(space: KmerSpace, words: Column, taken: Column) -> Column:
    """Whether some of the free ``words`` (an array) lies on a cycle of free nodes: the nodes that each reaches are gathered step by step, in the row."""

    def reaches_itself(m: Column) -> Column:
        nodes = F.array().cast("array<bigint>")
        begin = F.struct(nodes.alias("seen"), F.array(m).alias("front"))

        def step(state: Column, _: Column) -> Column:
            ahead = F.array_except(F.array_distinct(F.flatten(F.transform(state["front"], space.successors))), F.concat(taken, state["seen"]))
            return F.struct(F.concat(state["seen"], ahead).alias("seen"), ahead.alias("front"))

        seen = F.aggregate(F.sequence(F.lit(1), F.lit(space.size)), begin, lambda s, i: F.when(F.size(s["front"]) > 0, step(s, i)).otherwise(s), lambda s: s["seen"])
        return F.array_contains(seen, m)

    return F.exists(words, reaches_itself)


def reduce_under_complement(spark: SparkSession, space: KmerSpace, mers: DataFrame, n: int | DataFrame, *, keep_canonical: bool = False, first_seed: int = 0) -> DataFrame:
    """(seed, removed, mers): the words (column mer) that each seed keeps when pairs of a word and its reverse complement are dropped, in an order of
    the seed's, as long as what stays with its complements is decycling.

    The unit is the pair: it is decided once, for both words. With ``keep_canonical`` a pair whose canonical word is in the set stays.
    """
    if space.size > MOST_NODES:
        raise ValueError("the space is too large for one row a seed")
    both = F.array_distinct(F.array("canonical", space.reverse_complement("canonical")))
    pairs = mers.select("mer", space.canonical("mer").alias("canonical")).groupBy("canonical").agg(F.array_sort(F.collect_set("mer")).alias("own")).withColumn("both", both)
    may = ~F.array_contains("own", F.col("canonical")) if keep_canonical else F.lit(True)
    each = F.struct(F.xxhash64("canonical", "seed").alias("turn"), "canonical", "own", "both", may.alias("may"))
    listed = pairs.join(seeds(spark, n, first_seed), F.lit(True)).groupBy("seed").agg(F.array_sort(F.collect_list(each)).alias("pairs"))
    union = F.flatten(F.transform("pairs", lambda p: p["both"]))
    state = F.struct(union.alias("taken"), F.array().cast("array<bigint>").alias("gone"))

    def decide(s: Column, p: Column) -> Column:
        without = F.array_except(s["taken"], p["both"])
        dropped = F.struct(without.alias("taken"), F.concat(s["gone"], F.array(p["canonical"])).alias("gone"))
        return F.when(p["may"] & ~_closes_cycle(space, p["both"], without), dropped).otherwise(s)

    done = listed.withColumn("gone", F.aggregate("pairs", state, decide, lambda s: s["gone"]))
    kept = F.filter("pairs", lambda p: ~F.array_contains("gone", p["canonical"]))
    return done.select("seed", F.size("gone").cast("bigint").alias("removed"), F.array_sort(F.flatten(F.transform(kept, lambda p: p["own"]))).alias("mers"))


def _longest(space: KmerSpace, taken: set[int]) -> int:
    front, length = set(range(space.size)) - taken, 0
    while front:
        length += 1
        front = {n for m in front for n in _neighbours(space, m) if n not in taken}
    return length


def anneal_path(spark: SparkSession, space: KmerSpace, mers: list[int], n: int | DataFrame, *, iterations: int = 200, cooling: float = 0.99, shortest: bool = True, first_seed: int = 0) -> DataFrame:
    """(seed, path, mers): the best remaining path that simulated annealing over random F-moves finds from a decycling set.

    A worse set is accepted with probability exp(-loss / temperature), the usual rule.
    """

    def kernel(batches):
        for pdf in batches:
            out = []
            for seed in pdf["seed"]:
                rng, now, heat = random.Random(int(seed)), set(mers), 1.0
                score = best_score = _longest(space, now)
                best = set(now)
                for _ in range(iterations):
                    ready = sorted(f for f in {m % space.fmoves for m in now} if all(f + b * space.fmoves in now for b in range(space.alpha)))
                    if not ready:
                        break
                    f = rng.choice(ready)
                    new = now - {f + b * space.fmoves for b in range(space.alpha)} | {f * space.alpha + b for b in range(space.alpha)}
                    other = _longest(space, new)
                    loss = (other - score) if shortest else (score - other)
                    if loss <= 0 or rng.random() < math.exp(-loss / heat):
                        now, score = new, other
                        if (score < best_score) if shortest else (score > best_score):
                            best, best_score = set(now), score
                    heat = max(1e-6, heat * cooling)
                out.append((int(seed), best_score, sorted(best)))
            yield pd.DataFrame(out, columns=["seed", "path", "mers"])

    return seeds(spark, n, first_seed).mapInPandas(kernel, "seed long, path long, mers array<bigint>")


def best_of(found: DataFrame, *, shortest: bool = True) -> DataFrame:
    """The seed, path and set with the shortest (longest) path; ties keep the first seed."""
    key = F.struct("path", "seed") if shortest else F.struct((-F.col("path")).alias("p"), "seed")
    return found.agg(F.min_by(F.struct("seed", "path", "mers"), key).alias("b")).select("b.*")
