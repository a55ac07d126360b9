"""Sketching and decycling sets as tables of one column ``mer``, membership modes and set algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kspace import EPSILON, KmerSpace, col
from ..functions.words import champarnaud_of

MODES = ("straight", "canonical", "union", "union_histo")
#: Sets up to this many rows are sent to every task; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def in_mykkeltveit(space: KmerSpace, m, offset: int = 1) -> Column:
    """Where the embedding crosses the negative x-axis, or, at the origin, the least word of the register."""
    re, im = space.embedding(m, offset)
    _, im_next = space.embedding(space.rotate_next(m), offset)
    origin = (F.abs(re) < EPSILON) & (F.abs(im) < EPSILON)
    axis = (F.abs(im) < EPSILON) & (re < 0)
    crossing = (im < -EPSILON) & (im_next > EPSILON)
    return F.when(origin, col(m) == space.pcr(m)).otherwise(axis | crossing)


def in_champarnaud(space: KmerSpace, m) -> Column:
    return col(m) == champarnaud_of(space, m)


def smers(space: KmerSpace, m, s: int) -> list[Column]:
    return [space.subword(m, i, s) for i in range(space.k - s + 1)]


def min_smer_position(space: KmerSpace, m, s: int, order=None) -> Column:
    """Position from the left of the least s-mer under ``order`` (a Column function); the leftmost wins ties."""
    ranks = F.array(*[order(x) if order else x for x in smers(space, m, s)])
    return (F.array_position(ranks, F.array_min(ranks)) - 1).cast("int")


def in_syncmer(space: KmerSpace, m, s: int, t: int, order=None) -> Column:
    return min_smer_position(space, m, s, order) == t


def in_fraction(space: KmerSpace, m, fraction: float, seed: int, *, order=None) -> Column:
    """About ``fraction`` of all mers, by a hash; 1.0 takes all. With ``order`` (a Column function that permutes the space) exactly that part of them, rounded."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction lies between 0 and 1")
    if order:
        return order(col(m)) < round(fraction * space.size)
    return F.pmod(space.hashed(m, seed), F.lit(1 << 31)) < F.lit(round(fraction * (1 << 31)))


def generate(spark: SparkSession, space: KmerSpace, predicate: Column) -> DataFrame:
    """The mers of the universe for which a predicate over ``mer`` holds."""
    return space.universe(spark).where(predicate)


def fraction_set(spark: SparkSession, space: KmerSpace, *, fraction: float | None = None, size: int | None = None, order: Column | None = None, seed: int = 0) -> DataFrame:
    """Exactly ``size`` mers (or that part of all; by default as many as there are registers), the first in ``order``."""
    from ..functions.kspace import necklace_count

    if fraction is not None and not 0 <= fraction <= 1:
        raise ValueError("fraction lies between 0 and 1")
    n = size if size is not None else round(space.size * fraction) if fraction is not None else necklace_count(space.alpha, space.k)
    if not 0 <= n <= space.size:
        raise ValueError("more mers than there are")
    return space.universe(spark).orderBy(order if order is not None else space.hashed("mer", seed), "mer").limit(n)


def all_mykkeltveit(spark: SparkSession, space: KmerSpace, offsets: Sequence[int] = (1,)) -> DataFrame:
    """(offset, set_id, mers): every choice inside registers at the origin that have more than one word and fewer than k.

    The choices of one register are few (its length), so the product is the feature.
    """
    out: DataFrame | None = None
    u = space.universe(spark).select("mer", space.pcr("mer").alias("pcr"))
    sizes = u.groupBy("pcr").agg(F.array_sort(F.collect_list("mer")).alias("words"))
    for offset in offsets:
        base = generate(spark, space, in_mykkeltveit(space, "mer", offset)).select("mer", space.pcr("mer").alias("pcr"))
        known = base.join(sizes, "pcr")
        repeat = (F.size("words") > 1) & (F.size("words") < space.k)
        re, im = space.embedding("mer", offset)
        free = repeat & (F.abs(re) < EPSILON) & (F.abs(im) < EPSILON)
        fixed = known.where(~free).agg(F.array_sort(F.collect_list("mer")).alias("mers")).first()["mers"]
        choices = [r["words"] for r in known.where(free).orderBy("pcr").select("words").collect()]
        sets = spark.createDataFrame([(fixed,)], "mers array<bigint>")
        for words in choices:
            sets = sets.withColumn("one", F.explode(F.array(*[F.lit(w).cast("bigint") for w in words]))).select(F.concat("mers", F.array("one")).alias("mers"))
        sets = sets.select(F.lit(offset).alias("offset"), F.array_sort("mers").alias("mers"))
        out = sets if out is None else out.union(sets)
    return out


# membership --------------------------------------------------------------------------------------


def with_reverse_complements(space: KmerSpace, mers: DataFrame) -> DataFrame:
    return mers.select("mer").union(mers.select(space.reverse_complement("mer").alias("mer"))).distinct()


def members(space: KmerSpace, table: DataFrame, mers: DataFrame, *, mode: str = "straight", mer: str = "mer", keep: bool = True) -> DataFrame:
    """Rows of ``table`` whose mer is in the set under ``mode`` (``keep=False``: is not).

    straight: the mer; canonical: its canonical form; union: the mer or its reverse complement; union_histo: the mer or
    its canonical form, which misses canonical mers whose reverse complement alone is in the set.
    """
    how = "left_semi" if keep else "left_anti"
    chosen = mers.select(F.col("mer").alias("__m")).distinct()
    if mode == "union":
        chosen = with_reverse_complements(space, mers).withColumnRenamed("mer", "__m")
    small = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = F.broadcast(chosen) if small else chosen
    m = F.col(mer)
    if mode in ("straight", "union"):
        return table.join(chosen, m == F.col("__m"), how)
    if mode == "canonical":
        return table.join(chosen, space.canonical(m) == F.col("__m"), how)
    if mode == "union_histo":
        first = table.join(chosen, m == F.col("__m"), how)
        if not keep:
            return first.join(chosen, space.canonical(m) == F.col("__m"), how)
        rest = table.join(chosen, m == F.col("__m"), "left_anti").join(chosen, space.canonical(m) == F.col("__m"), "left_semi")
        return first.unionByName(rest)
    raise ValueError(f"no such mode: {mode}")


def under_mode(space: KmerSpace, predicate, mode: str):
    """A predicate (Column -> Column) read under a membership mode, with nothing materialised."""
    if mode == "straight":
        return predicate
    if mode == "canonical":
        return lambda m: predicate(space.canonical(m))
    if mode == "union":
        return lambda m: predicate(m) | predicate(space.reverse_complement(m))
    if mode == "union_histo":
        return lambda m: predicate(m) | predicate(space.canonical(m))
    raise ValueError(f"no such mode: {mode}")


# checks and sizes --------------------------------------------------------------------------------


def one_per_register(space: KmerSpace, mers: DataFrame) -> DataFrame:
    """One row: size, registers hit, and whether each register is hit exactly once (necessary for a decycling set)."""
    from ..functions.kspace import necklace_count

    want = necklace_count(space.alpha, space.k)
    by = mers.where(F.col("mer").between(0, space.size - 1)).groupBy(space.pcr("mer").alias("pcr")).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), F.count("*").alias("registers"), ((F.count("*") == want) & (F.coalesce(F.max("n"), F.lit(0)) == 1)).alias("one_per_register"))


def canonicalized_size(space: KmerSpace, mers: DataFrame) -> DataFrame:
    """Size of the set closed under reverse complement if only its canonical mers are kept."""
    rc = space.reverse_complement("mer")
    n = F.when(F.col("mer") == rc, 1).when(F.col("mer") < rc, 2).otherwise(0)
    return mers.agg(F.coalesce(F.sum(n), F.lit(0)).alias("canonicalized_size"))


def union_size(space: KmerSpace, mers: DataFrame) -> DataFrame:
    return with_reverse_complements(space, mers).agg(F.count("*").alias("union_size"))


def mers_of(spark: SparkSession, values: Sequence[int]) -> DataFrame:
    """A set given as numbers."""
    return spark.createDataFrame([(int(v),) for v in values], T.StructType([T.StructField("mer", T.LongType())]))
