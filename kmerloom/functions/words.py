"""Word combinatorics: Lyndon words, factorisations and the division of necklaces, on digit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kspace import KmerSpace, col


def is_lyndon(word) -> Column:
    """Strictly less than each of its proper suffixes."""
    w = col(word)
    return F.when(F.length(w) <= 1, F.length(w) == 1).otherwise(
        F.forall(F.sequence(F.lit(2), F.greatest(F.length(w), F.lit(2))), lambda i: w < F.substring(w, i, F.length(w)))
    )


def is_lyndon_by_prefixes(word) -> Column:
    """The same test as comparisons of equally long prefixes and suffixes; the first difference must favour the prefix."""
    w = col(word)
    n = F.length(w)
    return F.when(n <= 1, n == 1).otherwise(
        F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda j: F.substring(w, F.lit(1), n - j) < F.substring(w, j + 1, n - j))
    )


def main_division(word, k: int) -> Column:
    """(root, power): lengths of l and of l^n in the word's main division l^n u, with l the shortest Lyndon word, |u| < |l|."""
    w, found = col(word), F.lit(None).cast("struct<root:int,power:int>")
    for size in range(k, 0, -1):
        root, power = F.substring(w, 1, size), k // size * size
        fits = is_lyndon(root) & (F.substring(w, 1, power) == F.repeat(root, k // size))
        found = F.when(fits, F.struct(F.lit(size).alias("root"), F.lit(power).alias("power"))).otherwise(found)
    return found


def division_reversed(word, k: int) -> Column:
    """u l^n for a word l^n u."""
    w = col(word)
    power = main_division(w, k)["power"]
    return F.concat(F.substring(w, power + 1, F.lit(k)), F.substring(w, F.lit(1), power))


def inverse_division(word, k: int) -> Column:
    """(rest, root) of a word u l^n with the shortest l, |u| < |l|; lengths of u and l."""
    w, found = col(word), F.lit(None).cast("struct<rest:int,root:int>")
    for size in range(k, 0, -1):
        times, rest = k // size, k % size
        root = F.substring(w, rest + 1, size)
        fits = F.substring(w, rest + 1, k) == F.repeat(root, times)
        found = F.when(fits, F.struct(F.lit(rest).alias("rest"), F.lit(size).alias("root"))).otherwise(found)
    return found


def lyndon_factors(word) -> Column:
    """End positions of the Chen-Fox-Lyndon factors of a word: a factor begins wherever the suffix is less than every one before it."""
    w = col(word)
    suffixes = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, F.length(w)))
    begin = F.struct(F.lit(None).cast("string").alias("least"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, suffix: Column) -> Column:
        less = state["least"].isNull() | (suffix < state["least"])
        starts = F.when(less & (state["at"] > 0), F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"])
        return F.struct(F.when(less, suffix).otherwise(state["least"]).alias("least"), (state["at"] + 1).alias("at"), starts.alias("starts"))

    ends = F.aggregate(suffixes, begin, step, lambda s: F.concat(s["starts"], F.array(s["at"])))
    return F.when(F.length(w) > 0, ends).otherwise(F.array().cast("array<int>"))


def champarnaud_of(space: KmerSpace, m) -> Column:
    """The word that the Champarnaud set takes from the register of ``m``."""
    return space.of_text(division_reversed(space.text(space.pcr(m)), space.k))
