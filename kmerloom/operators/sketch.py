"""Sequences to k-mers to gap histograms: the sketching workload.

Symbols become digits, k-mers and hits inside the row, so a sequence is never repeated for its positions and
only histogram rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kspace import KmerSpace, col


def symbols(text, alphabet: str, *, on_invalid: str = "drop", lower: bool = False, alpha: int | None = None) -> Column:
    """Digits of a text as an array of ints by the place of each symbol in ``alphabet``.

    White space is skipped. Other symbols outside the alphabet are dropped, or raise (``on_invalid="error"``, with
    the place among the symbols). The symbols of ``alphabet`` differ, and are ``alpha`` in number where that is given.
    """
    if len(set(alphabet)) != len(alphabet) or alpha not in (None, len(alphabet)):
        raise ValueError(f"not an alphabet of {alpha or len(alphabet)} symbols: {alphabet}")
    raw = F.coalesce(col(text), F.lit(""))
    raw = F.lower(raw) if lower else raw
    packed = F.regexp_replace(raw, r"\s+", "")
    keep = "[^" + "".join("\\" + c if c in r"\]^-[&" else c for c in alphabet) + "]"
    if on_invalid == "drop":
        packed = F.regexp_replace(packed, keep, "")
    elif on_invalid == "error":
        bad = F.regexp_instr(packed, F.lit(keep))
        told = F.concat(F.lit("symbol outside the alphabet at "), bad.cast("string"))
        packed = F.when(bad > 0, F.raise_error(told).cast("string")).otherwise(packed)
    else:
        raise ValueError(f"no such rule: {on_invalid}")
    each = F.filter(F.split(packed, ""), lambda c: c != "")
    return F.transform(each, lambda c: F.instr(F.lit(alphabet), c) - 1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def kmers(digits, space: KmerSpace) -> Column:
    """All k-mers of an array of digits, in order; none if it is shorter than k."""

    def all_of(d: Column) -> Column:
        def mer(i: Column) -> Column:
            return reduce(Column.__add__, [F.get(d, i + j).cast("bigint") * space.alpha ** (space.k - 1 - j) for j in range(space.k)])

        places = F.sequence(F.lit(0), F.greatest(F.size(d) - space.k, F.lit(0)))
        return F.when(F.size(d) >= space.k, F.transform(places, mer)).otherwise(F.array().cast("array<bigint>"))

    return bound(col(digits), all_of)


def hit_offsets(mers, predicate: Callable[[Column], Column]) -> Column:
    """Offsets (from 0) of the k-mers that a predicate selects."""
    marked = F.transform(col(mers), lambda m, i: F.when(predicate(m), i))
    return F.filter(marked, lambda i: i.isNotNull())


def gaps(offsets) -> Column:
    """Distance of each hit from the one before; the first counts from offset 0, what follows the last is not counted."""

    def differences(o: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(o, F.lit(1), F.greatest(F.size(o) - 1, F.lit(0))))
        return F.zip_with(o, before, lambda a, b: a - b)

    return bound(col(offsets), differences)


def sketch(sequences: DataFrame, space: KmerSpace, predicate: Callable[[Column], Column], *, digits: str = "digits") -> DataFrame:
    """``sequences`` with n_kmers, n_hits and gaps; ``digits`` holds arrays of ints."""


    def of_hits(n: Column, hits: Column) -> Column:
        return F.struct(n.cast("bigint").alias("n_kmers"), F.size(hits).cast("bigint").alias("n_hits"), gaps(hits).alias("gaps"))

    found = bound(kmers(digits, space), lambda k: bound(hit_offsets(k, predicate), lambda hits: of_hits(F.size(k), hits)))
    return sequences.withColumn("__s", found).select(*sequences.columns, "__s.n_kmers", "__s.n_hits", "__s.gaps")


def histogram(sketched: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """(keys, gap, n) of gaps of at least ``least``."""
    return sketched.select(*keys, F.explode("gaps").alias("gap")).where(F.col("gap") >= least).groupBy(*keys, "gap").agg(F.count("*").alias("n"))


def density(sketched: DataFrame, *keys: str) -> DataFrame:
    """Selected k-mers in all k-mers; null where there are none."""
    total = F.sum("n_kmers")
    return sketched.groupBy(*keys).agg(F.sum("n_hits").alias("n_hits"), total.alias("n_kmers"), F.when(total > 0, F.sum("n_hits") / total).alias("density"))


def weighted_sum(hist: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Total of gap times count, over gaps of at least ``least``."""
    return hist.groupBy(*keys).agg(F.sum(F.when(F.col("gap") >= least, F.col("gap") * F.col("n")).otherwise(0)).alias("weighted_sum"))


def unmappable(hist: DataFrame, *keys: str, threshold: int = 50) -> DataFrame:
    """Total length of stretches without a selected k-mer of at least ``threshold``."""
    return weighted_sum(hist, *keys, least=threshold).withColumnRenamed("weighted_sum", "unmappable")


def describe(values: DataFrame, *keys: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 for a single value), least and greatest over repeats."""
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.min(value).alias("min"), F.max(value).alias("max"))
