"""Sets of words as bits: 64 words to a row (``slot``, ``bits``), so that set algebra is a join of slots and sizes are counted bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.kspace import KmerSpace


def bits_of(mers: DataFrame, mer: str = "mer") -> DataFrame:
    """(slot, bits) of a table of words."""
    bit = F.expr(f"shiftleft(cast(1 as bigint), cast(`{mer}` & 63 as int))")
    return mers.where(F.col(mer).isNotNull()).groupBy(F.shiftright(mer, 6).alias("slot")).agg(F.bit_or(bit).alias("bits"))


def text_bits(rows: DataFrame, space: KmerSpace, *, text: str = "text", alphabet: str = "acgt", lower: bool = True, canonical: bool = False) -> DataFrame:
    """(slot, bits) of the words that occur in a column of text. A batch sends each of its slots once."""
    table = arrays.symbol_table(alphabet, lower)

    def tasks(batches):
        for batch in arrays.batches_of(batches, "text"):
            digits = arrays.digits_of(batch.column("text"), table)
            places, _ = arrays.word_places(digits, space.k)
            mers = arrays.codes(digits.values, space.k, space.alpha)[places]
            if canonical:
                mers = np.minimum(mers, arrays.complement_codes(digits.values, space.k, space.alpha)[places])
            mers = np.unique(mers)
            slots, at = np.unique(mers >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (mers & 63).astype(np.uint64)), at) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    found = rows.select(F.col(text).alias("text")).mapInArrow(tasks, "slot long, bits long")
    return found.groupBy("slot").agg(F.bit_or("bits").alias("bits"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words of two sets."""
    joined = a.join(b.withColumnRenamed("bits", "other"), "slot")
    return joined.select("slot", F.col("bits").bitwiseAND(F.col("other")).alias("bits")).where("bits <> 0")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words of one set or the other."""
    return a.unionByName(b).groupBy("slot").agg(F.bit_or("bits").alias("bits"))


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words of ``a`` that are not in ``b``."""
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("other", F.lit(0).cast("bigint"))))
    return a.join(b.withColumnRenamed("bits", "other"), "slot", "left").select("slot", rest.alias("bits")).where("bits <> 0")


def mers_of(bits: DataFrame) -> DataFrame:
    """(mer): the words of a set."""
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("bits").bitwiseAND(_bit(i)) != 0)
    return bits.select("slot", F.explode(held).alias("i")).select((F.col("slot") * 64 + F.col("i")).alias("mer"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def closed(space: KmerSpace, bits: DataFrame) -> DataFrame:
    """The words of a set and their reverse complements."""
    mers = mers_of(bits)
    return either(bits, bits_of(mers.select(space.reverse_complement("mer").alias("mer"))))


def under_mode(space: KmerSpace, words: DataFrame, chosen: DataFrame, mode: str) -> DataFrame:
    """The ``words`` (a set) that a set takes under a mode: by themselves, by their canonical form, or by either strand."""
    if mode == "straight":
        return both(words, chosen)
    if mode == "union":
        return both(words, closed(space, chosen))
    if mode == "canonical":
        own = mers_of(chosen)
        return both(words, closed(space, bits_of(own.where(F.col("mer") == space.canonical("mer")))))
    raise ValueError(f"no such mode: {mode}")


def size(bits: DataFrame) -> Column:
    """Aggregate: the number of words."""
    return F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint")
