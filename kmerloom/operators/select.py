"""The n smallest of many values without sorting them: by counts of prefixes, then a short tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits told apart in one pass, and rows of a tail that is sorted.
STEP, TAIL = 12, 4096


def smallest(rows: DataFrame, n: int, *, value: str, tie: str, bits: int = 63, tail: int = TAIL) -> DataFrame:
    """The ``n`` rows with the smallest ``value`` (a long from 0 up, below 2**bits), of equal ones the smaller ``tie`` first; all rows if there are fewer.

    Each pass counts the values of one range by their next ``STEP`` bits (a row for each prefix, at most 2**STEP), until the prefix that the n-th value
    lies in has ``tail`` rows or fewer; only these are sorted. Values that tie in all their bits are told apart by ``tie`` the same way
    (a long from 0 up), so no task sorts more than the tail. ``rows`` is read once a pass; make it a table first where it is costly.
    """
    whole, left = None, rows
    for column in (value, tie):
        low, width = 0, bits
        while True:
            inside = left.where((F.col(column) >= low) & (F.col(column) < low + (1 << width)))
            step = min(STEP, width)
            counts = sorted((r["prefix"], r["count"]) for r in inside.groupBy(F.shiftright(column, width - step).alias("prefix")).count().collect())
            taken = 0
            for prefix, count in counts:
                if taken + count > n:
                    break
                taken += count
            else:
                return inside if whole is None else whole.union(inside)
            n, high = n - taken, prefix << (width - step)
            before = inside.where(F.col(column) < high)
            whole = before if whole is None else whole.union(before)
            low, width = high, width - step
            if not n:
                return whole
            if count <= tail or not width:
                break
        left = left.where((F.col(column) >= low) & (F.col(column) < low + (1 << width)))
        if count <= tail:
            break
    return whole.union(left.orderBy(value, tie).limit(n))
