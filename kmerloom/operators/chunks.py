"""Sequences that are longer than a task: records in chunks, joined by a prefix scan over small summaries.

A chunk is worked on where it lies and leaves a summary: its digits' number, its first and last k-1 digits, its first and last hit, and the
gaps inside it. Words and gaps that cross from chunk to chunk come from the summaries alone, which are sorted by ranges of (record, chunk): a task
carries the state of a record from summary to summary, and what is open at the ends of a task (one row each) is closed in order at the end. A record of any
length is spread over tasks, and no task holds more than a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays
from ..functions.arrays import Digits
from ..shared import written
from .scan import Hits

LONG, BYTES = T.LongType(), T.BinaryType()


def cut_texts(rows: DataFrame, key: str, *, text: str = "text", size: int = 1000) -> DataFrame:
    """(key, chunk, text): each text in pieces of about ``size`` bytes, numbered from 0; characters are not cut. A null or empty text is one empty chunk."""
    schema = T.StructType([rows.schema[key], T.StructField("chunk", LONG), T.StructField("text", T.StringType())])

    def tasks(batches):
        for batch in batches:
            names, numbers, parts, held = [], [], [], 0
            for i, value in enumerate(batch.column("text")):
                raw = memoryview((value.as_py() or "").encode())
                at = number = 0
                while at < len(raw) or not number:
                    end = min(len(raw), at + size)
                    while end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end += 1
                    names.append(i)
                    numbers.append(number)
                    parts.append(str(raw[at:end], "utf-8"))
                    held, at, number = held + end - at, end, number + 1
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(names)), pa.array(numbers, pa.int64()), pa.array(parts, pa.string())], names=schema.names)
                        names, numbers, parts, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(names, pa.int64())), pa.array(numbers, pa.int64()), pa.array(parts, pa.string())], names=schema.names)

    return rows.select(key, F.col(text).alias("text")).mapInArrow(tasks, schema)


def summaries(chunks: DataFrame, hits: Hits, k: int, *, key: str, order: str, text: str = "text", alphabet: str = "acgt", lower: bool = True) -> DataFrame:
    """(key, order, digits, head, tail, first, last, gaps, counts) of each chunk: ``gaps`` between hits inside it and how often each occurs."""
    schema = T.StructType([chunks.schema[key], chunks.schema[order], T.StructField("digits", LONG), T.StructField("head", BYTES), T.StructField("tail", BYTES)])
    schema = T.StructType([*schema.fields, *(T.StructField(n, LONG) for n in ("first", "last")), *(T.StructField(n, T.ArrayType(LONG)) for n in ("gaps", "counts"))])
    table = arrays.symbol_table(alphabet, lower)

    def tasks(batches):
        for batch in arrays.batches_of(batches, "text"):
            digits = arrays.digits_of(batch.column("text"), table)
            offset, stretch, _ = hits(digits)
            at, n = digits.first, digits.counts
            raw, short = digits.values.tobytes(), np.minimum(n, k - 1)
            heads = [raw[a : a + m] for a, m in zip(at.tolist(), short.tolist(), strict=True)]
            tails = [raw[z - m : z] for z, m in zip((at + n).tolist(), short.tolist(), strict=True)]
            per = np.bincount(stretch, minlength=len(n))
            upto = np.cumsum(per)
            none = per == 0
            first = np.where(none, 0, offset[np.minimum(upto - per, max(0, len(offset) - 1))]) if len(offset) else 0 * n
            last = np.where(none, 0, offset[np.maximum(upto - 1, 0)]) if len(offset) else 0 * n
            later = np.concatenate(([False], stretch[1:] == stretch[:-1])) if len(offset) else none[:0]
            gap = arrays.gaps_of(offset, stretch)[later]
            width = int(gap.max()) + 1 if len(gap) else 1
            both, times = np.unique(stretch[later] * width + gap, return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(both // width, minlength=len(n))))).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (both % width, times))
            cells = [batch.column(key), batch.column(order), pa.array(n), pa.array(heads, pa.binary()), pa.array(tails, pa.binary()), pa.array(first, mask=none), pa.array(last, mask=none), *lists]
            yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return chunks.select(key, order, F.col(text).alias("text")).mapInArrow(tasks, schema)


@dataclass
class Carry:
    """What is known of a record so far: its last k-1 digits, digits seen, and the offset of its last hit (0 before any)."""

    tail: bytes = b""
    digits: int = 0
    last: int = 0

    def crossing(self, head: bytes, hits: Hits) -> list[int]:
        """Offsets of the hits that begin in what was seen and end in ``head``."""
        if not self.tail or not head:
            return []
        run = np.frombuffer(self.tail + head, np.uint8)
        return (hits(Digits(run, np.array([len(run)]), np.zeros(1, np.int64), 1))[0] + self.digits - len(self.tail)).tolist()

    def then(self, k: int, digits: int, tail: bytes, last: int | None, crossed: list[int]) -> Carry:
        seen = self.digits + last if last is not None else crossed[-1] if crossed else self.last
        return Carry((self.tail + tail)[-(k - 1) :] if k > 1 else b"", self.digits + digits, seen)


def _gaps(offsets: list[int], before: int) -> list[int]:
    return [b - a for a, b in zip([before, *offsets], offsets, strict=False)]


def _scan(rows, hits: Hits, k: int):
    """From the sorted summaries of one task: (key, gap) of what is known here, then its open ends.

    Rows are (key, digits, head, tail, first, last). The record that is under way when the task begins misses what came before: its first hit here and
    the words across the task's border stay open. The end is (key, head, digits, tail, first, last, whole record so far is open, carry of the last record).
    """
    opened = None
    key, carry = None, Carry()
    for name, digits, head, tail, first, last in rows:
        if opened is None:
            opened, key = {"key": name, "head": b"", "first": None, "last": None, "digits": 0, "tail": b"", "alone": True}, name
        elif name != key:
            if opened["alone"]:
                opened |= {"alone": False, "digits": carry.digits, "tail": carry.tail}
            key, carry = name, Carry()
        crossed = carry.crossing(head, hits)
        found = crossed + ([carry.digits + first] if first is not None else [])
        if opened["alone"]:
            if len(opened["head"]) < k - 1:
                opened["head"] = (opened["head"] + head)[: k - 1]
            if found and opened["first"] is None:
                opened["first"] = found[0]
                yield from ((name, g) for g in _gaps(found[1:], found[0]))
            elif found:
                yield from ((name, g) for g in _gaps(found, carry.last))
            if found:
                opened["last"] = carry.digits + last if last is not None else crossed[-1]
        else:
            yield from ((name, g) for g in _gaps(found, carry.last))
        carry = carry.then(k, digits, tail, last, crossed)
    if opened is not None:
        if opened["alone"]:
            opened |= {"digits": carry.digits, "tail": carry.tail}
        yield opened, (key, carry)


END = "task long, alone boolean, head binary, digits long, tail binary, first long, last long, end_tail binary, end_digits long, end_last long"


def gap_counts(chunks: DataFrame, hits: Hits, k: int, *, key: str = "seq_id", order: str = "chunk", text: str = "text", alphabet: str = "acgt", lower: bool = True) -> DataFrame:
    """(key, gap, n): the gap histogram of each record, the same as if its chunks were one text.

    ``order`` is unique inside a record. Chunks may be of any length, empty and null ones included, and a word may lie over many of them; records without
    hits have no rows. Null keys are one record.
    """
    told = written(summaries(chunks, hits, k, key=key, order=order, text=text, alphabet=alphabet, lower=lower), "chunks")
    kind = chunks.schema[key]
    schema = T.StructType([kind, T.StructField("gap", LONG), *T.StructType.fromDDL(END).fields, T.StructField("end_key", kind.dataType)])
    names = schema.names

    def tasks(batches):
        task, held = TaskContext.get().partitionId(), []

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in (key, "digits", "head", "tail", "first", "last")), strict=True)

        def sent(more):
            cells = [[m.get(n) for m in more] for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=names)

        for name, x in _scan(rows(), hits, k):
            if isinstance(name, dict):
                last_key, carry = x
                end = {"task": task, "end_key": last_key, "end_tail": carry.tail, "end_digits": carry.digits, "end_last": carry.last}
                held.append({n: name.get(n) for n in ("alone", "head", "digits", "tail", "first", "last")} | {key: name["key"]} | end)
            else:
                held.append({key: name, "gap": x})
            if len(held) >= 10_000:
                yield sent(held)
                held = []
        yield sent(held)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]
    ordered = told.select(key, order, "digits", "head", "tail", "first", "last").repartitionByRange(key, order).sortWithinPartitions(key, order)
    found = written(ordered.mapInArrow(tasks, schema), "chunk-gaps")
    closed, at, carry = [], object(), Carry()
    for r in sorted(found.where("task IS NOT NULL").collect(), key=lambda r: r["task"]):  # a row for each task
        carry = carry if at == r[key] else Carry()
        crossed = carry.crossing(r["head"], hits)
        offsets = crossed + ([carry.digits + r["first"]] if r["first"] is not None else [])
        closed += [(r[key], g, 1) for g in _gaps(offsets, carry.last)]
        at, carry = r[key], carry.then(k, r["digits"], r["tail"], r["last"], crossed)
        if not r["alone"]:
            at, carry = r["end_key"], Carry(r["end_tail"], r["end_digits"], r["end_last"])
    out = T.StructType([kind, T.StructField("gap", LONG), T.StructField("n", LONG)])
    inside = told.select(key, F.explode(F.arrays_zip("gaps", "counts")).alias("x")).select(key, F.col("x.gaps").alias("gap"), F.col("x.counts").alias("n"))
    across = found.where("gap IS NOT NULL").select(key, "gap", F.lit(1).cast("bigint").alias("n"))
    every = inside.union(across).union(told.sparkSession.createDataFrame(closed, out))
    return every.groupBy(key, "gap").agg(F.sum("n").alias("n"))


