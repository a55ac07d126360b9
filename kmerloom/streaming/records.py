"""Records that arrive in pieces, in any order, with an end mark: gaps over keyed state that holds only what is out of turn.

The state of a record is the next piece it waits for, its last k-1 digits, digits seen and last hit, and a map of pieces that came too early. A piece in
turn is worked on at once, with those that follow it in the map; when all pieces before the end mark are done, the record is closed and its state goes. A
timer closes a record of which nothing has come for a while.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import arrays
from ..functions.arrays import Digits
from ..operators.chunks import Carry
from ..operators.scan import Hits

#: Pieces in turn are worked on together up to this size, and this many that came too early are kept beside the map.
RUN_BYTES, MOST_WAITING = 1 << 20, 64
LONG, BYTES = T.LongType(), T.BinaryType()
CARRY = T.StructType([T.StructField(n, BYTES if n == "tail" else LONG) for n in ("piece", "tail", "digits", "last", "ends")])
PIECE, EARLY = T.StructType([T.StructField("piece", LONG)]), T.StructType([T.StructField("digits", BYTES)])


class RecordGaps(StatefulProcessor):
    """(key, gap, closed): the gaps of each record, and a row without gap when it is closed (``closed`` is then the pieces it had).

    Rows are (key, piece, digits, ends); a row with ``ends`` says how many pieces the record has. Pieces that came already are
    ignored. A record that is idle for ``idle_ms`` is closed after the pieces that it has, whatever is missing between them; what comes for a closed record begins a new one.
    """

    def __init__(self, hits: Hits, k: int, key: str, idle_ms: int | None = None):
        self.hits, self.k, self.out, self.idle_ms = hits, k, Row(key, "gap", "closed"), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", CARRY)
        self.early = handle.getMapState("early", PIECE, EARLY)

    def _state(self, known: bool) -> tuple[int, Carry, int]:
        if not known:
            return 0, Carry(), -1
        piece, tail, digits, last, ends = self.carry.get()
        return piece, Carry(bytes(tail), digits, last), ends

    def _close(self, key: tuple, pieces: int, waiting: bool) -> Row:
        self.carry.clear()
        if waiting:
            self.early.clear()
        return self.out(key[0], None, pieces)

    def _advanced(self, carry: Carry, raw: bytes) -> tuple[Carry, list[int]]:
        """The carry after one piece or more in turn, and the gaps that end there: they with the digits kept before are one short run."""
        run = np.frombuffer(carry.tail + raw, np.uint8)
        found = (self.hits(Digits(run, np.array([len(run)]), np.zeros(1, np.int64), 1))[0] + carry.digits - len(carry.tail)).tolist()
        gaps = [b - a for a, b in zip([carry.last, *found], found, strict=False)]
        tail = run[max(0, len(run) - (self.k - 1)) :].tobytes() if self.k > 1 else b""
        return Carry(tail, carry.digits + len(raw), found[-1] if found else carry.last), gaps

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.carry.exists()
        piece, carry, ends = self._state(known)
        run, size, waits = [], 0, known  # pieces in turn that are worked on together; whether some may wait in the map
        new: dict[int, bytes] = {}  # pieces of this batch that came too early
        for _, at, raw, end in rows:
            if end is not None:
                ends = int(end)
            if at is None or raw is None or at < piece:
                continue
            if at > piece:
                new.setdefault(at, raw)
                if len(new) > MOST_WAITING:
                    waits = self._put(new) or waits
                continue
            while raw is not None:
                run.append(raw)
                size += len(raw)
                piece += 1
                if size > RUN_BYTES:
                    carry, gaps = self._advanced(carry, b"".join(run))
                    yield from (self.out(key[0], gap, None) for gap in gaps)
                    run, size = [], 0
                raw = self._next(piece, new, waits)
        if run:
            carry, gaps = self._advanced(carry, b"".join(run))
            yield from (self.out(key[0], gap, None) for gap in gaps)
        for timer in list(self.handle.listTimers()) if self.idle_ms else ():
            self.handle.deleteTimer(timer)
        if 0 <= ends <= piece:
            yield self._close(key, piece, waits)
            return
        self._put(new)
        self.carry.update((piece, carry.tail, carry.digits, carry.last, ends))
        if self.idle_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _put(self, new: dict[int, bytes]) -> bool:
        """Moves pieces of this batch into the map, but for those that came before; whether there were any."""
        for at, raw in new.items():
            if not self.early.containsKey((at,)):
                self.early.updateValue((at,), (raw,))
        any_ = bool(new)
        new.clear()
        return any_

    def _next(self, piece: int, new: dict[int, bytes], waits: bool) -> bytes | None:
        """The piece in turn, where it came too early, taken from where it waits; of one that came twice, what came first."""
        mine = new.pop(piece, None)
        found = self.early.getValue((piece,)) if waits else None
        if found is None:
            return mine
        self.early.removeKey((piece,))
        return bytes(found[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        piece, carry, _ = self._state(self.carry.exists())
        for (at,), (raw,) in sorted((k, v) for k, v in self.early.iterator()):
            carry, gaps = self._advanced(carry, bytes(raw))
            piece += 1
            yield from (self.out(key[0], gap, None) for gap in gaps)
        yield self._close(key, piece, True)

    def close(self) -> None:
        pass


def pieces_of(rows: DataFrame, key: str, piece: str, *, text: str = "text", ends: str | None = None, alphabet: str = "acgt", lower: bool = True) -> DataFrame:
    """(key, piece, digits, ends) of rows of text; a row whose ``text`` is null is a mark without a piece."""
    table = arrays.symbol_table(alphabet, lower)
    schema = T.StructType([rows.schema[key], T.StructField("piece", T.LongType()), T.StructField("digits", T.BinaryType()), T.StructField("ends", T.LongType())])

    def tasks(batches):
        import pyarrow as pa

        for batch in batches:
            digits = arrays.digits_of(batch.column("text"), table)
            raw, first = digits.values.tobytes(), digits.first
            parts = [None if null else raw[a : a + n] for null, a, n in zip(batch.column("text").is_null().to_pylist(), first.tolist(), digits.counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("piece"), pa.array(parts, pa.binary()), batch.column("ends")], names=schema.names)

    last = F.col(ends).cast("bigint") if ends else F.lit(None).cast("bigint")
    return rows.select(key, F.col(piece).cast("bigint").alias("piece"), F.col(text).alias("text"), last.alias("ends")).mapInArrow(tasks, schema)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with maps and timers needs, for streams started inside."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def record_gaps(pieces: DataFrame, hits: Hits, k: int, key: str, *, idle_ms: int | None = None) -> DataFrame:
    """(key, gap, closed) of a stream of pieces (``pieces_of``), numbered from 0 and in any order inside and across batches; started inside ``keyed_state``."""
    out = T.StructType([pieces.schema[key], T.StructField("gap", T.LongType()), T.StructField("closed", T.LongType())])
    processor = RecordGaps(hits, k, key, idle_ms)
    mode = "ProcessingTime" if idle_ms else "None"
    return pieces.select(key, "piece", "digits", "ends").groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode=mode)
