"""Gap histograms over streams of sequence chunks.

State per sequence is the last k-1 digits, the k-mers seen and the offset of the last hit, so a chunked record gives the
same gaps as the whole one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kspace import KmerSpace
from ..operators.sets import generate, in_syncmer
from ..shared import shared_dir

#: Sets up to this size are sent to the tasks as they are.
MOST_HITS = 1 << 20


def digits_of(text: str, alphabet: str) -> np.ndarray:
    """Digits of the symbols of a text that are in the alphabet, in either case."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    order = np.argsort([ord(c) for c in alphabet])
    known = np.array([ord(c) for c in alphabet], np.uint32)[order]
    at = np.minimum(np.searchsorted(known, points), len(known) - 1)
    return order[at][known[at] == points]


def stream_gaps(chunks: DataFrame, space: KmerSpace, predicate: Callable, *, key: str = "seq_id", order: str = "chunk", text: str = "text", alphabet: str = "acgt") -> DataFrame:
    """(seq_id, gap) rows from a stream of (seq_id, chunk, text). Inside a micro-batch the chunks of a record are put in order;
    across batches they must arrive in order. The predicate's set is materialised once, which bounds the space to ``MOST_HITS``."""
    if space.size > MOST_HITS:
        raise ValueError("the space is too large to send its set to the tasks")
    taken = np.zeros(space.size, bool)
    taken[[r["mer"] for r in generate(chunks.sparkSession, space, predicate(F.col("mer"))).collect()]] = True
    k, powers = space.k, space.alpha ** np.arange(space.k - 1, -1, -1)

    def advance(group, parts, state: GroupState):
        last, n, before = state.get if state.exists else ([], 0, 0)
        rows = pd.concat(list(parts)).sort_values(order)
        digits = np.concatenate([np.array(last, np.int64), *(digits_of(t, alphabet) for t in rows[text])])
        count = max(0, len(digits) - k + 1)
        mers = sum(digits[j : j + count] * powers[j] for j in range(k)) if count else digits[:0]
        hits = n + np.flatnonzero(taken[mers])
        gaps = np.diff(hits, prepend=before)
        state.update((digits[len(digits) - min(len(digits), k - 1) :].tolist(), n + count, int(hits[-1]) if len(hits) else before))
        yield pd.DataFrame({key: [group[0]] * len(gaps), "gap": gaps})

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, gap long", "last array<bigint>, n long, before long", "append", GroupStateTimeout.NoTimeout)


def stream_syncmer_gaps(chunks: DataFrame, space: KmerSpace, s: int, t: int, **columns) -> DataFrame:
    """``stream_gaps`` of the words whose least s-mer stands at ``t``."""
    return stream_gaps(chunks, space, lambda m: in_syncmer(space, m, s, t), **columns)


def stream_histogram(gaps: DataFrame, *keys: str) -> DataFrame:
    """Counts of gaps, for update or complete output."""
    return gaps.groupBy(*keys, "gap").agg(F.count("*").alias("n"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder."""
    import uuid

    where = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    running = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{where}/state").format("parquet").start(f"{where}/rows")
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/rows")
