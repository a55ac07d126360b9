"""Harmonic packing of tokenised documents into training sequences.

A document's ids are cut into full sequences, then at the largest reciprocal of the capacity (capacity // k) that fits,
as long as that is not under the smallest cut, and a tail. A piece of length n belongs to the class k =
capacity // n, whose bins hold k pieces each, so bins fill without looking at any
other piece. Every task packs its own rows: there is no shuffle and no global state.
What is left in unfinished bins when a task ends (fewer than k pieces a class) is
laid end to end and cut at the capacity, the rest at powers of two.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import space_words, sums_by, text_chunks, texts_of
from .wordhash import byte_buffer

#: About how much text is encoded at a time: its words, codes and ids take many times its size meanwhile.
CHUNK_BYTES = 1 << 20


class WordTokenizer:
    """Ids of texts by a `tokenizers` file whose pieces never cross white space.

    Distinct words are encoded once and their ids gathered (the file lower-cases and splits signs
    from letters, so words are told apart only after ``fold``); the memory of words is emptied when
    it holds ``most`` of them, which costs time only.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = [e.ids for e in self.encoder.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            n, total = len(self.known), int(sizes.sum())
            while n + len(part) > len(self.sizes):
                self.sizes, self.starts = np.resize(self.sizes, 2 * len(self.sizes)), np.resize(self.starts, 2 * len(self.starts))
            while self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
            self.sizes[n : n + len(part)] = sizes
            self.starts[n : n + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.used += total

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end_id`` after each text, and ids per text with it.

        The file's special tokens are matched in the text as it stands, so a text with one of them, in any case, is encoded whole.
        """
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._plain_ids(texts, end_id)
        out, doc_tokens = self._plain_ids(pc.if_else(pa.array(special), pa.scalar("", texts.type), texts), end_id)
        parts = np.split(out, np.cumsum(doc_tokens)[:-1])
        for i in np.flatnonzero(special).tolist():
            parts[i] = np.array([*self.encoder.encode(texts[i].as_py(), add_special_tokens=False).ids, end_id], np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _plain_ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        codes, counts, words = space_words(fold(texts))
        words = words.to_pylist()
        if len(self.known) > self.most:
            self.forget()
        self._learn([w for w in words if w not in self.known])
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[codes]
        each = self.sizes[rows].astype(np.int64)
        starts = self.starts[rows]
        doc_tokens = sums_by(each, counts) + 1
        place = np.cumsum(each) - each + np.repeat(np.arange(len(counts)), counts)
        out = np.full(int(doc_tokens.sum()), end_id, np.uint32)
        step = np.repeat(starts, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        out[np.repeat(place - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))] = self.flat[step]
        return out, doc_tokens


_TOKENIZERS: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer that this worker process keeps from task to task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[10] = 32
_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))


def fold(texts: pa.Array) -> pa.Array:
    """Texts of equal ids with fewer distinct words: A-Z lower-cased, line feeds as spaces, and a space
    between an ASCII letter and a full stop or comma, where the tokenizer splits anyway."""
    raw, offsets = byte_buffer(texts)
    raw = _FOLD[raw]
    stop = (raw == 46) | (raw == 44)
    stop[1:] &= _LETTER[raw[:-1]]
    stop[:1] = False
    stop[offsets[:-1][offsets[:-1] < len(raw)]] = False
    at = np.flatnonzero(stop)
    offsets = offsets + np.searchsorted(at, offsets)
    raw = np.insert(raw, at, 32)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])


def cut(doc_tokens: np.ndarray, capacity: int, smallest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of pieces in document order."""
    docs, starts, lengths = [], [], []
    full, rest = doc_tokens // capacity, doc_tokens % capacity
    owner = np.repeat(np.arange(len(doc_tokens)), full)
    docs.append(owner)
    starts.append((np.arange(len(owner)) - (np.cumsum(full) - full)[owner]) * capacity)
    lengths.append(np.full(len(owner), capacity))
    at, own = full * capacity, np.flatnonzero(rest)
    while len(own):
        length = np.where(rest[own] < smallest, rest[own], capacity // -(-capacity // rest[own]))
        docs.append(own)
        starts.append(at[own])
        lengths.append(length)
        at[own] += length
        rest[own] -= length
        own = own[rest[own] > 0]
    doc, start, length = (np.concatenate(x).astype(np.int64) for x in (docs, starts, lengths))
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order]


def _fill(pieces: pa.Table, capacity: int, first: int) -> tuple[pa.Table, pa.Table, int]:
    """Full bins of every class with sequence_id and offset, the pieces of open bins, and the next id."""
    length = pieces["length"].to_numpy()
    kind = capacity // length
    order = np.argsort(kind, kind="stable")
    kind, length = kind[order], length[order]
    new = np.concatenate(([True], kind[1:] != kind[:-1]))[: len(kind)]
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate((begin, [len(kind)])))
    rank = np.arange(len(kind)) - np.repeat(begin, count)
    whole = rank < np.repeat(count, count) // kind * kind
    done = order[whole]
    opens = rank[whole] % kind[whole] == 0
    bins = np.cumsum(opens)
    before = np.cumsum(length[whole]) - length[whole]
    offset = before - before[opens][bins - 1] if len(done) else before
    out = pieces.take(pa.array(done)).append_column("sequence_id", pa.array(first + bins - 1, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
    return out, pieces.take(pa.array(np.sort(order[~whole]))), first + int(opens.sum())


def _finish(pieces: pa.Table, capacity: int, first: int) -> pa.Table:
    """Open bins' pieces laid end to end, cut at the capacity and the last part at powers of two."""
    rows = []
    total = sum(pieces["length"].to_pylist())
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    sequence, used = 0, 0
    for r in pieces.to_pylist():
        at = 0
        while at < r["length"]:
            n = min(r["length"] - at, sizes[sequence] - used)
            rows.append(r | {"start": r["start"] + at, "length": n, "token_ids": r["token_ids"][4 * at : 4 * (at + n)], "sequence_id": first + sequence, "offset": used})
            at, used = at + n, used + n
            if used == sizes[sequence]:
                sequence, used = sequence + 1, 0
    schema = pieces.schema.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))
    return pa.Table.from_pylist(rows, schema)


def packed(batches, encoder: WordTokenizer, first: int, capacity: int, end_id: int, smallest: int) -> Iterator[pa.Table]:
    """The pieces of the rows of one task, whose sequences are numbered from ``first``."""
    left = None
    for batch in text_chunks(batches, "text", CHUNK_BYTES):
        ids, doc_tokens = encoder.ids(texts_of(batch.column("text")), end_id)
        doc, start, length = cut(doc_tokens, capacity, smallest)
        ends = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int32)
        pieces = pa.table({
            "doc_id": batch.column("doc_id").take(pa.array(doc)),
            "start": start,
            "length": length,
            "token_ids": pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))]),
            "doc_tokens": doc_tokens[doc],
        })
        out, left, first = _fill(pieces if left is None else pa.concat_tables([left, pieces]).combine_chunks(), capacity, first)
        yield out
    if left is not None and left.num_rows:
        yield _finish(left, capacity, first)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    smallest: int = 64,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, token_ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a `tokenizers` file; ``capacity`` and ``smallest`` are powers of two. Pieces of ``smallest`` ids or more
    are capacity // k long, so a bin of k of them is all but full; a document has one shorter piece at most, but where a task ends.
    Every id of every document, and ``end_id`` after it, lies in exactly one piece; offsets in a
    sequence are gapless from 0. A null text is empty and yields its ``end_id`` alone. Rows that
    repeat a doc_id are packed as separate documents, repeated texts are packed each time; columns other than ``doc_id`` are not carried.
    A text of any length is encoded whole; an empty table has no sequences.
    sequence_id is unique over tasks: the task's number in the high bits.
    """
    if capacity & (capacity - 1) or smallest & (smallest - 1) or not 0 < smallest < capacity:
        raise ValueError("capacity and smallest are powers of two, smallest the lesser")

    def tasks(batches):
        for table in packed(batches, worker_tokenizer(tokenizer), TaskContext.get().partitionId() << 40, capacity, end_id, smallest):
            yield from table.select(schema.names).to_batches(20_000)

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + [
        T.StructField(n, T.BinaryType() if n == "token_ids" else T.LongType())
        for n in ("start", "length", "token_ids", "doc_tokens", "sequence_id", "offset")
    ])
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(tasks, schema)
