"""Exact substring deduplication by a difference-cover suffix sort, to a fixed depth.

Only suffixes at the positions of a difference cover are sampled: residues modulo 31 of which any two have an offset at
which both positions are sampled. The names of their prefixes are found by sorting; a name that occurs once cannot repeat
and leaves, as unique names end the recursion of a suffix sort. The other suffixes are reached through the sampled ones inside them: a window of
``length`` bytes is a few bytes of left context, a named prefix and the rest. The windows around equal names are sorted, and
adjacent ones are compared byte by byte, which gives each its least document. Documents that are whole copies of a smaller one leave before.

``cover="synchronizing"`` samples by content instead, the least hash among the prefixes inside a window, so equal windows choose the same
offset and one position in 16 is enough instead of one in 5.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct, dropped, mix64, text_chunks, texts_of, written
from .wordhash import byte_buffer

#: A fixed perfect difference set: every residue modulo 31 is a difference of two of its members.
MODULUS, DIFFERENCE_SET = 31, (0, 1, 3, 8, 12, 18)
FACTOR, STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
NO_DOC = np.iinfo(np.int64).max
#: Bytes of text whose positions are worked on at once, and windows compared at once.
PIECE, AT_ONCE = 1 << 18, 200_000
#: Names whose first bits no repeated name has are left out at once.
SIEVE = 24
#: Made once, as a row is small where buckets are many.
ZSTD, UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def squeezed(*parts) -> bytes:
    return ZSTD.compress(b"".join(parts))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(data))


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros past the end)."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray(len(raw), "<u8", padded, strides=(1,))


def _offsets(n: int) -> list[int]:
    return [*range(0, n - 8, 8), n - 8]


def prefix_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each position on (``n`` is 8 or more; the last n-1 are meaningless)."""
    eight, out = eights(raw), np.zeros(len(raw), np.uint64)
    for at in _offsets(n):
        out[: max(0, len(raw) - at)] ^= eight[at:]
        out *= FACTOR
        out ^= out >> np.uint64(32)
    return out * STEP


def hashes_at(eight: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The same hashes at some positions only."""
    out = np.zeros(len(at), np.uint64)
    for step in _offsets(n):
        out ^= eight[at + step]
        out *= FACTOR
        out ^= out >> np.uint64(32)
    return out * STEP


def least_positions(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the least, leftmost of x[i : i + w] for each i (shorter at the end)."""
    value, at, have = x.copy(), np.arange(len(x), dtype=np.int32), 1
    while have < w:
        step = min(have, w - have)
        if step < len(x):
            right = value[step:] < value[: len(x) - step]
            value[: len(x) - step] = np.where(right, value[step:], value[: len(x) - step])
            at[: len(x) - step] = np.where(right, at[step:], at[: len(x) - step])
        have += step
    return at


def slices(offsets: np.ndarray, length: int):
    """(byte from, to, places of texts inside): whole texts of about PIECE bytes, or parts of a longer one that overlap by a window."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + PIECE, "right")) - 1
        if stop > start:
            yield int(offsets[start]), int(offsets[stop]), offsets[start : stop + 1] - offsets[start]
        else:
            stop = start + 1
            for a in range(int(offsets[start]), int(offsets[stop]), PIECE):
                z = min(a + PIECE + length - 1, int(offsets[stop]))
                yield a, z, np.array([0, z - a])
        start = stop


def anchors_by_slice(raw: np.ndarray, offsets: np.ndarray, length: int, cover: str):
    """(name, at, first, last) of each slice: hashes of the prefixes at sampled positions, these positions, and the first and last window start that each
    stands for. Windows are ``length`` bytes inside one text; prefixes have length - 30 bytes.
    """
    pick = {"difference": _by_residue, "synchronizing": _by_content}.get(cover)
    if pick is None:
        raise ValueError(f"no such cover: {cover}")
    for a, z, inside in slices(offsets, length):
        name, *places = pick(raw[a:z], inside, a - offsets[np.searchsorted(offsets, a, "right") - 1], length)
        yield name, *(x + a for x in places)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, cover: str):
    """All anchors at once."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in zip(none, *anchors_by_slice(raw, offsets, length, cover), strict=True))


def _by_residue(raw: np.ndarray, inside: np.ndarray, shift: int, length: int):
    """Positions whose residue, from the start of their text on, is in the difference set; a slice of a long text starts ``shift`` bytes in."""
    sizes = np.diff(inside)
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(inside[:-1].astype(np.int32), sizes) + np.int32(shift % MODULUS)
    at = np.flatnonzero(np.isin(np.arange(MODULUS), DIFFERENCE_SET)[place % MODULUS])
    text = np.searchsorted(inside, at, "right") - 1
    first, last = np.maximum(at - MODULUS + 1, inside[text]), np.minimum(at, inside[text + 1] - length)
    good = first <= last
    at, first, last = at[good], first[good], last[good]
    return hashes_at(eights(raw), at, length - MODULUS + 1), at, first, last


def _by_content(raw: np.ndarray, inside: np.ndarray, shift: int, length: int):
    """Positions of the least prefix hash among those inside some window."""
    name = prefix_hashes(raw, length - MODULUS + 1)
    good = np.zeros(len(raw) + 1, np.int8)
    whole = np.diff(inside) >= length
    np.add.at(good, inside[:-1][whole], 1)
    np.add.at(good, inside[1:][whole] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(good, dtype=np.int8)[:-1])
    chosen = least_positions(name, MODULUS)[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)
    begin = np.flatnonzero(new)
    at, first = chosen[begin].astype(np.int64), windows[begin]
    last = windows[np.append(begin[1:], len(windows)) - 1] if len(begin) else first
    return name[at], at, first, last


def string_hashes(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` bytes from each of the ascending places ``first`` on, from running totals over pieces of ``raw``."""
    out = np.zeros(len(first), np.uint64)
    most = int(size.max()) if len(size) else 0
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(PIECE + most, STEP))))
    back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(PIECE, np.uint64(pow(int(STEP), -1, 1 << 64))))))
    for a in range(0, len(raw) if len(first) else 0, PIECE):
        own = slice(*np.searchsorted(first, (a, a + PIECE)))
        part = raw[a : a + PIECE + most]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(power[: len(part)] * (part.astype(np.uint64) + np.uint64(1)))))
        start = first[own] - a
        out[own] = (total[start + size[own]] - total[start]) * back[start]
    return out


def text_blocks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """(block_id, n_bytes, data): whole texts as UTF-8 in compressed blocks, with their ids and places."""

    def tasks(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in text_chunks(batches, "text", block_bytes):
            raw, offsets = byte_buffer(texts_of(batch.column("text")))
            ids = batch.column("doc_id").cast(pa.int64())
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            data = packed(raw, offsets, ids.fill_null(NO_DOC).to_numpy(zero_copy_only=False), missing)
            yield pa.RecordBatch.from_pydict({"block_id": [number], "n_bytes": [len(raw)], "data": [data]}, schema=pa.schema([("block_id", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary())]))
            number += 1

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tasks, "block_id long, n_bytes long, data binary")


def name_buckets(total: int, bucket_bytes: int) -> tuple[int, int]:
    """(buckets, bits): a power of two, so that a bucket stands for ``bucket_bytes`` of text at most, and how many bits of a name are sent: those of its
    bucket and 32 more."""
    power = max(3, (-(-total // bucket_bytes) - 1).bit_length())
    return 1 << power, 32 + power


def cut_names(name: np.ndarray, bits: int) -> np.ndarray:
    return name >> np.uint64(64 - bits)


def slots(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary cells data[edges[i] : edges[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def joined(cells: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Binary cells without nulls one after another as numbers, and how many each has."""
    found, cells = [np.zeros(0, kind)], cells.cast(pa.binary())
    for part in cells.chunks:
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
        if len(part) and offsets[-1] > offsets[0]:
            found.append(np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind))
    return np.concatenate(found), pc.binary_length(cells).to_numpy().astype(np.int64) // np.dtype(kind).itemsize


NAMES, AGAIN = "bucket int, block_id long, names binary", "bucket int, block_id long, keys binary, hot binary"


def sent_names(block: int, name: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of ``NAMES``: sorted distinct cut names of a block, 32 bits of each in the row of its bucket. One batch for all, without work for each row."""
    edges = np.searchsorted(name, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    used = np.flatnonzero(np.diff(edges))
    cells = [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block, np.int64)), slots(name.astype(np.uint32), np.append(edges[used], edges[-1]))]
    return pa.RecordBatch.from_arrays(cells, names=["bucket", "block_id", "names"])


def names_again(group: pa.Table, hot_blocks: int) -> pa.Table:
    """Rows of ``AGAIN`` from those of one bucket: names that some other block has too, and those that more than ``hot_blocks`` have."""
    low, sizes = joined(group["names"], np.uint32)
    order = np.argsort(low)
    ordered = low[order]
    begin = np.flatnonzero(np.concatenate((np.ones(1, bool), ordered[1:] != ordered[:-1]))[: len(low)])
    times = np.empty(len(low), np.int32)
    n = np.diff(np.append(begin, len(low)))
    times[order] = np.repeat(n, n)
    row = np.repeat(np.arange(len(sizes)), sizes)
    again, hot = times > 1, times > hot_blocks
    kept, much = (np.bincount(row[x], minlength=len(sizes)) for x in (again, hot))
    use = kept > 0  # rows without names add nothing to the running totals
    keys, hots = (slots(low[x], np.concatenate(([0], np.cumsum(many[use])))) for x, many in ((again, kept), (hot, much)))
    hots = pc.if_else(pa.array(much[use] > 0), hots, pa.scalar(None, pa.binary()))
    return pa.table({"bucket": group["bucket"].filter(pa.array(use)), "block_id": group["block_id"].filter(pa.array(use)), "keys": keys, "hot": hots})


def keys_of_blocks(names: DataFrame) -> DataFrame:
    """(block_id, keys, hot) from rows of ``AGAIN``, for ``listed``."""
    hot = F.when(F.col("hot").isNotNull(), F.struct("bucket", F.col("hot").alias("keys")))
    return names.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "keys")).alias("keys"), F.collect_list(hot).alias("hot"))


def listed(items: list[dict] | None) -> np.ndarray:
    """Sorted cut names from the lists of buckets."""
    found = [np.frombuffer(x["keys"], np.uint32).astype(np.uint64) | np.uint64(x["bucket"] << 32) for x in items or []]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``keys``."""
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values if len(keys) else np.zeros(len(values), bool)


def _steps(values: np.ndarray, edges: np.ndarray, kind=np.int32) -> np.ndarray:
    """Differences of successive values, the first of each segment values[edges[i] : edges[i + 1]] from 0: smaller numbers, which pack better."""
    out = np.diff(values, prepend=values.dtype.type(0))
    begin = edges[:-1][edges[:-1] < edges[1:]]
    out[begin] = values[begin]
    return out.astype(kind)


def _totals(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values again, from segments of ``sizes``."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(steps, dtype=np.int64)))
    return total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes)


def exact_copies(blocks: DataFrame, length: int) -> DataFrame:
    """(block_id, copies): places of texts of ``length`` bytes or more that a document with a smaller id has as a whole."""

    def tasks(batches):
        for batch in batches:
            for block, data in zip(batch.column("block_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                raw, offsets, ids, _ = unpacked(data)
                use = np.flatnonzero(np.diff(offsets) >= length)
                digests = [hashlib.sha256(raw[offsets[i] : offsets[i + 1]]).digest() for i in use.tolist()]
                cells = [pa.array(np.full(len(use), block)), pa.array(use.astype(np.int32)), pa.array(ids[use]), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["block_id", "place", "doc", "digest"])

    texts = written(blocks.select("block_id", "data").mapInArrow(tasks, "block_id long, place int, doc long, digest binary"), "text-digests")
    least = texts.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    copies = written(texts.join(least, "digest").where("doc > least").groupBy("block_id").agg(F.collect_list("place").alias("copies")), "text-copies")
    dropped(texts)
    return copies


def _texts(data: bytes, copies: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, places and document ids of the texts of a block that are no copies, and their number in the block."""
    raw, offsets, ids, _ = unpacked(data)
    number = np.arange(len(ids))
    if copies:
        number = np.delete(number, copies)
        sizes = np.diff(offsets)[number]
        raw, offsets = _bytes_at(raw, offsets[number], sizes), np.concatenate(([0], np.cumsum(sizes)))
    return raw, offsets, ids[number], number


def repeated_names(blocks: DataFrame, length: int, cover: str, bits: int, buckets: int, hot_blocks: int) -> DataFrame:
    """Rows of ``AGAIN``: for each block and bucket, those of its names that some other block has too, and those that more than ``hot_blocks`` have."""

    def send(batches):
        for batch in batches:
            for block, data, copies in zip(*(batch.column(c).to_pylist() for c in ("block_id", "data", "copies")), strict=True):
                raw, offsets, *_ = _texts(data, copies)
                yield sent_names(block, distinct(_names(raw, offsets, length, cover, bits)), buckets)

    sent = blocks.select("block_id", "data", "copies").mapInArrow(send, NAMES)
    return sent.groupBy("bucket").applyInArrow(lambda group: names_again(group, hot_blocks), AGAIN)


def _names(raw: np.ndarray, offsets: np.ndarray, length: int, cover: str, bits: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(cut_names(name, bits) for name, *_ in anchors_by_slice(raw, offsets, length, cover))])


def _bytes_at(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    place = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(place[-1]), np.uint8)
    for a in range(0, len(first), 20_000):
        own = slice(a, min(a + 20_000, len(first)))
        start, stop = int(place[own.start]), int(place[own.stop])
        out[start:stop] = raw[np.repeat(first[own] - place[own], size[own]) + np.arange(start, stop)]
    return out


def _alike(raw: np.ndarray, first: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which strings ``one`` equal the strings ``two``, byte by byte."""
    alike = size[one] == size[two]
    for a in range(0, len(one), 20_000):
        own = a + np.flatnonzero(alike[a : a + 20_000])
        sizes = size[one[own]]
        differ = _bytes_at(raw, first[one[own]], sizes) != _bytes_at(raw, first[two[own]], sizes)
        alike[own[np.repeat(np.arange(len(sizes)), sizes)[differ]]] = False
    return alike


def _heads(raw: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For each string the first of the equal ones with the least document; strings of one hash that differ stand for themselves."""
    order = np.argsort(whole)
    new = np.ones(len(order), bool)
    new[1:] = whole[order[1:]] != whole[order[:-1]]
    group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    if not len(order):
        return order
    least = np.minimum.reduceat(doc[order], begin)
    head = np.maximum.reduceat(np.where(doc[order] == least[group], order, -1), begin)[group]
    other = np.flatnonzero(order != head)
    other = other[~_alike(raw, first, size, order[other], head[other])]
    head[other] = order[other]
    out = np.empty(len(order), np.int64)
    out[order] = head
    return out


class Contexts:
    """Repeated contexts of a block: distinct ones with their least document (``leader``), and for each context its leader."""

    def __init__(self, raw, offsets, ids, keys, length, cover, bits):
        own = np.sort(_names(raw, offsets, length, cover, bits))
        keys = distinct(np.concatenate((keys, own[1:][own[1:] == own[:-1]])))
        sieve, found = np.zeros(1 << SIEVE, bool), [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)]
        sieve[keys >> np.uint64(bits - SIEVE)] = True
        for name, *places in anchors_by_slice(raw, offsets, length, cover):
            use = np.flatnonzero(sieve[name >> np.uint64(64 - SIEVE)])
            use = use[_among(cut_names(name[use], bits), keys)]
            found.append((name[use], *(x[use] for x in places)))
        name, at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        use = np.argsort(first, kind="stable")
        self.name, self.at, self.first, self.last, self.size = name[use], at[use], first[use], last[use], (last - first + length)[use]
        self.text = np.searchsorted(offsets, self.first, "right") - 1
        self.doc = ids[self.text]
        whole = mix64(string_hashes(raw, self.first, self.size) + self.size.astype(np.uint64) * FACTOR + (self.at - self.first).astype(np.uint64))
        self.leader = _heads(raw, self.first, self.size, self.doc, whole)
        #: A context asks for its windows if no smaller document of the block has all of them.
        self.asks = self.doc == self.doc[self.leader]


CONTEXTS = "bucket int, block_id long, n int, asks int, done int, data binary"
#: What the data of a row of ``CONTEXTS`` has for each context (how many windows, where its name begins, document), for each asking place (its context, the
#: place) and for each place answered in the block (the place, windows after it), one after another; the contexts' bytes follow.
CELL_KINDS = (np.uint8, np.uint8, np.int64), (np.int32, np.int32), (np.int32, np.uint8)


def _sends(raw, block, c: Contexts, hot: np.ndarray, bits: int, buckets: int) -> pa.RecordBatch:
    """What a block sends to each bucket: distinct contexts with their least document, who asks, and what the block answers itself."""
    cut = cut_names(c.name, bits)
    where, much = (cut >> np.uint64(32)).astype(np.int64), _among(cut, hot)
    where[much & ~c.asks] = block % buckets
    order = np.flatnonzero(~(much & c.asks))
    order = order[np.argsort(where[order], kind="stable")]
    chosen, ask, done = order[(c.leader == np.arange(len(c.leader)))[order] & ~much[order]], order[c.asks[order]], order[~c.asks[order]]
    used = distinct(where[order])
    ends = [np.append(np.searchsorted(where[x], used), len(x)) for x in (chosen, ask, done)]
    local = np.zeros(len(c.leader), np.int64)
    local[chosen] = np.arange(len(chosen)) - np.repeat(ends[0][:-1], np.diff(ends[0]))
    more = c.last - c.first
    cells = (
        ((more[chosen] + 1).astype(np.uint8), (c.at - c.first)[chosen].astype(np.uint8), _steps(c.doc[chosen], ends[0], np.int64)),
        (_steps(local[c.leader[ask]], ends[1]), _steps(c.first[ask], ends[1])),
        (_steps(c.first[done], ends[2]), more[done].astype(np.uint8)),
    )
    body, place = _bytes_at(raw, c.first[chosen], c.size[chosen]), np.concatenate(([0], np.cumsum(c.size[chosen])))[ends[0]].tolist()
    found, at = [], [e.tolist() for e in ends]
    for k in range(len(used)):
        parts = [x[e[k] : e[k + 1]] for e, kind in zip(at, cells, strict=True) for x in kind]
        found.append(squeezed(*parts, body[place[k] : place[k + 1]]))
    counts = [pa.array(np.diff(e).astype(np.int32)) for e in ends]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block, np.int64)), *counts, pa.array(found, pa.binary())], names=[x.split()[0] for x in CONTEXTS.split(", ")])


def _again(body: np.ndarray, window: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows, given by their places in ``body``, a smaller document has too. Sorted by hash, adjacent ones compared by bytes."""
    if not len(window):
        return np.zeros(0, bool)
    eight, hashes = eights(body), prefix_hashes(body, length)[window]
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    after = np.flatnonzero(~new)
    one, two = window[order[after]], window[order[after - 1]]
    if any((eight[one + at] != eight[two + at]).any() for at in _offsets(length)):  # different windows of one hash: sort by the bytes themselves
        rows = np.lib.stride_tricks.sliding_window_view(body, length)[window]
        order = np.argsort(np.unique(rows, axis=0, return_inverse=True)[1].ravel(), kind="stable")
        new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
    sorted_doc = doc[order]
    found = np.zeros(len(order), bool)
    found[order] = sorted_doc > np.minimum.reduceat(sorted_doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    return found


def _received(group: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """How many contexts, asking places and answered ones each row of ``CONTEXTS`` has, and the cells and bytes of all."""
    many = [group[x].to_numpy().astype(np.int64) for x in ("n", "asks", "done")]
    kinds = [(np.dtype(k).itemsize, m.tolist()) for own, m in zip(CELL_KINDS, many, strict=True) for k in own]
    found = [[] for _ in range(len(kinds) + 1)]
    for i, data in enumerate(group["data"].to_pylist()):
        data, start = memoryview(UNZSTD.decompress(data)), 0
        for (width, n), out in zip(kinds, found, strict=False):
            out.append(data[start : start + width * n[i]])
            start += width * n[i]
        found[-1].append(data[start:])
    return many, [np.frombuffer(b"".join(x), k) for x, k in zip(found, (*(k for own in CELL_KINDS for k in own), np.uint8), strict=True)]


def _resolve(group: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last window start) of windows that a smaller document has too, sorted by the row of the group they belong to. Names are taken one after another."""
    many, (counts, at, doc, ctx, ask, done, done_more, body) = _received(group)
    counts, at, doc = counts.astype(np.int64), at.astype(np.int64), _totals(doc, many[0])
    sizes = counts + length - 1
    place = np.cumsum(sizes) - sizes
    name = hashes_at(eights(body), place + at, length - MODULUS + 1)
    order = np.argsort(name, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = name[order[1:]] != name[order[:-1]]
    alone = np.bincount(np.cumsum(new) - 1, minlength=1)[np.cumsum(new) - 1] == 1 if len(order) else new
    held = np.sort(order[~alone])
    head = held[_heads(body, place[held], sizes[held], doc[held], mix64(string_hashes(body, place[held], sizes[held]) + name[held] * FACTOR))]
    copied = doc[held] > doc[head]  # a smaller document has all windows of these
    order = held[~copied]
    order = order[np.argsort(name[order], kind="stable")]
    total = np.cumsum(counts[order])
    edges = [0]
    for t in [*(np.flatnonzero(np.diff(name[order].view(np.int64))) + 1).tolist(), len(order)]:
        if t == len(order) or total[t - 1] - (total[edges[-1] - 1] if edges[-1] else 0) >= AT_ONCE:
            edges.append(t)
    whose, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:z]
        n = counts[own]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        part = _bytes_at(body, place[own], sizes[own])
        base = np.repeat(np.cumsum(sizes[own]) - sizes[own], n)
        found = _again(part, base + inside, np.repeat(doc[own], n), length)
        whose.append(np.repeat(own, n)[found])
        where.append(inside[found])
    which, at = np.concatenate(whose), np.concatenate(where)
    order = np.lexsort((at, which))
    which, at = which[order], at[order]
    edge = np.ones(len(which), bool)
    edge[1:] = (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)
    b = np.flatnonzero(edge)
    run_of, run_first, run_last = which[b], at[b], at[np.append(b[1:], len(at)) - 1] if len(b) else at
    run_of, run_first, run_last = (np.concatenate(x) for x in ((run_of, held[copied]), (run_first, np.zeros(copied.sum(), np.int64)), (run_last, counts[held[copied]] - 1)))
    order = np.argsort(run_of, kind="stable")
    run_of, run_first, run_last = run_of[order], run_first[order], run_last[order]
    ctx, ask, done = _totals(ctx, many[1]) + np.repeat(np.cumsum(many[0]) - many[0], many[1]), _totals(ask, many[1]), _totals(done, many[2])
    by_ctx = np.argsort(ctx, kind="stable")
    a, z = np.searchsorted(ctx[by_ctx], run_of), np.searchsorted(ctx[by_ctx], run_of, "right")
    n = z - a
    asker = by_ctx[np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    rows = np.arange(len(many[0]))
    row = np.concatenate((np.repeat(rows, many[1])[asker], np.repeat(rows, many[2])))
    first, last = np.concatenate((ask[asker] + np.repeat(run_first, n), done)), np.concatenate((ask[asker] + np.repeat(run_last, n), done + done_more))
    order = np.lexsort((first, row))
    return row[order], first[order], last[order]


def repeated_windows(keyed: DataFrame, length: int, cover: str, bits: int, buckets: int) -> DataFrame:
    """(block_id, spans): runs of window starts, as places in the block without its copies, that a document with a smaller id has too, but for those
    of hot names that ask others."""

    def send(batches):
        for batch in batches:
            for block, data, copies, keys, hot in zip(*(batch.column(c).to_pylist() for c in ("block_id", "data", "copies", "keys", "hot")), strict=True):
                raw, offsets, ids, _ = _texts(data, copies)
                yield _sends(raw, block, Contexts(raw, offsets, ids, listed(keys), length, cover, bits), listed(hot), bits, buckets)

    def find(group: pa.Table) -> pa.Table:
        row, first, last = _resolve(group, length)
        used = distinct(row)
        edges = np.append(np.searchsorted(row, used), len(row))
        steps, more = _steps(first, edges), (last - first).astype(np.uint8)
        spans = [squeezed(steps[a:z], more[a:z]) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.table({"block_id": group["block_id"].take(pa.array(used)), "spans": pa.array(spans, pa.binary())})

    return keyed.mapInArrow(send, CONTEXTS).groupBy("bucket").applyInArrow(find, "block_id long, spans binary")


def _runs(spans: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first window starts, how many follow each)."""
    data = UNZSTD.decompress(spans)
    n = len(data) // 5
    return np.cumsum(np.frombuffer(data, np.int32, n), dtype=np.int64), np.frombuffer(data, np.uint8, n, 4 * n).astype(np.int64)


def hot_windows(keyed: DataFrame, length: int, cover: str, bits: int) -> DataFrame:
    """The same for windows of hot names: each is a row of its own, so no group of them has to fit a task; equal ones meet by their bytes."""

    def send(batches):
        for batch in batches:
            for block, data, copies, keys, hot in zip(*(batch.column(c).to_pylist() for c in ("block_id", "data", "copies", "keys", "hot")), strict=True):
                raw, offsets, ids, _ = _texts(data, copies)
                c = Contexts(raw, offsets, ids, listed(keys), length, cover, bits)
                ask = np.flatnonzero(c.asks & _among(cut_names(c.name, bits), listed(hot)))
                for a in range(0, len(ask), 2_000):
                    part = ask[a : a + 2_000]
                    n = (c.last - c.first + 1)[part]
                    at = np.repeat(c.first[part], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    rows = np.lib.stride_tricks.sliding_window_view(raw, length)[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * length).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))]),
                         pa.array(np.repeat(c.doc[part], n)), pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32))],
                        names=["window", "doc", "block_id", "start"],
                    )

    rows = written(keyed.where(F.size("hot") > 0).mapInArrow(send, "window binary, doc long, block_id long, start int"), "hot-windows")
    least = rows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    return rows.join(least, "window").where("doc > least").groupBy("block_id").agg(F.collect_list("start").alias("starts"))


def remove_repeats(
    docs: DataFrame,
    *,
    length: int = 50,
    cover: str = "difference",
    doc_id: str = "doc_id",
    text: str = "text",
    block_bytes: int = 8 << 20,
    bucket_bytes: int = 8 << 20,
    hot_blocks: int = 1024,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, kept (the remaining bytes) and removed_spans (bytes from, to).

    A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id; strings
    never cross documents and are judged on the input. A null or empty text is empty and loses nothing; an empty table stays empty. Rows that share
    a doc_id do not remove each other's bytes; whole copies are told by SHA-256. A row without doc_id counts as larger than all others. doc_id is an integer (else a ValueError);
    other columns are not carried. A text of any length is worked on in overlapping pieces. A name that more than ``hot_blocks``
    blocks have is resolved by a row for each window instead of in one group.
    """
    if length < 2 * MODULUS - 12:
        raise ValueError("length must be 50 or more")
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer")
    blocks = written(text_blocks(docs, doc_id=doc_id, text=text, block_bytes=block_bytes), "text-blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets, bits = name_buckets(total, bucket_bytes)
    opened = blocks.join(exact_copies(blocks, length), "block_id", "left")
    names = written(repeated_names(opened, length, cover, bits, buckets, hot_blocks), "repeated-names")
    keyed = opened.join(keys_of_blocks(names), "block_id", "left")
    keyed = keyed.select("block_id", "data", "copies", "keys", "hot")
    spans = written(repeated_windows(keyed, length, cover, bits, buckets), "repeated-windows")
    answered = opened.join(spans.groupBy("block_id").agg(F.collect_list("spans").alias("spans")), "block_id", "left")
    starts = F.lit(None).cast("array<int>").alias("starts")
    if not names.where("hot IS NOT NULL").isEmpty():
        answered, starts = answered.join(written(hot_windows(keyed, length, cover, bits), "hot-starts"), "block_id", "left"), "starts"
    dropped(names)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches):
        for batch in batches:
            for data, copies, lists, more in zip(*(batch.column(c).to_pylist() for c in ("data", "copies", "spans", "starts")), strict=True):
                raw, offsets, ids, missing = unpacked(data)
                cover_count = np.zeros(len(raw) + 1, np.int32)
                own = np.delete(np.arange(len(ids)), copies or [])
                begin = np.cumsum(np.diff(offsets)[own]) - np.diff(offsets)[own]
                runs = [_runs(item) for item in lists or []] + ([(np.array(more), 0)] if more else [])
                for first, length_more in runs:
                    text = np.searchsorted(begin, first, "right") - 1
                    start = first + (offsets[own] - begin)[text]
                    np.add.at(cover_count, start, 1)
                    np.add.at(cover_count, start + length_more + length, -1)
                for i in copies or []:
                    cover_count[offsets[i]] += 1
                    cover_count[offsets[i + 1]] -= 1
                gone = np.cumsum(cover_count)[:-1] > 0
                kept, removed = [], []
                for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    mask = gone[a:z]
                    turn = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
                    kept.append(raw[a:z][~mask].tobytes())
                    removed.append([{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=missing), pa.array(np.diff(offsets), pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(span))],
                    names=["doc_id", "n_bytes", "kept", "removed_spans"],
                )

    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("removed_spans", spans_type)])
    return answered.select("data", "copies", "spans", starts).mapInArrow(cut, schema)
