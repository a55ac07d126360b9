"""Vectorised words, word hashes and word n-gram hashes of Arrow text columns.

Words are maximal runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import mix64, sums_by

_BYTE = np.arange(256)
IS_WORD = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE | 0x20) >= 0x61) & ((_BYTE | 0x20) <= 0x7A) & (_BYTE < 0x80)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
#: A fixed random odd number for each byte and for each place.
BYTE_HASH = mix64(LOWER.astype(np.uint64) + np.uint64(0x51ED27)) | np.uint64(1)
PLACE = np.uint64(0x9E3779B97F4A7C15)


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array without nulls, and the offsets of its texts."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass(frozen=True)
class Words:
    """Words of some texts in order: their hashes, byte places, and how many each text has."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        ends = np.cumsum(self.counts)
        return np.repeat(ends, self.counts) - np.arange(len(self.hashes))


def words_of(texts: pa.Array) -> Words:
    raw, offsets = byte_buffer(texts)
    inside = IS_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return Words(np.zeros(0, np.uint64), starts, ends, counts)
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max()), PLACE))))
    hashes = np.add.reduceat(BYTE_HASH[raw[inside]] * power[place], begin)
    return Words(mix64(hashes + size.astype(np.uint64)), starts, ends, counts)


def word_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words per text, without their hashes."""
    inside = IS_WORD[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    starts[begin] = inside[begin]
    total = np.concatenate(([0], np.cumsum(starts)))
    return total[offsets[1:]] - total[offsets[:-1]]


SEQUENCE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def sequence_key(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    longest = int(words.counts.max()) if len(words.counts) else 0
    place = np.arange(len(words.hashes)) - np.repeat(words.first, words.counts)
    keys = []
    for salt in SEQUENCE:
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(longest, salt))))
        keys.append(mix64(sums_by(mix64(words.hashes ^ salt) * power[place], words.counts) + words.counts.astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on, across texts; the last n-1 are meaningless."""
    out = np.zeros(len(hashes), np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    for j in range(n):
        out = out * step
        out[: max(0, len(hashes) - j)] += hashes[j:]
    return mix64(out + np.uint64(n))


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over x[i : i + w], shorter at the end; log2(w) passes."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:]) if step < len(out) else out[:0]
        have += step
    return out


def winnowed(gram: np.ndarray, left: np.ndarray, k: int, w: int) -> np.ndarray:
    """Mask of k-grams that are least in some window of ``w`` consecutive ones inside a text (all ties).

    Any stretch of w + k - 1 words shared by two texts has a selected k-gram at the same place in both.
    """
    whole = left >= w + k - 1
    least = np.where(whole, sliding(gram, w, np.minimum), np.uint64(0))
    most = sliding(least[::-1], w, np.maximum)[::-1]
    return (gram == most) & (left >= k)
