"""Words of a batch of texts as vectors: digits, rolling codes, hits and gaps.

A batch is one run of digits with the number of digits of each text; all functions work on the whole run, and words that would cross
from one text (or one stretch of a text) to the next are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, OTHER = 254, 255


def symbol_table(alphabet: str, lower: bool) -> np.ndarray:
    """The digit of each byte, ``SPACE`` for ASCII white space and ``OTHER`` for the rest. ``lower`` takes A-Z for a-z."""
    if len(set(alphabet)) != len(alphabet) or not alphabet.isascii() or len(alphabet) >= SPACE:
        raise ValueError(f"not an alphabet of different ASCII symbols: {alphabet}")
    table = np.full(256, OTHER, np.uint8)
    table[np.frombuffer(b" \t\n\x0b\f\r", np.uint8)] = SPACE
    for i, c in enumerate(alphabet):
        table[ord(c)] = i
        if lower and "a" <= c <= "z":
            table[ord(c) - 32] = i
    return table


@dataclass(frozen=True)
class Digits:
    """Digits of texts one after another; ``counts`` of each stretch, and the text (``owner``) that each stretch is part of."""

    values: np.ndarray
    counts: np.ndarray
    owner: np.ndarray
    texts: int

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def digits_of(texts: pa.Array, table: np.ndarray, on_invalid: str = "drop") -> Digits:
    """Digits of the symbols of each text. White space is skipped; other symbols are dropped, raise (``error``) or end a stretch (``split``)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    code, offsets = table[raw], offsets - offsets[0]
    kept = code < SPACE
    values = code[kept]
    upto = np.concatenate(([0], np.cumsum(kept)))
    counts = upto[offsets[1:]] - upto[offsets[:-1]]
    owner = np.arange(len(counts))
    if on_invalid == "drop":
        return Digits(values, counts, owner, len(texts))
    bad = np.flatnonzero(code == OTHER)
    if on_invalid == "error":
        if len(bad):
            text = int(np.searchsorted(offsets, bad[0], "right")) - 1
            place = int((code[offsets[text] : bad[0]] != SPACE).sum()) + 1
            raise ValueError(f"symbol outside the alphabet at {place}")
        return Digits(values, counts, owner, len(texts))
    if on_invalid != "split":
        raise ValueError(f"no such rule: {on_invalid}")
    cuts = np.unique(np.concatenate((upto[offsets], upto[bad])))
    begin = cuts[:-1]
    own = np.searchsorted(upto[offsets], begin, "right") - 1
    return Digits(values, np.diff(cuts), own, len(texts))


def codes(values: np.ndarray, k: int, alpha: int) -> np.ndarray:
    """Number of the k digits from each place on, by doubling; the last k-1 are shorter words and mean nothing."""
    out, have = values.astype(np.int64), 1
    for bit in bin(k)[3:]:
        out = out * alpha**have + _ahead(out, have)
        have *= 2
        if bit == "1":
            out = out * alpha + _ahead(values.astype(np.int64), have)
            have += 1
    return out


def complement_codes(values: np.ndarray, k: int, alpha: int) -> np.ndarray:
    """Number of the reverse complement of the k digits from each place on."""
    single = alpha - 1 - values.astype(np.int64)
    out, have = single, 1
    for bit in bin(k)[3:]:
        out = out + _ahead(out, have) * alpha**have
        have *= 2
        if bit == "1":
            out = out + _ahead(single, have) * alpha**have
            have += 1
    return out


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - n)] = x[n:]
    return out


def word_places(digits: Digits, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where a word of k digits begins, and how many each stretch has."""
    counts = np.maximum(0, digits.counts - (k - 1))
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(digits.first - begin, counts), counts


def gaps_of(offsets: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Distance of each hit (offset inside its stretch) from the one before in the same stretch; the first counts from 0."""
    out = offsets.copy()
    same = stretch[1:] == stretch[:-1]
    out[1:][same] -= offsets[:-1][same]
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value among ``width`` from each place on, by least values of prefixes and suffixes of blocks.

    The work does not depend on the width. The last width-1 places mean nothing.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    if int(values.max()) >= 1 << 30:
        values = np.unique(values, return_inverse=True)[1]
    blocks = -(-n // width)
    key = np.full(blocks * width, np.iinfo(np.int64).max)
    key[:n] = (values.astype(np.int64) << 32) | np.arange(n)
    key = key.reshape(blocks, width)
    prefix = np.minimum.accumulate(key, axis=1).ravel()
    suffix = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    end = np.minimum(np.arange(n) + width - 1, n - 1)
    return np.minimum(suffix[:n], prefix[end]) & ((1 << 32) - 1)


def least_rotations(values: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """For the word of k digits at each place, where its least rotation begins (0 to k-1), in a number of steps linear in k.

    Two candidates are compared digit by digit; the one that loses moves past all that has been compared.
    """
    i, j, run = np.zeros(len(places), np.int64), np.ones(len(places), np.int64), np.zeros(len(places), np.int64)
    left = np.arange(len(places)) if k > 1 else np.zeros(0, np.int64)
    while len(left):
        a, b, n, at = i[left], j[left], run[left], places[left]
        x, y = values[at + (a + n) % k], values[at + (b + n) % k]
        a, b = np.where(x > y, np.maximum(a + n + 1, b), a), np.where(x < y, b + n + 1, np.where(x > y, np.maximum(a + n + 1, b) + 1, b))
        n = np.where(x == y, n + 1, 0)
        i[left], j[left], run[left] = a, b, n
        left = left[(b < k) & (n < k)]
    return i


def feistel_order(x: np.ndarray, seed: int, half: int, rounds: int = 4) -> np.ndarray:
    """A Luby-Rackoff permutation of the numbers of 2 * half bits whose rounds are plain arithmetic, so that SQL can repeat it."""
    mask = (1 << half) - 1
    for r in range(rounds):
        left, right = x >> half, x & mask
        x = (right << half) | (left ^ (((right * 40503 + seed * 9176 + r * 7919) // 8) & mask))
    return x


def batches_of(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each piece has about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(size) - size) // most
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                yield batch.slice(a, b - a)


Kernel = Callable[[np.ndarray], np.ndarray]
