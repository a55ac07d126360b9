"""Sketches of whole columns of text: each task turns its batches into vectors of words and sends only counts.

Nothing is made for a single letter, and a row is never repeated for its positions. Predicates over small spaces are tables with one flag for each
word; those of long words are computed on the vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays
from ..functions.arrays import Digits
from ..functions.kspace import KmerSpace
from ..shared import written
from .sets import generate

#: Spaces up to this size have their predicate as a table that is sent to the tasks.
MOST_FLAGS = 1 << 22
#: Inputs of fewer bytes than this for each core are dealt to all cores before they are read as text.
BYTES_A_TASK = 64 << 20
Hits = Callable[[Digits], tuple[np.ndarray, np.ndarray, np.ndarray]]


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores if their files are so small that few tasks would read them; larger inputs have splits enough and stay as they are."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(tasks) if size < tasks * BYTES_A_TASK else rows


def flags(spark: SparkSession, space: KmerSpace, predicate: Callable[[Column], Column]) -> np.ndarray:
    """For each word of a space whether the predicate takes it."""
    if space.size > MOST_FLAGS:
        raise ValueError("the space is too large for a table of its words; give a function of vectors")
    out = np.zeros(space.size, bool)
    out[generate(spark, space, predicate(F.col("mer"))).toArrow().column("mer").to_numpy()] = True
    return out


def table_hits(space: KmerSpace, taken: np.ndarray) -> Hits:
    """(offset in its stretch, stretch, words of each stretch) of the words that a table of flags takes."""
    packed = np.packbits(taken)

    def of(digits: Digits):
        known = np.unpackbits(packed, count=space.size).view(bool)
        places, counts = arrays.word_places(digits, space.k)
        hit = np.flatnonzero(known[arrays.codes(digits.values, space.k, space.alpha)[places]])
        stretch = np.repeat(np.arange(len(counts)), counts)[hit]
        return places[hit] - digits.first[stretch], stretch, counts

    return of


def syncmer_hits(alpha: int, k: int, s: int, t: int, order: Callable[[np.ndarray], np.ndarray] | None = None, canonical: bool = False) -> Hits:
    """The words of k digits whose leftmost least s-mer (by ``order`` of its number) begins at ``t``, for any k: sliding minima over the run of s-mers."""

    def of(digits: Digits):
        ranks = arrays.codes(digits.values, s, alpha)
        places, counts = arrays.word_places(digits, k)
        least = arrays.sliding_least(order(ranks) if order else ranks, k - s + 1)
        hit = np.flatnonzero(least[places] - places == t)
        stretch = np.repeat(np.arange(len(counts)), counts)[hit]
        return places[hit] - digits.first[stretch], stretch, counts

    if alpha**s >= 2**62 or not 0 < s <= k or not 0 <= t <= k - s:
        raise ValueError("s-mers are numbers below 2**62, and t lies in the word")
    return of


#: Alphabets and lengths of s-mers with fewer words than this have their order as a table.
TABLE_ORDER = 1 << 20


def sketch_order(alpha: int, s: int, factor: int = 7368787, shift: int = 12345) -> Callable[[np.ndarray], np.ndarray]:
    """A pseudo-random order of s-mers: a table of ranks where they are few, else a permutation computed for each s-mer.

    The table's ranks are (m * factor + shift) modulo their number; many s-mers are ranked by ``feistel_order`` over the bits that hold them (for
    alphabets of two or four symbols a permutation of the s-mers themselves).
    """
    if alpha**s < TABLE_ORDER:
        ranks = (np.arange(alpha**s, dtype=np.int64) * factor + shift) % alpha**s
        if len(np.unique(ranks)) < len(ranks):
            raise ValueError("factor has a divisor in common with the number of s-mers")
        return lambda m: ranks[m]
    half = -(-(alpha**s - 1).bit_length() // 2)
    return lambda m: arrays.feistel_order(m, shift, half)


def default_syncmer_hits(alpha: int, k: int, t: int) -> Hits:
    """Syncmers of k digits by s-mers of half their length less one, in ``sketch_order``."""
    s = k // 2 - 1
    return syncmer_hits(alpha, k, s, t, sketch_order(alpha, s))


def _keyed(batch: pa.RecordBatch, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its key in this batch, and a row that has each key."""
    number = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        coded = batch.column(key).dictionary_encode(null_encoding="encode")
        _, number = np.unique(number * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    _, first = np.unique(number, return_index=True)
    return number, first


def _per_batch(rows: DataFrame, keys: tuple[str, ...], text: str, table: np.ndarray, on_invalid: str, added: dict[str, T.DataType], use) -> DataFrame:
    """``use(digits, keys of rows)`` of each piece of each batch: (key number, columns) of what it adds to keys."""
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(n, t) for n, t in added.items()])

    def tasks(batches):
        for batch in arrays.batches_of(batches, "text"):
            number, first = _keyed(batch, keys)
            key, values = use(arrays.digits_of(batch.column("text"), table, on_invalid), number)
            at = pa.array(first[key])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *map(pa.array, values)], names=[*keys, *added])

    return rows.select(*keys, F.col(text).alias("text")).mapInArrow(tasks, schema)


LONG = T.LongType()


def gap_counts(rows: DataFrame, hits: Hits, *keys: str, text: str = "text", alphabet: str = "acgt", lower: bool = True, on_invalid: str = "drop", least: int = 0) -> DataFrame:
    """(keys, gap, n): how often each distance from a hit to the one before occurs; the first of a text counts from its start, what follows
    the last is not counted. A batch sends one row for each key and gap."""

    def use(digits: Digits, number: np.ndarray):
        offsets, stretch, _ = hits(digits)
        gap = arrays.gaps_of(offsets, stretch)
        wanted = gap >= least
        key, gap = number[digits.owner[stretch[wanted]]], gap[wanted]
        width = int(gap.max()) + 1 if len(gap) else 1
        both, n = np.unique(key * width + gap, return_counts=True)
        return both // width, (both % width, n)

    found = _per_batch(rows, keys, text, arrays.symbol_table(alphabet, lower), on_invalid, {"gap": LONG, "n": LONG}, use)
    return found.groupBy(*keys, "gap").agg(F.sum("n").alias("n"))


def hit_counts(rows: DataFrame, hits: Hits, *keys: str, text: str = "text", alphabet: str = "acgt", lower: bool = True, on_invalid: str = "drop") -> DataFrame:
    """(keys, n_hits, n_kmers, n_texts) of rows with these keys, texts without words included."""

    def use(digits: Digits, number: np.ndarray):
        _, stretch, counts = hits(digits)
        n = int(number.max()) + 1 if len(number) else 0
        key = number[digits.owner]
        sums = np.bincount(key, counts, n).astype(np.int64)
        return np.arange(n), (np.bincount(key[stretch], minlength=n), sums, np.bincount(number, minlength=n))

    found = _per_batch(rows, keys, text, arrays.symbol_table(alphabet, lower), on_invalid, {"n_hits": LONG, "n_kmers": LONG, "n_texts": LONG}, use)
    return found.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n_hits", "n_kmers", "n_texts")))


def text_hits(rows: DataFrame, hits: Hits, *keys: str, text: str = "text", alphabet: str = "acgt", lower: bool = True, on_invalid: str = "drop") -> DataFrame:
    """(keys, n_hits, n_kmers), one row for each row."""
    out = T.StructType([rows.schema[k] for k in keys] + [T.StructField(n, LONG) for n in ("n_hits", "n_kmers")])
    table = arrays.symbol_table(alphabet, lower)

    def tasks(batches):
        for batch in arrays.batches_of(batches, "text"):
            digits = arrays.digits_of(batch.column("text"), table, on_invalid)
            _, stretch, counts = hits(digits)
            sums = np.bincount(digits.owner[stretch], minlength=digits.texts), np.bincount(digits.owner, counts, digits.texts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *map(pa.array, sums)], names=out.names)

    return rows.select(*keys, F.col(text).alias("text")).mapInArrow(tasks, out)


def word_counts(rows: DataFrame, space: KmerSpace, *keys: str, text: str = "text", alphabet: str = "acgt", lower: bool = True, on_invalid: str = "drop", canonical: bool = False) -> DataFrame:
    """(keys, mer, n) of all words of all texts; a batch sends each of its keys' words once."""

    def use(digits: Digits, number: np.ndarray):
        places, counts = arrays.word_places(digits, space.k)
        mers = arrays.codes(digits.values, space.k, space.alpha)[places]
        if canonical:
            mers = np.minimum(mers, arrays.complement_codes(digits.values, space.k, space.alpha)[places])
        known, mers = (np.arange(space.size), mers) if space.size <= 1 << 16 else np.unique(mers, return_inverse=True)
        both = np.repeat(number[digits.owner], counts) * max(1, len(known)) + mers
        if len(both) and int(both.max()) < 1 << 20:
            n = np.bincount(both)
            both = np.flatnonzero(n)
            n = n[both]
        else:
            both, n = np.unique(both, return_counts=True)
        return both // max(1, len(known)), (known[both % max(1, len(known))], n)

    found = _per_batch(rows, keys, text, arrays.symbol_table(alphabet, lower), on_invalid, {"mer": LONG, "n": LONG}, use)
    return found.groupBy(*keys, "mer").agg(F.sum("n").alias("n"))


def word_totals(rows: DataFrame, space: KmerSpace, *keys: str, text: str = "text", alphabet: str = "acgt", lower: bool = True, on_invalid: str = "drop") -> DataFrame:
    """(keys, n_kmers, n_stretches, total, least, most) for each row that has a word: their number, that of stretches with a word, sum, least and greatest."""
    out = T.StructType([rows.schema[k] for k in keys] + [T.StructField(n, LONG) for n in ("n_kmers", "n_stretches", "total", "least", "most")])
    table = arrays.symbol_table(alphabet, lower)

    def tasks(batches):
        for batch in arrays.batches_of(batches, "text"):
            digits = arrays.digits_of(batch.column("text"), table, on_invalid)
            places, counts = arrays.word_places(digits, space.k)
            mers = arrays.codes(digits.values, space.k, space.alpha)[places]
            n = np.bincount(digits.owner, counts, digits.texts).astype(np.int64)
            some = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[some]
            stretches = np.bincount(digits.owner[counts > 0], minlength=digits.texts)
            sums = [f.reduceat(mers, begin) if len(some) else mers[:0] for f in (np.add, np.minimum, np.maximum)]
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *map(pa.array, (n[some], stretches[some], *sums))], names=out.names)

    return rows.select(*keys, F.col(text).alias("text")).mapInArrow(tasks, out)


def ordered_word_counts(rows: DataFrame, space: KmerSpace, key: str, order: list[str], digit: str) -> DataFrame:
    """(mer, n): the words of symbols that are rows, one stream for each key in the order of the columns ``order`` (unique inside a key).

    Rows are sorted by ranges of key and order, so a key with most rows is spread over tasks. A task counts the words inside it and hands on its first and last
    k-1 rows, from which the words across borders are read in order. A null digit ends a stretch.
    """
    k, alpha = space.k, space.alpha
    ordered = rows.select(F.col(key).cast("string").alias("key"), *order, F.col(digit).cast("bigint").alias("digit"), F.col(key).alias("__key"))
    ordered = ordered.repartitionByRange("__key", *order).sortWithinPartitions("__key", *order).select("key", "digit")
    schema = "task long, place long, key string, digit long, mer long, n long"

    def tasks(batches):
        task, counts, place, head = TaskContext.get().partitionId(), {}, 0, []
        names, digits = pa.array([], pa.string()), np.zeros(0, np.int64)
        for batch in batches:
            known = len(names)
            names = pa.concat_arrays([names, batch.column("key")])
            digits = np.concatenate((digits, batch.column("digit").fill_null(-1).to_numpy(zero_copy_only=False)))
            if len(head) < k - 1:
                part = slice(known, known + k - 1 - len(head))
                head += list(zip(names[part].to_pylist(), digits[part].tolist(), strict=True))
            for mer, n in zip(*_words_of_rows(names, digits, known, k, alpha), strict=True):
                counts[mer] = counts.get(mer, 0) + n
            place += len(names) - known
            last = max(0, len(names) - (k - 1))
            names, digits = names[last:], digits[last:]
            if len(counts) > 1 << 20:
                yield sent(task, [], counts)
                counts = {}
        tail = list(zip(names.to_pylist(), digits.tolist(), strict=True))
        edges = list(enumerate(head)) + [(place - len(tail) + i, x) for i, x in enumerate(tail) if place - len(tail) + i >= len(head)]
        yield sent(task, edges, counts)

    def sent(task, edges, counts):
        none = [None] * len(counts)
        cells = [
            [task] * (len(edges) + len(counts)), [p for p, _ in edges] + none, [x[0] for _, x in edges] + none, [x[1] for _, x in edges] + none,
            [None] * len(edges) + list(counts), [None] * len(edges) + list(counts.values()),
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["task", "place", "key", "digit", "mer", "n"])

    found = written(ordered.mapInArrow(tasks, schema), "word-counts")
    edges = sorted(found.where("place IS NOT NULL").select("task", "place", "key", "digit").collect(), key=lambda r: (r["task"], r["place"]))  # 2 (k-1) rows a task at most
    closed: dict[int, int] = {}
    before, now, seen, task = [], [], 0, None
    for r in [*edges, None]:
        if r is None or r["task"] != task:
            before, now, seen, task = (before + now)[-(k - 1) :] if k > 1 else [], [], 0, r and r["task"]
        if r is None:
            break
        now.append((r["key"], r["digit"]))
        if r["place"] == seen and seen < k - 1:  # a row of the task's head: words that began before the task and end here
            run = before + now
            if len(run) >= k and len(now) < k:
                names, digits = (list(x) for x in zip(*run[-k:], strict=True))
                for mer, n in zip(*_words_of_rows(pa.array(names, pa.string()), np.array(digits), k - 1, k, alpha), strict=True):
                    closed[mer] = closed.get(mer, 0) + n
        seen += 1
    across = found.sparkSession.createDataFrame(list(closed.items()), "mer long, n long")
    return found.where("mer IS NOT NULL").select("mer", "n").union(across).groupBy("mer").agg(F.sum("n").alias("n"))


def _words_of_rows(names: pa.Array, digits: np.ndarray, known: int, k: int, alpha: int) -> tuple[list[int], list[int]]:
    """(words, counts) of k rows of one key in a row, of which the last is at ``known`` or after it. Digits below 0 are no digits."""
    n = len(digits)
    if n < k:
        return [], []
    key = names.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    breaks = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    bad = np.concatenate(([0], np.cumsum(digits < 0)))
    at = np.arange(max(0, known - k + 1), n - k + 1)
    ok = (breaks[at] == breaks[at + k - 1]) & (bad[at] == bad[at + k])
    mers, times = np.unique(arrays.codes(np.maximum(digits, 0), k, alpha)[at[ok]], return_counts=True)
    return mers.tolist(), times.tolist()


def long_word_counts(rows: DataFrame, k: int, *, text: str = "text", alphabet: str = "acgt", lower: bool = True, canonical: bool = True) -> DataFrame:
    """(high, low, n): counts of words of 32 to 62 digits as two longs, the first k - 31 digits and the last 31; their order is that of the words.

    Forward and complement numbers roll over the digits by doubling; no word is ever a string.
    """
    alpha = len(alphabet)
    if not 31 < k <= 62 or alpha**31 >= 1 << 63:
        raise ValueError("words of 32 to 62 digits over four symbols or fewer")
    table, front = arrays.symbol_table(alphabet, lower), k - 31

    def tasks(batches):
        for batch in arrays.batches_of(batches, "text"):
            digits = arrays.digits_of(batch.column("text"), table)
            places, _ = arrays.word_places(digits, k)
            high, low = arrays.codes(digits.values, front, alpha)[places], arrays.codes(digits.values, 31, alpha)[places + front]
            if canonical:
                other_high, other_low = arrays.complement_codes(digits.values, front, alpha)[places + 31], arrays.complement_codes(digits.values, 31, alpha)[places]
                less = (other_high < high) | (other_high == high) & (other_low < low)
                high, low = np.where(less, other_high, high), np.where(less, other_low, low)
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            new = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))[: len(high)]
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(high)))
            for a in range(0, max(1, len(at)), 1 << 17):
                part = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(high[at][part]), pa.array(low[at][part]), pa.array(n[part])], names=["high", "low", "n"])

    found = rows.select(F.col(text).alias("text")).mapInArrow(tasks, "high long, low long, n long")
    return found.groupBy("high", "low").agg(F.sum("n").alias("n"))


def long_word_text(k: int, high, low, letters: str = "ACGT") -> Column:
    """The letters of a word of two longs."""
    digits = [F.lpad(F.conv(F.col(c).cast("string"), 10, len(letters)), n, "0") for c, n in ((high, k - 31), (low, 31))]
    return F.translate(F.concat(*digits), "0123456789"[: len(letters)], letters)


def long_word_ends(rows: DataFrame, k: int, *keys: str, text: str = "text", alphabet: str = "acgt", lower: bool = True) -> DataFrame:
    """(keys, n_words, n_canonical, least_canonical, most_canonical, most_next, least_pcr, most_pcr) for each row with a word of k symbols (32 to 62): words, those
    not above their reverse complement, and the ends of canonical words, of words turned by one and of registers. ``alphabet`` is in ascending order."""
    alpha, front = len(alphabet), k - 31
    if not 31 < k <= 62 or alpha**31 >= 1 << 63 or list(alphabet) != sorted(alphabet):
        raise ValueError("words of 32 to 62 digits over four symbols or fewer, in ascending order")
    ends = ("least_canonical", "most_canonical", "most_next", "least_pcr", "most_pcr")
    out = T.StructType([rows.schema[c] for c in keys] + [T.StructField(n, LONG) for n in ("n_words", "n_canonical", *(f"{e}_{h}" for e in ends for h in ("high", "low")))])
    table, power = arrays.symbol_table(alphabet, lower), alpha ** np.arange(31, dtype=np.int64)[::-1]

    def tasks(batches):
        for batch in arrays.batches_of(batches, "text", 1 << 20):
            digits = arrays.digits_of(batch.column("text"), table)
            places, n = arrays.word_places(digits, k)
            some = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[some]
            text_of = np.repeat(np.arange(len(some)), n[some])

            def end(high, low, pick):
                """The least or greatest (high, low) of each text with a word."""
                top = pick.reduceat(high, begin) if len(some) else high
                other = np.iinfo(np.int64).max if pick is np.minimum else -1
                return top, pick.reduceat(np.where(high == top[text_of], low, other), begin) if len(some) else low

            high, low, rest = (arrays.codes(digits.values, m, alpha) for m in (front, 31, 30))
            next_high, next_low = high[np.minimum(places + 1, len(high) - 1)], rest[places + front + 1] * alpha + digits.values[places]
            high, low = high[places], low[places + front]
            rc_high, rc_low = arrays.complement_codes(digits.values, front, alpha)[places + 31], arrays.complement_codes(digits.values, 31, alpha)[places]
            less = (rc_high < high) | (rc_high == high) & (rc_low < low)
            high, low = np.where(less, rc_high, high), np.where(less, rc_low, low)
            turn = arrays.least_rotations(digits.values, places, k)
            pcr_high, pcr_low = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            for a in range(0, len(places), 1 << 14):
                part = slice(a, a + (1 << 14))
                word = digits.values[places[part, None] + (turn[part, None] + np.arange(k)) % k].astype(np.int64)
                pcr_high[part], pcr_low[part] = word[:, :front] @ power[31 - front :], word[:, front:] @ power
            found = (end(high, low, np.minimum), end(high, low, np.maximum), end(next_high, next_low, np.maximum), end(pcr_high, pcr_low, np.minimum), end(pcr_high, pcr_low, np.maximum))
            cells = [n[some], np.bincount(text_of, ~less, len(some)).astype(np.int64), *(x for pair in found for x in pair)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in keys), *map(pa.array, cells)], names=out.names)

    found = rows.select(*keys, F.col(text).alias("text")).mapInArrow(tasks, out)
    letters = alphabet.upper() if lower else alphabet
    return found.select(*keys, "n_words", "n_canonical", *(long_word_text(k, f"{e}_high", f"{e}_low", letters).alias(e) for e in ends))


def registers(rows: DataFrame, k: int, *keys: str, text: str = "text", alphabet: str = "acgt", lower: bool = True) -> DataFrame:
    """(keys, n_words, n_least, least, most) for each row with a word of k symbols (32 to 62): how many words, how many of them are the least of their
    register, and the least and the greatest register (named by its least word) of the row. ``alphabet`` is in ascending order."""
    alpha, front = len(alphabet), k - 31
    if not 31 < k <= 62 or alpha**31 >= 1 << 63 or list(alphabet) != sorted(alphabet):
        raise ValueError("words of 32 to 62 digits over four symbols or fewer, in ascending order")
    ends = [f"{e}_{h}" for e in ("least", "most") for h in ("high", "low")]
    out = T.StructType([rows.schema[c] for c in keys] + [T.StructField(n, LONG) for n in ("n_words", "n_least", *ends)])
    table, power = arrays.symbol_table(alphabet, lower), alpha ** np.arange(31, dtype=np.int64)[::-1]

    def tasks(batches):
        for batch in arrays.batches_of(batches, "text", 1 << 20):
            digits = arrays.digits_of(batch.column("text"), table)
            places, n = arrays.word_places(digits, k)
            turn = arrays.least_rotations(digits.values, places, k)
            high, low = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            for a in range(0, len(places), 1 << 14):
                part = slice(a, a + (1 << 14))
                word = digits.values[places[part, None] + (turn[part, None] + np.arange(k)) % k].astype(np.int64)
                high[part], low[part] = word[:, :front] @ power[31 - front :], word[:, front:] @ power
            text_of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((low, high, text_of))
            some = np.flatnonzero(n)
            last = np.cumsum(n)[some] - 1
            first = last - n[some] + 1
            cells = [n[some], np.bincount(text_of, turn == 0, len(n)).astype(np.int64)[some], *(x[order][at] for at in (first, last) for x in (high, low))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in keys), *map(pa.array, cells)], names=out.names)

    found = rows.select(*keys, F.col(text).alias("text")).mapInArrow(tasks, out)
    letters = alphabet.upper() if lower else alphabet
    return found.select(*keys, "n_words", "n_least", *(long_word_text(k, f"{e}_high", f"{e}_low", letters).alias(e) for e in ("least", "most")))
