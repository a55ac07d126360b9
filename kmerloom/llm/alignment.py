"""Alignment of the tokens of two tokenizers, and how well linked tokens agree over the corpus.

A whole Arrow batch is one run of bytes: the ends of all tokens of either tokenizer are counted once for each byte, the batch is cut
where both have an end, and prefix sums over these cuts give the group of each token and, by the byte offsets of documents, the
figures of each text. Only the tokenizers themselves look at texts: they encode distinct units (a word with the space or line feed
before it, which no token of either crosses) once for each worker.

Every text is encoded once; its distinct linked id pairs are written, counted over the corpus and looked up. The most frequent
pairs, ``most_sent`` at most, are sent to the tasks; where there are more, a text's remaining, rare pairs are joined with the rest of the
table by a shuffle.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, sums_by, text_chunks, texts_of, written

#: An id pair is one number: A's id above these bits for B's.
B_BITS = 20
#: A unit begins with a space or line feed that stands alone between two characters that are no white space.
UNIT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Words that are empty or have white space at an end, but for the line feed that begins them.
APART = re.compile(r"\n?+(?:\s|\Z)|.*\s\Z", re.DOTALL).match
SPACE = re.compile(r"\s").search
#: Groups of more links than this are counted by their distinct ids instead of link by link.
LARGE = 1 << 12


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lists:
    """Lists of ids in one flat array."""

    def __init__(self) -> None:
        self.sizes, self.starts, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.n = self.used = 0

    def extend(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(flat)
        if n > len(self.sizes):
            self.sizes, self.starts = np.resize(self.sizes, 2 * n), np.resize(self.starts, 2 * n)
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        self.sizes[self.n : n] = sizes
        self.starts[self.n : n] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.flat[self.used : used] = flat
        self.n, self.used = n, used

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at ``rows`` one after another, and the size of each."""
        sizes = self.sizes[rows].astype(np.int64)
        shift = self.starts[rows] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


class TwoTokenizers:
    """Ids of units by a byte-level `tokenizers` file (A) and a `sentencepiece` model with byte fallback (B).

    When more than ``most`` units are known at the start of a batch all are forgotten, which costs time only.
    """

    def __init__(self, byte_path: str, piece_path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of_char = byte_level()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of_char.get(c, 63) for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if len(self.b_bytes) >= 1 << B_BITS or len(self.a_bytes) >= 1 << B_BITS:
            raise ValueError("more ids than an id pair's number holds")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.dummy = self.b.piece_to_id("▁")
        self.most = most
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.a_lists, self.b_lists, self.whole = Lists(), Lists(), np.zeros(0, bool)

    def _places(self, units: list[str]) -> np.ndarray:
        """The place of each unit among those known; new ones are encoded and held against their bytes."""
        new = list(dict.fromkeys(u for u in units if u not in self.known))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            plain = [u for u in part if not SPACE(u, 1)]
            if len(plain) < len(part):
                part = plain + [u for u in part if SPACE(u, 1)]
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
            raw = [u.encode() for u in part]
            length = np.fromiter(map(len, raw), np.int64, len(raw))
            whole = np.ones(len(part), bool)
            for (sizes, flat), lists, known, width in (
                (self._a_ids(part, len(plain), length), self.a_lists, self.a_bytes, self.a_sizes),
                (self._b_ids(part), self.b_lists, self.b_bytes, self.b_sizes),
            ):
                lists.extend(sizes, flat)
                spelled = b"".join(map(known.__getitem__, flat.tolist()))
                whole &= (own := sums_by(width[flat], sizes)) == length
                if not whole.all() or spelled != b"".join(raw):
                    ends = np.cumsum(own)
                    whole &= [spelled[z - n : z] == x for z, n, x in zip(ends.tolist(), own.tolist(), raw, strict=True)]
            self.whole = np.concatenate((self.whole, whole))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def _a_ids(self, units: list[str], plain: int, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids by A. The first ``plain`` units have no further white space: they are encoded as one text, which is faster, and told apart by their bytes."""
        flat = np.array(self.a.encode_batch_fast(["".join(units[:plain])], add_special_tokens=False)[0].ids, np.int32)
        upto = np.searchsorted(np.cumsum(self.a_sizes[flat]), np.cumsum(length[:plain]), "right")
        rest = [e.ids for e in self.a.encode_batch_fast(units[plain:], add_special_tokens=False)]
        sizes = np.concatenate((np.diff(upto, prepend=0), np.array([len(x) for x in rest], np.int64)))
        return sizes, np.concatenate((flat, np.fromiter(chain.from_iterable(rest), np.int32)))

    def _b_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids by B, which puts a space before each text; that of a unit with a line feed is taken away."""
        ids = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        fed = np.fromiter((u[0] != " " for u in units), bool, len(units))
        for i in np.flatnonzero(fed).tolist():
            ids[i] = ids[i][1:] if ids[i][:1] == [self.dummy] else []
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places of the units of each text, with a space before it, and how many each text has; an empty text has none.

        Texts are split at spaces and line feeds; those where some lie together or next to other white space are split by ``UNIT``.
        """
        if len(self.known) > self.most:
            self.forget()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        apart = np.fromiter(map(bool, map(APART, words)), bool, len(words))
        fed = pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
        odd = sums_by(apart[codes].astype(np.int64), counts) > 0
        odd |= fed[codes[np.cumsum(counts) - counts]]
        if not odd.any():
            return self._places([w if w[:1] == "\n" else " " + w for w in words])[codes], counts
        plain = np.repeat(~odd, counts)
        used = np.unique(codes[plain])
        place = np.zeros(len(words), np.int64)
        place[used] = self._places([w if w[:1] == "\n" else " " + w for w in map(words.__getitem__, used.tolist())])
        parts = np.split(place[codes], np.cumsum(counts)[:-1])
        own = {i: UNIT.split(" " + t) if (t := texts[i].as_py()) else [] for i in np.flatnonzero(odd).tolist()}
        found = self._places(list(chain.from_iterable(own.values())))
        for (i, x), end in zip(own.items(), np.cumsum([len(x) for x in own.values()]).tolist(), strict=True):
            parts[i] = found[end - len(x) : end]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_TOKENIZERS: dict[tuple[str, str], TwoTokenizers] = {}


def worker_tokenizers(byte_path: str, piece_path: str) -> TwoTokenizers:
    """The tokenizers that this worker process keeps from task to task."""
    if (byte_path, piece_path) not in _TOKENIZERS:
        _TOKENIZERS[byte_path, piece_path] = TwoTokenizers(byte_path, piece_path)
    return _TOKENIZERS[byte_path, piece_path]


@dataclass
class Batch:
    """The tokens of a batch of texts one after another, and the group of each."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray

    @property
    def a_in(self) -> np.ndarray:
        return np.bincount(self.a_group, minlength=int(self.n_groups.sum()))

    @property
    def b_in(self) -> np.ndarray:
        return np.bincount(self.b_group, minlength=int(self.n_groups.sum()))

    @property
    def n_links(self) -> np.ndarray:
        return sums_by(self.a_in * self.b_in, self.n_groups)


def align_batch(encoder: TwoTokenizers, texts: pa.Array) -> Batch:
    units, counts = encoder.units(texts)
    good = (sums_by((~encoder.whole[units]).astype(np.int64), counts) == 0) & (counts > 0)
    units, counts = units[np.repeat(good, counts)], np.where(good, counts, 0)
    a, a_sizes = encoder.a_lists.gather(units)
    b, b_sizes = encoder.b_lists.gather(units)
    n_a, n_b = sums_by(a_sizes, counts), sums_by(b_sizes, counts)
    a_bytes = encoder.a_sizes[a]
    a_ends, b_ends = np.cumsum(a_bytes), np.cumsum(encoder.b_sizes[b])
    total = int(a_ends[-1]) if len(a_ends) else 0
    cuts = (np.bincount(a_ends, minlength=total + 1) > 0) & (np.bincount(b_ends, minlength=total + 1) > 0)
    upto = np.cumsum(cuts)
    return Batch(a, b, (upto - cuts)[a_ends], (upto - cuts)[b_ends], n_a, n_b, sums_by(cuts[1:].astype(np.int64), sums_by(a_bytes, n_a)))


def linked_pairs(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id pair, links of it in the text), in the order of texts and pairs."""
    a_in, b_in = batch.a_in, batch.b_in
    text = np.repeat(np.arange(len(batch.n_groups)), batch.n_groups)
    large = a_in * b_in > LARGE
    first_b = np.cumsum(b_in) - b_in
    times = np.where(large, 0, b_in)[batch.a_group]
    group = np.repeat(batch.a_group, times)
    place = np.arange(len(group)) - np.repeat(np.cumsum(times) - times, times)
    high = 2 * B_BITS
    keys = [(text[group] << high) | (np.repeat(batch.a.astype(np.int64), times) << B_BITS) | batch.b[first_b[group] + place]]
    links = [np.ones(len(group), np.int64)]
    first_a = np.cumsum(a_in) - a_in
    for g in np.flatnonzero(large).tolist():
        x, n = np.unique(batch.a[first_a[g] : first_a[g] + a_in[g]].astype(np.int64), return_counts=True)
        y, m = np.unique(batch.b[first_b[g] : first_b[g] + b_in[g]].astype(np.int64), return_counts=True)
        keys.append(((text[g] << high) | (x[:, None] << B_BITS) | y[None, :]).ravel())
        links.append((n[:, None] * m[None, :]).ravel())
    key, n = added(np.concatenate(keys), np.concatenate(links) if large.any() else None)
    return key >> high, key & ((1 << high) - 1), n


def added(keys: np.ndarray, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their values (without values: how often each occurs)."""
    if values is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    if values is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(values, at) if len(at) else values


def group_texts(batch: Batch) -> pa.Array:
    """The groups of each text in order: decimal ids of A joined by commas, a bar, those of B; groups are joined by semicolons.

    A token's digits and the sign after it are the bytes of one 64-bit number.
    """
    a_in, b_in = batch.a_in, batch.b_in
    a_upto, b_upto = np.cumsum(a_in), np.cumsum(b_in)
    ids = np.zeros(len(batch.a) + len(batch.b), np.int32)
    ids[np.arange(len(batch.a)) + (b_upto - b_in)[batch.a_group]] = batch.a
    ids[np.arange(len(batch.b)) + a_upto[batch.b_group]] = batch.b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[a_upto + b_upto - b_in - 1] = ord("|")
    mark[a_upto + b_upto - 1] = ord(";")
    tokens = batch.n_a + batch.n_b
    known = np.arange(int(ids.max()) + 1 if len(ids) else 1)
    shown = np.char.encode(known.astype("U7")).astype("S8").view("<u8")
    sizes = np.searchsorted(10 ** np.arange(1, 8), known, "right") + 1
    each = sizes[ids]
    signed = shown[ids] | mark.astype("<u8") << (8 * each).astype("<u8")
    each = each + 1
    each[np.cumsum(tokens)[tokens > 0] - 1] -= 1  # no semicolon after the last group
    upto = np.arange(8) < np.arange(9)[:, None]
    pieces = [signed[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8)[upto[each[at : at + (1 << 18)]]] for at in range(0, len(ids), 1 << 18)]
    offsets = np.concatenate(([0], np.cumsum(sums_by(each, tokens)))).astype(np.int64)
    data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(tokens), pa.py_buffer(offsets), pa.py_buffer(data))


PAIRS = T.StructType([T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("links", T.ArrayType(T.LongType()))])
COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, byte_path: str, piece_path: str, *, doc_id: str = "doc_id", text: str = "text", chunk: int = 2 << 20) -> DataFrame:
    """Per document: doc_id, row (a number of its own), n_a, n_b, n_groups, n_links, groups, and its id ``pairs`` with the ``links`` of each.

    A pair is A's id times 2**20 plus B's.
    """

    def tasks(batches):
        encoder, row = worker_tokenizers(byte_path, piece_path), TaskContext.get().partitionId() << 40
        for batch in text_chunks(batches, "text", chunk):
            found = align_batch(encoder, texts_of(batch.column("text")))
            owner, pair, links = linked_pairs(found)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=batch.num_rows)))).astype(np.int32)
            cells = [batch.column("doc_id"), pa.array(row + np.arange(batch.num_rows))]
            cells += [pa.array(x.astype(np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            cells += [group_texts(found).cast(pa.string()), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (pair, links))]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + [T.StructField(n, T.LongType()) for n in ("row", *COUNTED)])
    schema = T.StructType([*schema.fields, T.StructField("groups", T.StringType()), *PAIRS.fields])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tasks, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of rows of ``aligned``: how many rows hold each pair of ids linked, and whether no pair of its A id has more."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    most = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("a", F.shiftright("pair", B_BITS)).join(most, "a")
    out = written(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")
    dropped(counts)
    return out


def _least_sent(counts: DataFrame, most_sent: int) -> tuple[int, bool]:
    """The count from which on ``most_sent`` pairs or fewer are left, a power of two, and whether it leaves any out."""
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()  # 63 rows at most
    least, total = 1 << 62, 0
    for level, n in sorted(((r["level"], r["count"]) for r in levels), reverse=True):
        if (total := total + n) > most_sent:
            return least, True
        least = 1 << level
    return 1, False


def align(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: dict[str, Column] | None = None,
    most_sent: int = 1 << 20,
    chunk: int = 2 << 20,
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and ``groups`` or what ``keep`` makes of it.

    A encodes a space and the text, B the text (it adds the space); special tokens' strings are plain text. Where tokens of A and B end
    at the same byte a group ends; ``groups`` has the ids of each (``1,2|7;3|8,9``). All A-B pairs of a group are links; the count of an id pair is
    the number of rows that hold it linked. ``n_best`` are the links whose count is the highest of their A id, ``count_sum`` adds the counts up over
    links. Texts that are null, empty or not spelled by their tokens (such as those with a literal U+2581) have no tokens: zeros and an empty ``groups``.
    Rows that repeat a doc_id or a text are documents of their own; other columns are not used; an empty table has no rows. Every text is encoded once;
    its pairs are written to the shared folder, and ``keep`` (columns computed from ``groups``, such as a digest) replaces the groups there. The arrays of
    one text lie in one task's memory, about 150 bytes for each byte of it.
    """
    keep = keep or {"groups": F.col("groups")}
    rows = aligned(docs, byte_path, piece_path, doc_id=doc_id, text=text, chunk=chunk)
    rows = written(rows.select("doc_id", "row", *COUNTED, *(c.alias(n) for n, c in keep.items()), *PAIRS.names), "aligned")
    counts = pair_counts(rows)
    least, rest = _least_sent(counts, most_sent)
    sent = counts.where(F.col("n") >= least).toArrow()  # most_sent rows at most
    order = np.argsort(sent.column("pair").to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(tuple(sent.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    def tasks(batches):
        known, known_n, known_best = shared.value
        for batch in batches:
            per_text = pc.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False).astype(np.int64)
            pair, links = (pc.list_flatten(batch.column(c)).to_numpy() for c in PAIRS.names)
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = [sums_by(np.where(hit, x[at] * links, 0) if len(known) else 0 * links, per_text) for x in (known_best, known_n)]
            rare = np.concatenate(([0], np.cumsum(sums_by((~hit).astype(np.int64), per_text)))).astype(np.int32)
            cells = [batch.column(c) for c in names] + [pa.array(x) for x in sums] + [pa.ListArray.from_arrays(pa.array(rare), pa.array(x[~hit])) for x in (pair, links)]
            yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    names = ("doc_id", "row", *COUNTED, *keep)
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), *PAIRS.fields])
    out = rows.mapInArrow(tasks, schema)
    shown = ("doc_id", *COUNTED, "n_best", "count_sum", *keep)
    if not rest:
        dropped(counts)
        return out.select(*shown)
    out = written(out, "looked-up")
    dropped(rows)
    rare = out.select("row", F.explode(F.arrays_zip(*PAIRS.names)).alias("r")).select("row", F.col("r.pairs").alias("pair"), "r.links")
    more = rare.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(
        F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more")
    )
    both = out.join(more, "row", "left")
    total = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
    return both.withColumns(total).select(*shown)
