"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

A document is a weighted set of word shingles. The plane of weight and rank over each element is split into regions, one for each
doubling of the weight; a hash throws darts into them, a Poisson process of one dart a unit of area, and a dart counts where it falls under the
element's weight. Each dart names a coordinate, and the signature keeps the earliest dart of each, so two signatures agree in
a coordinate with the chance of the weighted Jaccard similarity. About k ln k + 2k darts a document fall within reach; every region is
tried once at least, so the work is linear in the number of elements.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, mix64, sums_by, text_chunks, texts_of, written
from .components import connected_components
from .wordhash import Words, grams, sequence_key, words_of

CELL, DART = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def elements(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each shingle of each text once: its hash, its number of uses, and the number of shingles in each text.

    A text of fewer words than a shingle, but not none, is one shingle.
    """
    left, owner = words.left, words.owner
    gram = grams(words.hashes, shingle)
    use = left >= shingle
    for n in range(1, shingle):
        short = words.first[words.counts == n]
        gram[short] = grams(words.hashes, n)[short]
        use[short] = True
    gram, owner = gram[use], owner[use]
    order = np.argsort(mix64(gram + owner.astype(np.uint64) * CELL))
    g, o = gram[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    uses, place = np.diff(np.append(at, len(g))), order[at]
    by = np.argsort(place)
    return gram[place[by]], uses[by], np.bincount(owner[place], minlength=len(words.counts))


def unit_cells(gram: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """A hash for each use of each shingle: shared cells are the lesser uses of shared shingles."""
    number = np.arange(int(uses.sum())) - np.repeat(np.cumsum(uses) - uses, uses)
    return mix64(np.repeat(gram, uses) + number.astype(np.uint64) * CELL)


def dart_minhash(gram: np.ndarray, weight: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Earliest rank for each of ``k`` coordinates of each text (inf where a text has no weight); weights are positive numbers."""
    out = np.full((len(counts), k), np.inf)
    weight = weight.astype(np.float64)
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(owner, weight, len(counts))
    levels = np.ceil(np.log2(weight + 1)).astype(np.int64)
    element = np.repeat(np.arange(len(gram)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    region, width, of = mix64(gram[element] + level.astype(np.uint64) * DART), np.exp2(level), owner[element]
    reach = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = counts > 0
    while todo.any():
        own = np.flatnonzero(todo[of])
        rank, throw = np.zeros(len(own)), 0
        while len(own):
            throw += 1
            spin = mix64(region[own] + np.uint64(throw * int(DART) & (2**64 - 1)))
            rank = rank - np.log(((spin >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[own]
            near = np.flatnonzero(rank <= reach[of[own]])
            own, rank = own[near], rank[near]
            spin = mix64(spin[near] ^ DART)
            high = width[own] * (1 + (spin >> np.uint64(32)).astype(np.float64) * 2.0**-32) - 1
            under = np.flatnonzero(high < weight[element[own]])
            coordinate = ((spin[under] & np.uint64(2**32 - 1)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(out.reshape(-1), of[own[under]] * k + coordinate, rank[under])
        todo &= np.isinf(out).any(1)
        reach = reach * 2
    return out


def with_sequence_key(docs: DataFrame, names: tuple[str, str, str], text: str = "text") -> DataFrame:
    """``docs`` with two keys of each text's word sequence and whether it has words, under ``names``."""

    def tasks(batches):
        for batch in text_chunks(batches, text, 2 << 20):
            words = words_of(texts_of(batch.column(text)))
            more = [*(pa.array(k) for k in sequence_key(words)), pa.array(words.counts > 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    more = [T.StructField(c, t) for c, t in zip(names, (T.LongType(), T.LongType(), T.BooleanType()), strict=True)]
    return docs.mapInArrow(tasks, T.StructType([*docs.schema.fields, *more]))


def signatures(docs: DataFrame, *, shingle: int = 5, bands: int = 16, rows: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key1, key2, size, bands): hashes of the word sequence, uses of shingles, hashes of the bands; bands null without words."""

    def tasks(batches):
        for batch in text_chunks(batches, "text", 2 << 20):
            words = words_of(texts_of(batch.column("text")))
            gram, uses, counts = elements(words, shingle)
            ranks = dart_minhash(gram, uses, counts, bands * rows).view(np.uint64).reshape(len(counts), bands, rows)
            band = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(counts), 1), np.uint64)
            for r in range(rows):
                band = mix64(band * CELL + ranks[:, :, r])
            key1, key2 = sequence_key(words)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * bands, pa.int32()), pa.array(band.view(np.int64).ravel()))
            lists = pc.if_else(pa.array(words.counts > 0), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key1), pa.array(key2), pa.array(sums_by(uses, counts), pa.int64()), lists], names=["doc_id", "key1", "key2", "size", "bands"])

    kind = docs.schema[doc_id].dataType
    longs = [T.StructField(c, T.LongType()) for c in ("key1", "key2", "size")]
    schema = T.StructType([T.StructField("doc_id", kind), *longs, T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tasks, schema)


def profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """(key1, key2, profile): sorted 64-bit hashes of the cells of each word sequence, so that shared cells are shared shingles by use."""

    def tasks(batches):
        for batch in text_chunks(batches, "text", 2 << 20):
            words = words_of(texts_of(batch.column("text")))
            gram, uses, counts = elements(words, shingle)
            cells, sizes = unit_cells(gram, uses), sums_by(uses, counts)
            data = [np.sort(cells[e - n : e]).tobytes() for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in sequence_key(words)), pa.array(data, pa.binary())], names=["key1", "key2", "profile"])

    return docs.select("text").mapInArrow(tasks, "key1 long, key2 long, profile binary").dropDuplicates(["key1", "key2"])


def similar(cells: list[np.ndarray], asked: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the ``asked`` pairs (a symmetric mask) have a weighted Jaccard similarity of ``threshold`` or more."""
    sizes = np.array([len(x) for x in cells])
    asked = asked & (np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes))
    shared = np.zeros(asked.shape, np.float32)
    one, two = np.nonzero(np.triu(asked))
    if len(one) <= 4 * len(cells):
        for i, j in zip(one.tolist(), two.tolist(), strict=True):
            both = np.concatenate((cells[i], cells[j]))
            both.sort()
            shared[i, j] = shared[j, i] = (both[1:] == both[:-1]).sum()
    else:
        _, column, uses = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
        number = np.cumsum(uses > 1) - 1
        owner, more = np.repeat(np.arange(len(cells)), sizes), uses[column] > 1
        owner, column = owner[more], number[column[more]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            part = slice(*np.searchsorted(column, (start, start + 4096)))
            used = np.zeros((len(cells), 4096), np.float32)
            used[owner[part], column[part] - start] = 1
            shared += used @ used.T
    return asked & (shared >= threshold * np.maximum(np.add.outer(sizes, sizes) - shared, 1))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a link matrix."""
    seen, edges = ~linked.any(1), []
    for root in range(len(linked)):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & ~seen).tolist()
            seen[new] = True
            edges += [(at, n) for n in new]
            todo += new
    return edges


PLACE = ["band", "hash", "low", "high"]


def compared(placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): links that join all that are similar (n null), and the number n of links that each ``a`` has (b null).

    ``placed`` (node, bands, profile, block and PLACE) has one row for each member of each pair of blocks (low, high) of a bucket.
    Every pair of members is compared in the first band that both share.
    """

    def one_group(rows: pa.RecordBatch, bands: np.ndarray, cells: list[np.ndarray], block: np.ndarray, across: bool, band: int):
        asked = block[:, None] != block[None, :] if across else ~np.eye(len(block), dtype=bool)
        for b in range(band):
            asked &= bands[:, None, b] != bands[None, :, b]
        if not asked.any():
            return
        linked = similar(cells, asked, threshold)
        edges, degree = _forest(linked), linked.sum(1)
        some = np.flatnonzero(degree)
        if len(some):
            node = rows.column("node")
            yield pa.concat_arrays([node.take(pa.array([a for a, _ in edges])), node.take(pa.array(some))]), pa.concat_arrays(
                [node.take(pa.array([b for _, b in edges])), pa.nulls(len(some), node.type)]
            ), pa.concat_arrays([pa.nulls(len(edges), pa.int64()), pa.array(degree[some], pa.int64())])

    def groups(rows: pa.RecordBatch, edges: np.ndarray):
        lists = rows.column("bands").combine_chunks() if isinstance(rows.column("bands"), pa.ChunkedArray) else rows.column("bands")
        bands = pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else None
        cells = [np.frombuffer(x, np.uint64) for x in rows.column("profile").to_pylist()]
        block, band, low, high = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("block", "band", "low", "high"))
        found = []
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            found += one_group(rows.slice(a, z - a), bands[a:z], cells[a:z], block[a:z], low[a] != high[a], int(band[a]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([f[k] for f in found]) for k in range(3)], names=["a", "b", "n"])

    def tasks(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            new = np.zeros(held.num_rows - 1, bool)
            for c in PLACE:
                x = held.column(c).to_numpy(zero_copy_only=False)
                new |= x[1:] != x[:-1]
            edges = np.concatenate(([0], np.flatnonzero(new) + 1))
            yield from groups(held.slice(0, int(edges[-1])), edges)
            held = held.slice(int(edges[-1]))
        if held is not None:
            yield from groups(held, np.array([0, held.num_rows]))

    kind = placed.schema["node"].dataType
    dealt = placed.select("node", "bands", "profile", "block", *PLACE).repartition(*PLACE).sortWithinPartitions(*PLACE)
    return dealt.mapInArrow(tasks, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType())]))


def duplicate_classes(
    docs: DataFrame,
    *,
    threshold: float = 0.8,
    shingle: int = 5,
    bands: int = 16,
    rows: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
    block_members: int = 512,
    block_cells: int = 1 << 19,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key1, key2, worded, node, class and links.

    A word sequence (A-Z lower-cased, signs ignored) is a node: its least doc_id and its two keys. Every two nodes that share a band are
    compared once, in the first band they share: the members of a bucket are dealt at random to blocks of about ``block_members``
    (and ``block_cells`` shingles), and each pair of blocks is a group of its own. Of buckets with the same members one is enough.
    ``class`` is the least node of a class and ``links`` counts a node's links; both are null where worded is false or doc_id null.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = written(signatures(source, shingle=shingle, bands=bands, rows=rows), "signatures")
    worded = signed.where("bands IS NOT NULL AND doc_id IS NOT NULL")
    chosen = worded.groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    chosen = written(chosen.select(F.struct("doc_id", "key1", "key2").alias("node"), "bands", "size"), "representatives")
    member = chosen.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    n_blocks = F.ceil(F.greatest(F.count("*") / F.lit(block_members), F.sum("size") / F.lit(block_cells))).cast("int")
    members = [F.bit_xor("node.key1").alias("x1"), F.bit_xor("node.key2").alias("x2"), F.min("node").alias("least"), F.max("node").alias("most")]
    buckets = member.groupBy("band", "hash").agg(F.count("*").alias("n"), n_blocks.alias("n_blocks"), *members).where("n > 1")
    buckets = buckets.groupBy("n", "x1", "x2", "least", "most").agg(F.min(F.struct("band", "hash", "n_blocks")).alias("o")).select("o.*")
    opened = written(member.drop("size").join(buckets, ["band", "hash"]), "buckets")
    wanted = opened.select("node").distinct()
    texts = source.hint("merge").join(wanted.select("node.doc_id").distinct(), "doc_id", "left_semi")
    known = chosen.join(wanted, "node", "left_semi").select("node", "bands", F.col("node.key1").alias("key1"), F.col("node.key2").alias("key2"))
    cells = written(known.hint("merge").join(profiles(texts, shingle), ["key1", "key2"]).drop("key1", "key2"), "profiles")
    block = F.pmod(F.xxhash64("node.key1", "node.key2", "band"), F.col("n_blocks")).cast("int")
    placed = opened.select("node", "band", "hash", "n_blocks", block.alias("block"))
    placed = placed.select("node", "band", "hash", "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    placed = placed.select("node", "band", "hash", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    links = written(compared(placed.hint("merge").join(cells, "node"), threshold), "links")
    dropped(opened, cells)
    degree = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    joined = connected_components(links.where("b IS NOT NULL").select("a", "b").distinct())
    classes = chosen.select("node").join(joined.join(degree, "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.col("node.key1").alias("key1"), F.col("node.key2").alias("key2")
    )
    own = F.col("bands").isNotNull() & F.col("doc_id").isNotNull()
    out = signed.select("doc_id", "key1", "key2", own.alias("own"), F.col("bands").isNotNull().alias("worded")).join(classes, ["key1", "key2"], "left")
    out = written(out.select("doc_id", "key1", "key2", "worded", *(F.when(F.col("own"), F.col(c)).alias(c) for c in ("node", "class", "links"))), "near-classes")
    dropped(signed, chosen, links, joined)
    return out


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least doc_id of its class) and n_links.

    Similarity is the exact weighted Jaccard similarity of word shingles; links of at least ``threshold`` make classes. n_links counts
    the links of a row's word sequence to others. Texts without words and rows without doc_id are classes of their own (class_id = doc_id);
    rows that repeat a doc_id with another text are in the class of that text; repeated rows are in one class and count as one text. Texts of any
    length are compared whole; a class is named by its least doc_id, whatever ties. An empty table has no rows; other columns are not carried. Options
    are those of ``duplicate_classes``.
    """
    return duplicate_classes(docs, **options).select(
        "doc_id", F.coalesce("class.doc_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links")
    )
