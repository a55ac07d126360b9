"""Benchmark decontamination by winnowing.

A window is ``length`` consecutive words of a benchmark item (the whole item if it is shorter). The least k-gram hash of a window
is its fingerprint, so a window that a document shares with the benchmark has the same fingerprint on either side. Document fingerprints are
joined with those of the benchmark; the windows that they come from are then joined by their words, so a hit never rests on a hash,
and hit windows that overlap are extended to spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, fresh, text_chunks, texts_of, written
from .wordhash import LOWER, Words, byte_buffer, grams, sequence_key, sliding, words_of


def window_prints(words: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of every window of ``n`` words: the least of its k-gram hashes."""
    least = sliding(grams(words.hashes, k), n - k + 1, np.minimum)
    starts = np.flatnonzero(words.left >= n)
    return starts, least[starts]


def window_texts(texts: pa.Array, words: Words, starts: np.ndarray, n: int) -> pa.Array:
    """The ``n`` words from each start on, A-Z lower-cased, each with a space after it."""
    raw, _ = byte_buffer(texts)
    word = (starts[:, None] + np.arange(n)[None, :]).ravel()
    size = (words.ends - words.starts)[word] + 1
    ends = np.cumsum(size)
    index = np.repeat(words.starts[word] - (ends - size), size) + np.arange(int(size.sum()))
    index[ends - 1] = 0
    data = LOWER[raw[index]] if len(index) else np.zeros(0, np.uint8)
    data[ends - 1] = 32
    offsets = np.concatenate(([0], ends))[::n].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


def among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Mask of x that are in ``sorted_values``."""
    if not len(sorted_values) or not len(x):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def benchmark_windows(items: DataFrame, length: int, k: int) -> DataFrame:
    """(n, print, words, item_id) of every window of columns item_id and text."""

    def tasks(batches):
        for batch in text_chunks(batches, "text", 1 << 20):
            texts = texts_of(batch.column("text"))
            words = words_of(texts)
            for n in sorted({min(length, int(c)) for c in words.counts if c}):
                starts, prints = window_prints(words, n, min(k, n))
                counts = words.counts[words.owner[starts]]
                own = counts >= length if n == length else counts == n
                starts, prints = starts[own], prints[own]
                ids = batch.column("item_id").take(pa.array(words.owner[starts]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), n, np.int32)), pa.array(prints.view(np.int64)), window_texts(texts, words, starts, n), ids], names=["n", "print", "words", "item_id"]
                )

    return items.mapInArrow(tasks, "n int, print long, words string, item_id string").distinct()


HIT = "key1 long, key2 long, start int, n int, words string"


def _hits(sent, k: int):
    """Windows whose fingerprint is among those sent (by window length), or among the row's own column ``prints``.

    A window that very many documents share is a row for each; its items are one list of the other side of the join that follows.
    """

    def tasks(batches):
        for batch in text_chunks(batches, "text", 2 << 20):
            texts = texts_of(batch.column("text"))
            words = words_of(texts)
            keys, first = sequence_key(words), words.first
            known = sent.value if sent else _own_prints(batch)
            for n, prints in known.items():
                starts, least = window_prints(words, n, min(k, n))
                new = np.ones(len(least), bool)
                new[1:] = least[1:] != least[:-1]
                starts = starts[among(least[new], prints)[np.cumsum(new) - 1]] if len(starts) else starts
                for a in range(0, len(starts), 50_000):
                    part = starts[a : a + 50_000]
                    doc = words.owner[part]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(key[doc]) for key in keys), pa.array((part - first[doc]).astype(np.int32)), pa.array(np.full(len(part), n, np.int32)), window_texts(texts, words, part, n)],
                        names=["key1", "key2", "start", "n", "words"],
                    )

    return tasks


def _own_prints(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
    flat = pc.list_flatten(batch.column("prints"))
    n, prints = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return {int(x): np.unique(prints[n == x].view(np.uint64)) for x in np.unique(n)}


def _document_prints(lengths: list[int], k: int):
    """(key1, key2, n, print) of each document's windows, each fingerprint once."""

    def tasks(batches):
        for batch in text_chunks(batches, "text", 2 << 20):
            words = words_of(texts_of(batch.column("text")))
            keys = sequence_key(words)
            for n in lengths:
                starts, least = window_prints(words, n, min(k, n))
                doc = words.owner[starts]
                pairs = np.unique(np.column_stack((doc.astype(np.uint64), least)), axis=0) if len(doc) else np.zeros((0, 2), np.uint64)
                doc, least = pairs[:, 0].astype(np.int64), np.ascontiguousarray(pairs[:, 1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(key[doc]) for key in keys), pa.array(np.full(len(doc), n, np.int32)), pa.array(least)], names=["key1", "key2", "n", "print"])

    return tasks


def document_hits(docs: DataFrame, index: DataFrame, k: int, most_prints: int) -> DataFrame:
    """Windows of the column ``text`` whose fingerprints meet one of the ``index``.

    Up to ``most_prints`` fingerprints (8 bytes each) are counted and sent to the tasks; more are joined by a shuffle, and the texts that meet
    some are fetched by their word sequence. Both ways give the same windows.
    """
    spark = docs.sparkSession
    prints = index.select("n", "print").distinct()
    if prints.count() <= most_prints:
        found = prints.toPandas()
        known = {int(n): np.sort(part["print"].to_numpy().view(np.uint64)) for n, part in found.groupby("n")}
        return docs.mapInArrow(_hits(spark.sparkContext.broadcast(known), k), HIT)
    lengths = [r[0] for r in prints.select("n").distinct().collect()]
    met = docs.mapInArrow(_document_prints(lengths, k), "key1 long, key2 long, n int, print long").join(prints.hint("merge"), ["n", "print"], "left_semi")
    met = met.groupBy("key1", "key2").agg(F.collect_set(F.struct("n", "print")).alias("prints"))
    keyed = _keyed(docs, "text", ("key1", "key2", "n_words"))
    return keyed.join(met, ["key1", "key2"]).select("text", "prints").mapInArrow(_hits(None, k), HIT)


def _keyed(docs: DataFrame, text: str, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with two hashes of the word sequence and the number of words."""

    def tasks(batches):
        for batch in text_chunks(batches, text, 2 << 20):
            words = words_of(texts_of(batch.column(text)))
            more = [*(pa.array(x) for x in sequence_key(words)), pa.array(words.counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return docs.mapInArrow(tasks, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names)]))


SPANS = "array<struct<start:int,end:int>>"


def _spanned(batches):
    """Hit windows of a document as spans of words, and the number of words in them."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans, hit = [], []
        for windows in batch.column("windows").to_pylist():
            runs: list[list[int]] = []
            for w in sorted(windows, key=lambda w: (w["start"], w["n"])):
                if runs and w["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], w["start"] + w["n"])
                else:
                    runs.append([w["start"], w["start"] + w["n"]])
            spans.append([{"start": a, "end": z} for a, z in runs])
            hit.append(sum(z - a for a, z in runs))
        yield pa.RecordBatch.from_arrays([batch.column("key1"), batch.column("key2"), pa.array(hit, pa.int64()), pa.array(spans, kind), batch.column("items")], names=["key1", "key2", "n_hit", "hit_spans", "hit_items"])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    length: int = 10,
    k: int = 5,
    most_prints: int = 4 << 20,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (words from, to) and hit_items (sorted as strings).

    Equal word sequences are judged once, whatever their doc_id, so repeated rows are judged alike. Null texts have no words, items
    without words or item_id are never hit, repeated item_ids count once; texts of any length are taken whole. With an empty benchmark nothing is
    hit, an empty table stays empty. Columns of ``docs`` with the new names are replaced. ``most_prints`` bounds what is
    sent to every task (``document_hits``).
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_hit", "hit_spans", "hit_items")))
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    index = written(benchmark_windows(items, length, k), "benchmark-windows")
    hits = document_hits(docs.select(F.col(text).alias("text")), index, k, most_prints)
    lists = index.groupBy("n", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))  # a window in many items is one row
    met = hits.join(lists, ["n", "words"]).groupBy("key1", "key2")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    met = met.agg(F.collect_set(F.struct("start", "n")).alias("windows"), items.alias("items"))
    found = written(met.mapInArrow(_spanned, f"key1 long, key2 long, n_hit long, hit_spans {SPANS}, hit_items array<string>"), "contaminated")
    dropped(index)
    one, two = fresh(kept, "key1"), fresh(kept, "key2")
    keyed = _keyed(kept, text, (one, two, "n_words"))
    found = found.withColumnsRenamed({"key1": one, "key2": two})
    return keyed.join(found, [one, two], "left").select(
        *(F.col(f"`{c}`") for c in kept.columns),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("hit_spans", F.array().cast(SPANS)).alias("hit_spans"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"),
    )
