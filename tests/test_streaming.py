"""Streams against the batch form, in one micro-batch and in several."""

import pytest

from kmerloom.functions.kspace import KmerSpace
from kmerloom.operators import sets, sketch
from kmerloom.streaming import sketch as stream

SPACE = KmerSpace(4, 3)
CHUNKS = [(1, 0, "acgtACGT"), (1, 1, "g"), (1, 2, "xx"), (1, 3, None), (1, 4, "ttacgacgtacg"), (2, 0, "ac"), (2, 1, "gt"), (3, 0, ""), (4, 0, "acgtagctagctagcatcgatcagc")]


def whole(spark):
    texts = {}
    for s, _, t in CHUNKS:
        texts[s] = texts.get(s, "") + (t or "")
    df = spark.createDataFrame(list(texts.items()), "seq_id long, text string")
    digits = df.select("seq_id", sketch.symbols("text", "acgt", lower=True).alias("digits"))
    found = sketch.sketch(digits, SPACE, lambda m: sets.in_mykkeltveit(SPACE, m))
    return sorted((r.seq_id, r.gap, r.n) for r in sketch.histogram(found, "seq_id").collect())


@pytest.mark.parametrize("batches", [1, 3])
def test_chunked_sequences_have_the_gaps_of_whole_ones(spark, tmp_path, batches):
    for b in range(batches):
        part = [c for i, c in enumerate(sorted(CHUNKS, key=lambda c: c[1])) if i * batches // len(CHUNKS) == b]
        spark.createDataFrame(part, "seq_id long, chunk int, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    chunks = spark.readStream.schema("seq_id long, chunk int, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    rows = stream.drained(stream.stream_gaps(chunks, SPACE, lambda m: sets.in_mykkeltveit(SPACE, m)), "test")
    assert sorted((r.seq_id, r.gap, r.n) for r in stream.stream_histogram(rows, "seq_id").collect()) == whole(spark)


def test_digits_by_any_alphabet():
    assert stream.digits_of("aéB x", "béa").tolist() == [2, 1, 0]
    assert stream.digits_of(None, "ab").tolist() == []
