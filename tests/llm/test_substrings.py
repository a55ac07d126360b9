"""Substring deduplication against every window of small corpora."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from kmerloom.llm import substrings

BIG = 2**63 - 1


def corpus():
    r = random.Random(5)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 6))) for _ in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 120))) for _ in range(40)]
    docs = []
    for i in range(150):
        kind, text = r.random(), r.choice(base)
        if 0.3 < kind < 0.6:
            other, at = r.choice(base), r.randrange(len(text) + 1)
            text = text[:at] + r.choice(["", "X", "é"]) + other[r.randrange(len(other) + 1) :]
        elif 0.6 < kind < 0.8:
            text = r.choice(["a", "ab"]) * r.randrange(0, 150)
        elif kind > 0.8:
            text = " ".join(r.choice(words) for _ in range(80))
        docs.append((i, text))
    return [*docs, (300, None), (301, ""), (7, "one doc_id, two texts " + base[3]), (None, base[4] + "zz"), (None, base[4] + "zz")]


def brute_force(docs):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], BIG), BIG if d is None else d)
    rows = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (BIG if d is None else d):
                gone[i : i + 50] = True
        rows.append((d, len(b), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(rows, key=str)


@pytest.mark.parametrize("hot_blocks", [128, 2])
@pytest.mark.parametrize("cover", ["difference", "synchronizing"])
def test_against_brute_force(spark, cover, hot_blocks):
    docs = corpus()
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, window int").repartition(8)
    rows = substrings.remove_repeats(df, cover=cover, hot_blocks=hot_blocks, block_bytes=3000, bucket_bytes=4000).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in rows), key=str) == brute_force(docs)
    for r in rows:
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.removed_spans)


@pytest.mark.parametrize("cover", ["difference", "synchronizing"])
def test_long_texts_are_taken_in_overlapping_pieces(cover):
    """Every window of a text longer than a piece has an anchor, and only windows of one text have one."""
    r = random.Random(1)
    raw = np.frombuffer("".join(r.choice("abc") for _ in range(substrings.PIECE * 2 + 999)).encode(), np.uint8)
    offsets = np.array([0, 30, 500, len(raw) - 60, len(raw)])
    _, _, first, last = substrings.anchors(raw, offsets, 50, cover)
    seen = np.zeros(len(raw) + 1, np.int64)
    np.add.at(seen, first, 1)
    np.add.at(seen, last + 1, -1)
    seen = np.cumsum(seen)[:-1]
    may = np.zeros(len(raw), bool)
    for a, z in zip(offsets[:-1], offsets[1:]):
        may[a : max(a, z - 49)] = True
    assert ((seen > 0) == may).all()


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "prefix_hashes", lambda raw, n: np.zeros(len(raw), np.uint64))
    body = np.frombuffer(b"x" * 60 + b"y" * 60 + b"x" * 60, np.uint8)
    assert substrings._again(body, np.array([0, 60, 120, 1]), np.array([5, 1, 9, 7]), 50).tolist() == [False, False, True, True]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_a_block_sends_one_batch_to_all_buckets():
    """Blocks times buckets grows with the square of the input, so nothing may be done for each pair that is not cheap: before, each was a batch of its own."""
    r, bits = np.random.default_rng(1), 43
    names = [substrings.distinct(r.integers(0, 1 << bits, 30_000).astype(np.uint64)) for _ in range(3)]
    names[1] = substrings.distinct(np.concatenate((names[1], names[0][::7], names[2][::5])))
    sent = [substrings.sent_names(b, x, 2048) for b, x in enumerate(names)]
    assert [x.num_rows for x in sent] == [len(set((x >> np.uint64(32)).tolist())) for x in names]
    assert max(x.num_rows for x in sent) == 2048
    found = {b: [] for b in range(3)}
    rows = pa.Table.from_batches(sent)
    for b in range(2048):
        for row in substrings.names_again(rows.filter(pc.equal(rows["bucket"], b)), 2).to_pylist():
            assert row["hot"] is None
            found[row["block_id"]].append(row)
    every, times = np.unique(np.concatenate(names), return_counts=True)
    for b, x in enumerate(names):
        assert np.array_equal(substrings.listed(found[b]), np.intersect1d(x, every[times > 1]))


@pytest.mark.parametrize("cover", ["difference", "synchronizing"])
def test_contexts_sent_in_one_batch_come_back_whole(cover):
    text = "".join(random.Random(2).choices("abcdefgh", k=3000)) * 2
    raw, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 3000, 6000])
    none = np.zeros(0, np.uint64)
    contexts = substrings.Contexts(raw, offsets, np.array([4, 9]), none, 50, cover, 35)
    sent = substrings._sends(raw, 7, contexts, none, 35, 8)
    assert isinstance(sent, pa.RecordBatch)
    gone = np.zeros(6000, bool)
    for i in range(sent.num_rows):
        _, first, last = substrings._resolve(pa.Table.from_batches([sent.slice(i, 1)]), 50)
        for a, z in zip(first, last, strict=True):
            gone[a : z + 1] = True
    assert gone[3000:5951].all() and not gone[:3000].any() and not gone[5951:].any()
