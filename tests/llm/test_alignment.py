"""Cross-tokenizer alignment against both tokenizers on whole texts."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from kmerloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return alignment.TwoTokenizers(A, B, most=500)


def groups(encoder, text):
    """Groups of a text by encoding it whole, or None."""
    raw = (" " + (text or "")).encode()
    a, b = encoder.a.encode(" " + (text or ""), add_special_tokens=False).ids, encoder.b.encode(text or "")
    if not text or any(b"".join(x[i] for i in y) != raw for x, y in ((encoder.a_bytes, a), (encoder.b_bytes, b))):
        return []
    ends = [np.cumsum([len(x[i]) for i in y]).tolist() for x, y in ((encoder.a_bytes, a), (encoder.b_bytes, b))]
    out, begin = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([i for i, e in zip(y, x, strict=True) if begin < e <= end] for y, x in zip((a, b), ends, strict=True)))
        begin = end
    return out


def shown(found):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)


PARTS = ["a", "the", "ing", "word", " ", " ", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "😀", "'s", "12", "...", "<|endoftext|>", "<s>", " ", "　", " ", "\x00", "\r", "=", "xyzzyq"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 30))) for _ in range(n)]
    return texts + ["a▁b", "", None, "日本語のテキスト" * 30, "x" * 3000, "\n", " ", "\nfoo", "foo\n", "a\n\nb", " a", "a ", "same text", "same text", "qzj" * 400]


def test_units_cut_tokens_nowhere(encoder):
    texts = odd_texts(2000)
    for part in np.array_split(np.array(texts, object), 9):
        batch = alignment.align_batch(encoder, pa.array([t or "" for t in part], pa.large_string()))
        assert alignment.group_texts(batch).to_pylist() == [shown(groups(encoder, t)) for t in part]


@pytest.mark.parametrize("most_sent, large", [(1 << 20, 1 << 12), (40, 1), (0, 3)])
def test_equals_brute_force(spark, encoder, monkeypatch, most_sent, large):
    """All pairs sent, few and none; groups counted link by link and by their distinct ids."""
    monkeypatch.setattr(alignment, "LARGE", large)
    rows = [(i % 50, t, i) for i, t in enumerate(odd_texts(150))]
    found = [groups(encoder, t) for _, t, _ in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    count = Counter(p for links in linked for p in links)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    expected = [
        (d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(m.values()), sum(n for p, n in m.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in m.items()), shown(g))
        for (d, _, _), g, m in zip(rows, found, linked, strict=True)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups int").repartition(5)
    got = alignment.align(df, A, B, most_sent=most_sent, chunk=700)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
