"""Near-duplicate classes and links against brute force on planted clusters."""

import random

import pytest

import corpus_pipeline
from kmerloom.llm import near_dups


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def hub_and_copies(seed, n, hub_id):
    """A hub and copies of it with three edited words each, at 0.86 of the hub and about 0.74 of one another."""
    r = random.Random(seed)
    hub = [f"{seed}w{i}" for i in range(200)]
    ids = [i for i in range(n + 1) if i != hub_id]
    docs = {hub_id: hub}
    for i in ids:
        copy = list(hub)
        for at in r.sample(range(4, 195, 6), 3):
            copy[at] = f"edit{r.random()}"
        docs[i] = copy
    return docs


@pytest.mark.parametrize("block_members", [512, 8])
def test_hub_that_is_not_the_least_joins_its_copies(spark, block_members):
    docs = hub_and_copies("a", 60, 37)
    grams = {d: shingles(w) for d, w in docs.items()}
    linked = {(a, b) for a in docs for b in docs if a < b and jaccard(grams[a], grams[b]) >= 0.8}
    assert {b if a == 37 else a for a, b in linked if 37 in (a, b)} == docs.keys() - {37}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    rows = {r.doc_id: r for r in near_dups.near_duplicates(df, block_members=block_members).collect()}
    assert {r.class_id for r in rows.values()} == {0}
    for d, r in rows.items():
        assert r.n_links == sum(d in pair for pair in linked)


def test_pipeline_keeps_other_texts_of_one_doc_id(spark):
    """Rows of one doc_id with different texts are judged by text: only the near copy of a smaller document goes."""
    one, near, other, third = ([f"{name}{i}" for i in range(120)] for name in ("a", "a", "b", "c"))
    near[60] = "edit"
    rows = [(1, one), (2, near), (2, other), (2, other), (3, third), (3, one), (None, one), (4, ["!!!"]), (4, ["???"])]
    rows = [(d, " ".join(w), "en") for d, w in rows]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    expected = [rows[0], rows[2], rows[4], rows[6], rows[7], rows[8]]
    assert sorted(map(tuple, kept), key=str) == sorted(expected, key=str)
