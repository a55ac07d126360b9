"""Segmentation-marginalised unigrams against every segmentation of short words."""

import numpy as np
import pytest

from kmerloom.llm import language

PIECES = ["a", "b", "ab", "ba", "aba", "bb", "▁", "▁a", "▁ab"]


def segmentations(vocabulary, word):
    """Each segmentation as a list of piece numbers; a character that is no piece is the unknown one."""
    known = {p: i for i, p in enumerate(vocabulary.pieces)}
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        number = known.get(word[:n], len(known) if n == 1 else None)
        if number is not None:
            for rest in segmentations(vocabulary, word[n:]):
                yield [number, *rest]


@pytest.fixture
def model():
    vocabulary = language.Vocabulary(PIECES)
    chances = np.random.default_rng(1).dirichlet(np.ones(len(PIECES)), 3).T
    return vocabulary, np.vstack([chances, np.full((1, 3), language.UNKNOWN), np.zeros((1, 3))])


@pytest.mark.parametrize("short", [language.SHORT, 0])
def test_forward_and_expectations_are_sums_over_all_segmentations(monkeypatch, model, short):
    monkeypatch.setattr(language, "SHORT", short)
    vocabulary, chances = model
    words = ["▁ab", "▁abab", "▁bbaba", "▁axb", "▁ababababa", "▁ab"]
    scores = language.forward(vocabulary, chances, words)
    uses, likelihood = np.zeros(len(chances)), 0.0
    counts = np.array([3.0, 1.0, 2.0, 1.0, 5.0, 1.0])
    for word, score, count in zip(words, scores, counts):
        ways = list(segmentations(vocabulary, word))
        chance = np.array([np.prod(chances[w], axis=0) for w in ways])
        assert np.allclose(np.log(chance.sum(0)), score)
        likelihood += count * np.log(chance[:, 1].sum())
        for w, p in zip(ways, chance[:, 1] / chance[:, 1].sum()):
            for piece in w:
                uses[piece] += count * p
    got, log = language.expected(vocabulary, chances[:, 1], words, counts)
    assert np.allclose(got, uses) and np.isclose(log, likelihood)


def test_long_words_are_not_cut(monkeypatch, model):
    vocabulary, chances = model
    word = "▁" + "abbab" * 5
    short = language.forward(vocabulary, chances, [word])
    monkeypatch.setattr(language, "SHORT", 0)
    assert np.allclose(language.forward(vocabulary, chances, [word]), short)
    assert np.isfinite(language.forward(vocabulary, chances, ["ab" * 20_000])).all()


def test_edges(spark):
    from kmerloom.llm.queries import PIECES as NAME
    from kmerloom.llm.queries import tokenizer_path

    rows = [("the cat and the dog", "en", 1), ("der hund und die katze", "de", 2), (None, "en", 3), ("", "de", 4), ("12 34", None, 5), ("x" * 1_000, "en", 6), ("the cat and the dog", "en", 1)]
    docs = spark.createDataFrame(rows, "text string, lang string, lang_pred int")
    model = language.train(docs, tokenizer_path(NAME))
    found = language.identify(docs, model).collect()
    assert [r.lang_pred for r in found if r.text and r.lang][:2] == ["en", "de"]
    assert all((r.lang_pred, r.lang_score) == ("und", 0.0) for r in found if not r.text or r.text == "12 34")
    assert len({(r.lang_pred, r.lang_score) for r in found if r.text == "the cat and the dog"}) == 1
    none = language.train(docs.limit(0), tokenizer_path(NAME))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).collect() == []
