"""Language identification by segmentation-marginalised unigrams.

A fixed public piece vocabulary and, for each language, a probability of every piece. The
chance of a word is the sum over all its segmentations into pieces, by the forward
algorithm; pieces do not cross white space, so a text is the product of its words. Piece
probabilities are learned by expectation maximisation over the word counts of
all training documents.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, mix64, space_words, sums_by, text_chunks, texts_of, written

STRIP = "0123456789.,;:!?\"'()[]{}|*_-+=#@&%$€£~^`«»¿¡…<>/\\"
MARK = "▁"
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words longer than this are taken one by one, place after place, with totals scaled as they shrink; the sums are the same.
SHORT = 32
UNKNOWN = 1e-5
LEAST = 1e-7


def piece_texts(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, each once. Those with upper case are left out: words are lower-cased, so they never occur."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return list(dict.fromkeys(p for i in range(model.get_piece_size()) if not any(k(i) for k in kinds) and (p := model.id_to_piece(i)) == p.lower()))


class Vocabulary:
    """Piece numbers of substrings by small hash tables; what finds its slot taken goes to the next table."""

    BITS = 18

    def __init__(self, pieces: list[str]):
        self.pieces = [p for p in pieces if p]
        self.longest = max(map(len, self.pieces), default=1)
        self.keys = np.array([*map(self._hash, self.pieces), 0], np.uint64)
        self.tables: list[np.ndarray] = []
        left = np.arange(len(self.pieces))
        while len(left):
            slots, first = np.unique(self._slot(self.keys[left], len(self.tables)), return_index=True)
            table = np.full(1 << self.BITS, -1, np.int32)
            table[slots] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys * np.uint64(2 * level + 1)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        total = np.zeros(1, np.uint64)
        for c in piece:
            total = total * STEP + np.uint64(ord(c) + 1)
        return int(mix64(total)[0])

    def ids(self, raw: np.ndarray) -> np.ndarray:
        """Piece numbers of raw (unmixed) substring hashes; -1 where there is none."""
        key, found, own = mix64(raw), np.full(len(raw), -1, np.int32), np.arange(len(raw))
        for level, table in enumerate(self.tables):  # a key that finds its slot empty is in no further table either
            there = table[self._slot(key[own] if level else key, level)]
            own, there = own[there >= 0], there[there >= 0]
            equal = self.keys[there] == key[own]
            found[own[equal]] = there[equal]
            own = own[~equal]
            if not len(own):
                break
        return found


def lattice(vocabulary: Vocabulary, words: list[str]):
    """For words of one length: (start, length, words that have a piece there, piece numbers), in order of its end."""
    size = len(words[0])
    chars = np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size).astype(np.uint64) + np.uint64(1)
    edges = []
    for start in range(size):
        raw = np.zeros(len(words), np.uint64)
        for n in range(1, min(vocabulary.longest, size - start) + 1):
            raw = raw * STEP + chars[:, start + n - 1]
            ids = vocabulary.ids(raw)
            if n == 1:
                ids = np.where(ids < 0, len(vocabulary.pieces), ids)
            own = np.flatnonzero(ids >= 0)
            if len(own):
                edges.append((start, n, own, ids[own]))
    edges.sort(key=lambda e: e[0] + e[1])
    return size, edges


def by_length(words: list[str], most: int = 8_000):
    """Places of words of up to SHORT characters by their length, in groups of up to ``most``, then each longer word alone; empty ones are left out."""
    groups: dict[int, list[int]] = {}
    for i, size in enumerate(map(len, words)):
        if size:
            groups.setdefault(size, []).append(i)
    for size, places in groups.items():
        step = most if size <= SHORT else 1
        for a in range(0, len(places), step):
            yield places[a : a + step]


def long_lattice(vocabulary: Vocabulary, word: str) -> np.ndarray:
    """Piece numbers by end and length: [e, n-1] is the piece of n characters that ends at e (-1 where there is none)."""
    chars = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size, longest = len(chars), min(vocabulary.longest, len(chars))
    ids = np.full((size + 1, longest), -1, np.int32)
    raw = np.zeros(size, np.uint64)
    for n in range(1, longest + 1):
        raw = raw[: size - n + 1] * STEP + chars[n - 1 :]
        ids[n:, n - 1] = vocabulary.ids(raw)
    ids[1:, 0] = np.where(ids[1:, 0] < 0, len(vocabulary.pieces), ids[1:, 0])
    return ids


def long_totals(ids: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed chances of all segmentations up to each place of a long word, and the logarithm of the scale of each."""
    longest = ids.shape[1]
    total, scale = np.zeros((len(ids), chances.shape[1])), np.zeros((len(ids), chances.shape[1]))
    total[0] = 1
    for e in range(1, len(ids)):
        n = min(e, longest)
        total[e] = (total[e - n : e][::-1] * chances[ids[e, :n]]).sum(0)
        scale[e] = scale[e - 1]
        if total[e].min() < 1e-100:
            by = total[e].copy()
            start = e - n + 1
            total[start : e + 1] /= by
            scale[start : e + 1] += np.log(by)
    return total, scale


def forward(vocabulary: Vocabulary, chances: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language; ``chances`` has a row for each piece, then the
    unknown character, then zero."""
    out = np.zeros((len(words), chances.shape[1]))
    for places in by_length(words):
        if len(words[places[0]]) > SHORT:
            total, scale = long_totals(long_lattice(vocabulary, words[places[0]]), chances)
            out[places] = np.log(total[-1]) + scale[-1]
            continue
        size, edges = lattice(vocabulary, [words[i] for i in places])
        alpha = np.zeros((size + 1, len(places), chances.shape[1]))
        alpha[0] = 1
        for start, n, own, ids in edges:
            alpha[start + n, own] += alpha[start, own] * chances[ids]
        out[places] = np.log(alpha[size])
    return out


def expected(vocabulary: Vocabulary, chances: np.ndarray, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected uses of each piece, in one language, by words that occur ``counts`` times, and the words' log-likelihood."""
    total, likelihood = np.zeros(len(chances)), 0.0
    for places in by_length(words):
        if len(words[places[0]]) > SHORT:
            uses, log = _expected_long(vocabulary, chances, words[places[0]])
            total += counts[places[0]] * uses
            likelihood += counts[places[0]] * log
            continue
        size, edges = lattice(vocabulary, [words[i] for i in places])
        alpha, beta = np.zeros((size + 1, len(places))), np.zeros((size + 1, len(places)))
        alpha[0] = beta[size] = 1
        for start, n, own, ids in edges:
            alpha[start + n, own] += alpha[start, own] * chances[ids]
        for start, n, own, ids in sorted(edges, key=lambda e: -e[0]):
            beta[start, own] += beta[start + n, own] * chances[ids]
        likelihood += float((counts[places] * np.log(alpha[size])).sum())
        weight = counts[places] / alpha[size]
        for start, n, own, ids in edges:
            np.add.at(total, ids, alpha[start, own] * chances[ids] * beta[start + n, own] * weight[own])
    total[-1] = 0
    return total, likelihood


def _expected_long(vocabulary: Vocabulary, chances: np.ndarray, word: str) -> tuple[np.ndarray, float]:
    """Expected uses of each piece by one long word, and its log-likelihood: the same sums from the left and, on the word reversed, from the right."""
    ids, size = long_lattice(vocabulary, word), len(word)
    back = np.full_like(ids, -1)
    for n in range(1, ids.shape[1] + 1):
        back[n:, n - 1] = ids[n:, n - 1][::-1]
    (alpha, up), (beta, down) = (long_totals(x, chances[:, None]) for x in (ids, back))
    whole = float(np.log(alpha[-1, 0]) + up[-1, 0])
    uses = np.zeros(len(chances))
    for n in range(1, ids.shape[1] + 1):
        end = np.flatnonzero(ids[:, n - 1] >= 0)
        piece, start = ids[end, n - 1], end - n
        log = np.log(alpha[start, 0] * chances[piece] * beta[size - end, 0]) + up[start, 0] + down[size - end, 0] - whole
        uses += np.bincount(piece, np.exp(log), len(chances))
    return uses, whole


def plain_words(words: pa.Array) -> pa.Array:
    """Each word lower-cased, without signs and digits around it, and marked; empty where nothing is left."""
    plain = pc.utf8_lower(pc.utf8_trim(words.cast(pa.large_string()), STRIP))
    return pc.if_else(pc.equal(plain, ""), pa.scalar("", plain.type), pc.binary_join_element_wise(pa.scalar(MARK, plain.type), plain, pa.scalar("", plain.type)))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    chances: np.ndarray
    priors: np.ndarray
    name: str


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of columns text and lang; each task sums its own part first."""

    def tasks(batches):
        for batch in text_chunks(batches, "text", 3 << 20):
            langs = batch.column("lang").dictionary_encode()
            codes, counts, words = space_words(texts_of(batch.column("text")))
            of = np.repeat(langs.indices.to_numpy(zero_copy_only=False), counts).astype(np.int64)
            plain = plain_words(words).dictionary_encode()
            code = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            n = np.bincount(of * len(plain.dictionary) + code, minlength=1)
            pairs = np.flatnonzero(n)
            lang = langs.dictionary.take(pa.array(pairs // max(1, len(plain.dictionary)))).cast(pa.string())
            word = plain.dictionary.take(pa.array(pairs % max(1, len(plain.dictionary)))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(n[pairs], pa.int64())], names=["lang", "word", "n"])

    return docs.select("text", "lang").mapInArrow(tasks, "lang string, word string, n long").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocabulary: str, *, rounds: int = 3, tolerance: float = 0.01, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Model from every row of ``docs`` with a text and a language.

    ``vocabulary`` is the path of a sentencepiece model. Expectation maximisation starts from equal chances and ends when a round gains less than
    ``tolerance`` of the log-likelihood, or after ``rounds``. What reaches the driver is a number for each
    piece and language, whatever the size of the corpus; the language values are taken to be few. Without rows there are no languages.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    shares = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect())
    pieces = piece_texts(vocabulary)
    names = [name for name, _ in shares]
    vocab_size = len(Vocabulary(pieces).pieces)
    chances = np.full((vocab_size + 2, len(names)), 1 / max(1, vocab_size))
    chances[-2], chances[-1] = UNKNOWN, 0
    if names:
        words, before = written(word_counts(rows), "language-words"), -np.inf
        for _ in range(rounds):
            sent = rows.sparkSession.sparkContext.broadcast((pieces, names, chances))
            counted = words.mapInArrow(_expect(sent), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
            likelihood, counted = counted.loc[counted["piece"] < 0, "n"].sum(), counted[counted["piece"] >= 0]
            chances = np.zeros_like(chances)
            chances[counted["piece"], counted["lang"].map(names.index)] = counted["n"]
            chances[-2:] = 0
            chances = np.maximum((chances + 0.1) / (chances.sum(0) + 0.1 * vocab_size), LEAST)
            chances[-2], chances[-1] = UNKNOWN, 0
            if likelihood - before < tolerance * abs(likelihood):
                break
            before = likelihood
        dropped(words)
    priors = np.log(np.array([n for _, n in shares], float) / max(1, sum(n for _, n in shares)))
    return LanguageModel(tuple(names), tuple(pieces), chances, priors, uuid.uuid4().hex)


def _expect(sent, most: int = 60_000):
    def tasks(batches):
        pieces, names, chances = sent.value
        vocabulary = Vocabulary(pieces)
        totals, likelihood = np.zeros(chances.shape), np.zeros(len(names))
        held: list[pa.RecordBatch] = []

        def use():
            rows = pa.Table.from_batches(held)
            for j, name in enumerate(names):
                own = rows.filter(pc.equal(rows["lang"], name))
                if own.num_rows:
                    uses, log = expected(vocabulary, chances[:, j], own["word"].to_pylist(), own["n"].to_numpy().astype(float))
                    totals[:, j] += uses
                    likelihood[j] += log
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                use()
        if held:
            use()
        piece, j = np.nonzero(totals)
        cells = [*(names[x] for x in j), *names], [*piece.tolist(), *[-1] * len(names)], [*totals[piece, j].tolist(), *likelihood.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int32(), pa.float64()), strict=True)], names=["lang", "piece", "n"])

    return tasks


class WordScores:
    """Scores of the words met so far by one worker process, for one model; emptied when it holds ``most`` words."""

    def __init__(self, model: LanguageModel, most: int = 400_000):
        self.model, self.most = model, most
        self.vocabulary = Vocabulary(list(model.pieces))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1 << 14, len(self.model.languages)))

    def of(self, words: pa.Array) -> np.ndarray:
        """Log-probabilities of words (0 of the empty one)."""
        if len(self.rows) > self.most:
            self.forget()
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        new = [w for w in known if w not in self.rows]
        if new:
            n = len(self.rows)
            while n + len(new) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.scores[n : n + len(new)] = forward(self.vocabulary, self.model.chances, new)
            self.rows.update(zip(new, range(n, n + len(new)), strict=True))
        rows = np.fromiter(map(self.rows.__getitem__, known), np.int64, len(known))
        return self.scores[rows[coded.indices.to_numpy(zero_copy_only=False)]]


_SCORES: dict[str, WordScores] = {}


def worker_scores(model: LanguageModel) -> WordScores:
    """The scores that this worker process keeps from task to task, for the latest model only."""
    if model.name not in _SCORES:
        _SCORES.clear()
        _SCORES[model.name] = WordScores(model)
    return _SCORES[model.name]


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``docs`` with the likeliest language and its posterior probability.

    A null text, or one without a letter, is ``und`` with score 0, as is any text if the model knows no language. Words are
    what lies between spaces and line feeds; those of any length are summed whole. Of languages that tie, the first by name is taken; repeated rows are
    judged alike, an empty table stays empty. Columns with the new names are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in (lang_out, score_out)]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def tasks(batches):
        m = sent.value
        n_langs = len(m.languages)
        for batch in text_chunks(batches, text, 3 << 20):
            texts = texts_of(batch.column(text))
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            if n_langs:
                codes, counts, words = space_words(texts)
                scores = worker_scores(m).of(plain_words(words))
                totals = m.priors + np.column_stack([sums_by(scores[codes, j], counts) for j in range(n_langs)])
                best = totals.argmax(1)
                chance = 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1)
            else:
                best, chance, letters = np.zeros(len(texts), int), np.zeros(len(texts)), letters & False
            found = np.where(letters, np.array([*m.languages, "und"], object)[best], "und")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string()), pa.array(np.where(letters, chance, 0.0))], names=[*names, lang_out, score_out])

    return docs.select(*names).mapInArrow(tasks, schema)
