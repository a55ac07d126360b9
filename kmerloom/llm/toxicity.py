"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts words in labelled documents and gives each a log-odds with an
informative Dirichlet prior, lowered by its standard error so that rare words
prove nothing. Words without evidence share one small negative score, chosen so that the scores
are a log-likelihood ratio against clean text (the scale of the extreme-value law is then 1). A linear scan finds all
maximal segments; those that clean text of that length would rarely show are
passages, and their summed excess over the Gumbel location, calibrated on documents kept
apart, is the document's probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, space_words, text_chunks, texts_of, written

STRIP = ".,;:!?\"'()[]{}|*_-«»¿¡…<>/\\"


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of words with positive evidence, of any other word, and the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    background: float = -0.01
    location: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    codes, counts, words = space_words(texts)
    return codes, counts, [w.strip(STRIP).lower() for w in words.to_pylist()]


def maximal_segments(at: np.ndarray, scores: np.ndarray, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) of a text whose words score
    ``background`` < 0 but for the words ``at``, which score ``scores`` > 0; time is linear in their number."""
    stack: list[list[float]] = []  # start, end, total before the segment, total at its end
    total, last = 0.0, 0
    for p, s in zip(at.tolist(), scores.tolist(), strict=True):
        total += background * (p - last)
        new = [p, p + 1, total, total + s]
        total, last = total + s, p + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in stack]


def _passages(texts: pa.Array, model: ToxicityModel) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Words per text and its maximal segments."""
    codes, counts, words = _coded(texts)
    score = np.array([model.words.get(w, 0.0) for w in words] or [0.0])
    real = np.array([bool(w) for w in words] or [False])
    n_words = np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    np.add.at(n_words, doc[real[codes]], 1)
    each = score[codes]
    hits = np.flatnonzero(each > 0)
    begin = np.cumsum(counts) - counts
    found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(counts))]
    if len(hits):
        owner = doc[hits]
        edges = np.flatnonzero(np.diff(owner)) + 1
        for part in np.split(hits, edges):
            d = doc[part[0]]
            found[d] = maximal_segments(part - begin[d], each[part], model.background)
    return n_words, found


def _p_value(score: float, n: int, location: float) -> float:
    return -math.expm1(-math.exp(min(50.0, math.log(max(n, 1)) + location - score)))


def _evidence(scores, n: int, location: float) -> float:
    """Log of 1 plus the summed excess of segments over what clean text of that length would show at best."""
    floor = math.log(max(n, 1)) + location
    return math.log1p(sum(s - floor for s in scores if s > floor))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, toxic, clean, toxic_docs, clean_docs) of columns text and toxic; each task sums its own part first."""

    def tasks(batches):
        for batch in text_chunks(batches, "text", 8 << 20):
            codes, counts, words = _coded(texts_of(batch.column("text")))
            label = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False), counts).astype(np.int64)
            plain = {w: i for i, w in enumerate(dict.fromkeys(words))}
            code = np.array([plain[w] for w in words] or [0])[codes]
            doc = np.repeat(np.arange(len(counts)), counts)
            once = np.unique(doc * len(plain) + code)
            tokens = np.bincount(code * 2 + label, minlength=2 * len(plain)).reshape(-1, 2)
            in_docs = np.bincount(once % len(plain) * 2 + batch.column("toxic").to_numpy(zero_copy_only=False)[once // len(plain)], minlength=2 * len(plain)).reshape(-1, 2)
            columns = [pa.array(plain, pa.string()), *(pa.array(x[:, t], pa.int64()) for x in (tokens, in_docs) for t in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "clean", "toxic_docs", "clean_docs"])

    sums = [F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_docs", "clean_docs")]
    found = docs.select("text", "toxic").mapInArrow(tasks, "word string, toxic long, clean long, toxic_docs long, clean_docs long")
    return found.where("word <> ''").groupBy("word").agg(*sums)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds with a Dirichlet prior in proportion to all counts, and their standard errors."""
    weight = prior * (toxic + clean)
    t, c, more = toxic + weight, clean + weight, prior * (n_toxic + n_clean)
    odds = np.log(t / (n_toxic + more - t)) - np.log(c / (n_clean + more - c))
    return odds, np.sqrt(1 / t + 1 / c)


def upper_tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Chernoff bound of the chance that of ``n`` draws with chance ``p`` at least ``k`` succeed (1 where k <= np)."""
    q = np.minimum(k / n, 1 - 1e-12)
    rate = q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p))
    return np.where(q > p, np.exp(-n * rate), 1.0)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample: int = 20_000,
    prior: float = 0.05,
    level: float = 0.05,
    least_docs: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> ToxicityModel:
    """Model from ``docs`` and ``labels`` (doc_id, toxic).

    At most ``sample`` labelled rows are used, those with the smallest hash of their id, which bounds
    the join side that is broadcast and the words that reach the driver. A quarter of them calibrates,
    the rest counts. Null labels and texts are left out; without toxic labels
    every score is that of no evidence. ``prior`` is the Dirichlet prior's weight as a part of all counts. A word is
    evidence if so many of its documents would be toxic by chance with a probability under
    ``level`` over the number of words tested; repeats inside one text count once there. Words of fewer than ``least_docs`` toxic documents
    are not tested. Of ids with equal hashes any may be sampled first; texts of any length are counted whole.
    """
    spread = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").orderBy(spread).limit(sample)
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
        .join(F.broadcast(chosen), "doc_id")
        .withColumn("part", F.pmod(spread, F.lit(4)))
    )
    words = count_words(rows.where("part <> 0"))
    words = written(words, "toxic-words")
    n_toxic, n_clean, d_toxic, d_clean = (int(x or 0) for x in words.agg(*[F.sum(c) for c in ("toxic", "clean", "toxic_docs", "clean_docs")]).first())
    table = words.where(F.col("toxic_docs") >= least_docs).toPandas()
    dropped(words)
    if len(table):
        in_toxic, in_all = table["toxic_docs"].to_numpy(float), (table["toxic_docs"] + table["clean_docs"]).to_numpy(float)
        chance = upper_tail(in_toxic, in_all, min(0.999, max(1e-9, d_toxic / max(1, d_toxic + d_clean))))
        odds, error = log_odds(table["toxic"].to_numpy(float), table["clean"].to_numpy(float), n_toxic, n_clean, prior)
        odds -= error
        good = (chance < level / len(table)) & (odds > 0.5)
        share = ((table["clean"] + prior * (table["toxic"] + table["clean"])) / (n_clean + prior * (n_toxic + n_clean))).to_numpy()[good]
        positive = dict(zip(table["word"][good], odds[good].tolist(), strict=True))
        background = math.log(max(1e-6, 1 - float((share * np.exp(odds[good])).sum())) / (1 - float(share.sum()))) if good.any() else -0.01
    else:
        positive, background = {}, -0.01
    model = ToxicityModel(positive, min(background, -1e-3))

    def tasks(batches):
        for batch in text_chunks(batches, "text", 4 << 20):
            n, found = _passages(texts_of(batch.column("text")), model)
            scores = pa.array([[s for *_, s in segments] for segments in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n), scores], names=["toxic", "n", "scores"])

    seen = rows.where("part = 0").select("text", "toxic").mapInArrow(tasks, "toxic int, n long, scores array<double>").toPandas()
    return _calibrate(model, seen)


def _calibrate(model: ToxicityModel, seen: pd.DataFrame) -> ToxicityModel:
    """Gumbel location from clean documents' best segments, then a logistic curve of the evidence."""
    best = np.array([max(s, default=0.0) for s in seen.scores])
    clean = ((seen.toxic == 0) & (best > 0)).to_numpy()
    excess = best[clean] - np.log(np.maximum(seen.n[clean], 1)).to_numpy()
    location = float(np.median(excess) + math.log(math.log(2))) if len(excess) else -4.0
    x = np.array([_evidence(s, n, location) for s, n in zip(seen.scores, seen.n, strict=True)])
    y = seen.toxic.to_numpy(float)
    w = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.array([1e-3, 5e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - ridge * w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge), grad)
        w = w + step / max(1.0, float(np.abs(step).max()))
    return ToxicityModel(model.words, model.background, location, max(0.0, float(w[1])), float(w[0]))


def score(docs: DataFrame, model: ToxicityModel, *, alpha: float = 0.05, text: str = "text", out: str = "toxicity", passages: str = "toxic_passages") -> DataFrame:
    """``docs`` with the probability ``out`` and the significant ``passages`` (words from, to, score, p-value).

    Words are what lies between spaces and line feeds. A null or empty text has no passage and the
    score of no evidence. Repeated rows are scored alike, texts of any length whole, and an empty table stays empty; of segments that tie,
    the earlier one stays maximal. Columns named like the new ones are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in (out, passages)]
    passage = T.StructType([T.StructField(n, t()) for n, t in (("start", T.IntegerType), ("end", T.IntegerType), ("score", T.DoubleType), ("p_value", T.DoubleType))])
    added = T.StructType([T.StructField(out, T.DoubleType()), T.StructField(passages, T.ArrayType(passage))])
    names = [f.name for f in kept]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def tasks(batches):
        for batch in text_chunks(batches, text, 4 << 20):
            n, found = _passages(texts_of(batch.column(text)), model)
            x = np.array([_evidence((s for *_, s in segments), int(k), model.location) for k, segments in zip(n, found, strict=True)])
            p = 1 / (1 + np.exp(-(model.intercept + model.slope * x)))
            shown = [
                [{"start": a, "end": b, "score": s, "p_value": v} for a, b, s in segments if (v := _p_value(s, int(k), model.location)) <= alpha]
                for k, segments in zip(n, found, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p, pa.float64()), pa.array(shown, kind)], names=[*names, out, passages])

    return docs.select(*names).mapInArrow(tasks, T.StructType(kept + added.fields))
