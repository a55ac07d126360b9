"""The pipeline's rows against a brute-force version of its stages on the smallest tables."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

import corpus_pipeline
from kmerloom.llm import secrets
from kmerloom.llm.queries import TOXIC_AT, WORD_TOKENIZER, op7_toxicity, tokenizer_path

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def one_of_each(docs):
    """The least document of each component of weighted Jaccard similarity of five-word shingles of 0.8 or more; texts without words stay."""
    bags = {d: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, t in docs.items() if (w := words(t))}
    leader = {d: d for d in docs}

    def top(d):
        while leader[d] != d:
            d = leader[d]
        return d

    known = sorted(bags)
    for n, a in enumerate(known):
        for b in known[n + 1 :]:
            if (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total():
                one, two = sorted((top(a), top(b)))
                leader[two] = one
    return {d: t for d, t in docs.items() if leader[d] == d}


def uncontaminated(docs, items):
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[min(10, len(w))].add(tuple(w[i : i + 10]))
    hit = lambda w: any(tuple(w[i : i + n]) in known for n, known in windows.items() for i in range(len(w) - n + 1))
    return {d: t for d, t in docs.items() if not hit(words(t))}


def redacted(text):
    spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text or "", re.A) if len(m.group(r.group)) >= r.least)
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:] if text else text


def test_rows_equal_brute_force(spark):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    toxic = {r.doc_id for r in op7_toxicity(spark, DATA).collect() if r.score >= TOXIC_AT}
    expected = one_of_each({d: t for d, t in docs.items() if d not in toxic})
    expected = uncontaminated(expected, [r["text"] for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()])
    encode = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER)).encode
    ids = {d: [*encode(redacted(t) or "", add_special_tokens=False).ids, 1] for d, t in expected.items()}
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == ids.keys() and len(ids) < len(docs)
    for d, own in pieces.items():
        whole = b"".join(bytes(r.token_ids) for r in sorted(own, key=lambda r: r.start))
        assert zlib.crc32(whole) == zlib.crc32(struct.pack(f"<{len(ids[d])}I", *ids[d])), d


def test_columns_named_like_those_of_the_operators_stay(spark):
    names = ["Toxicity", "toxic_passages", "n_words", "n_hit", "hit_spans", "hit_items", "secret_spans", "key1", "key2", "worded", "kept_n_hit"]
    rows = [(i, f"some plain words number {i} " + ("password = abcdefghijkl1234" if i == 3 else "here"), "en", "s", 9, *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert [f.simpleString() for f in out.schema] == [f.simpleString() for f in docs.schema]
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
