"""The numbered queries on the smallest tables, against brute force, round trips or held-out accuracy."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as job

DATA = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in read("documents")}


def result(spark, name):
    return job.queries()[name](spark, DATA).collect()


def test_substring_dedup(spark, docs):
    first = {}
    for d in sorted(docs):
        b = docs[d].encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    expected = {}
    for d, t in docs.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int(((~np.concatenate(([False], gone[:-1]))) & gone).sum()) if len(b) else 0
        expected[d] = (len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, "op1_substring_dedup")}
    assert got == expected


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    from kmerloom.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = result(spark, "op2_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == docs.keys()
    total = 0
    for d, text in docs.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        total += len(ids)
        end = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (end, len(ids))
            part = ids[r.start : r.start + r.length]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
            end += r.length
        assert end == len(ids)
    padded = 0
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
        padded += end if end & (end - 1) == 0 else 2048
    assert total / padded > 0.9


def test_language(spark, docs):
    langs = {r["doc_id"]: r["lang"] for r in read("documents")}
    rows = result(spark, "op3_language")
    assert {r.doc_id for r in rows} == docs.keys()
    held = [r for r in rows if r.held_out and docs[r.doc_id] and langs[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in docs[r.doc_id]))
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.9


def test_media(spark, docs):
    rows = result(spark, "op4_media")
    assert {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        b = docs[r.doc_id].encode()
        payload = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), sha(payload), zlib.crc32(payload[-32:]))


KINDS = {
    "assign": (re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def test_secret_scan(spark, docs):
    for r in result(spark, "op6_secret_scan"):
        spans = [
            (m.start(), n, f"{kind}:{m.start()}:{m.end()}")
            for n, (kind, (rule, group, least)) in enumerate(KINDS.items())
            for m in rule.finditer(docs[r.doc_id])
            if len(m.group(group)) >= least
        ]
        base = [s for _, _, s in sorted(spans)]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in KINDS]
        assert r.base_sha256 == sha(",".join(base).encode())
        assert set(base) <= set(r.spans.split(","))


def test_toxicity(spark, docs):
    rows = result(spark, "op7_toxicity")
    assert {r.doc_id for r in rows} == docs.keys()
    toxic = {r["doc_id"]: r["toxic"] for r in read("labels")}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.85


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_near_duplicates(spark, docs):
    rows = {r.doc_id: r for r in result(spark, "op8_near_duplicates")}
    assert rows.keys() == docs.keys()
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, words(t)) for d, t in docs.items()) if w}
    known = sorted(grams)
    for n, a in enumerate(known):
        for b in known[n + 1 :]:
            both = len(grams[a] & grams[b])
            if both / (len(grams[a]) + len(grams[b]) - both) >= 0.9:
                assert rows[a].class_id == rows[b].class_id
    for d, r in rows.items():
        assert r.class_id <= d and rows[r.class_id].class_id == r.class_id


def test_near_duplicates_by_brute_force(spark, docs):
    """The registered query's classes and links against all pairs of different word sequences, at a weighted similarity of 0.8."""
    texts = defaultdict(list)
    for d, t in docs.items():
        texts[tuple(words(t))].append(d)
    bags = {w: Counter(w[i : i + 5] for i in range(max(1, len(w) - 4))) for w in texts if w}
    links, leader = Counter(), {w: w for w in texts}

    def top(w):
        while leader[w] != w:
            w = leader[w]
        return w

    known = list(bags)
    for n, a in enumerate(known):
        for b in known[n + 1 :]:
            if (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total():
                links[a] += 1
                links[b] += 1
                leader[top(a)] = top(b)
    least = {}
    for w, own in texts.items():
        least[top(w)] = min(least.get(top(w), min(own)), *own)
    rows = {r.doc_id: r for r in result(spark, "op8_near_duplicates")}
    expected = {d: (least[top(w)] if w else d, links[w]) for w, own in texts.items() for d in own}
    assert all(rows[d].n_links <= n for d, (_, n) in expected.items())
    assert sum(r.n_links for r in rows.values()) >= 0.97 * sum(n for _, n in expected.values()) > 0
    assert sum(rows[d].class_id == c for d, (c, _) in expected.items()) >= 0.98 * len(rows)


def test_decontamination(spark, docs):
    windows = defaultdict(set)
    for item in read("benchmark"):
        w = words(item["text"] or "")
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item["item_id"]))
    sizes = {len(w) for w in windows}
    for r in result(spark, "op9_decontamination"):
        w = words(docs[r.doc_id])
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == sha(",".join(sorted(items)).encode())


def test_url_filter(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{DATA}/pages.parquet')")
    expected = con.execute(job.oracle_sql()["op10_url_filter"]).fetchall()
    got = [tuple(r) for r in result(spark, "op10_url_filter")]
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", ["op6_secret_scan", "op9_decontamination"])
def test_operators_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = job.queries()[name](spark, DATA)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({job.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)


def test_near_passages_are_similar(spark, docs):
    for r in result(spark, "op5_near_passages"):
        a, b = words(docs[r.doc_id])[r.start_word : r.end_word], words(docs[r.other_doc_id])[r.other_start : r.other_end]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert r.other_doc_id < r.doc_id and min(len(a), len(b)) >= 50 and len(x & y) / len(x | y) == pytest.approx(r.similarity)


def test_pipeline(spark, docs):
    rows = result(spark, "pipeline")
    kept = {r.doc_id for r in rows}
    assert kept <= docs.keys() and len(kept) > len(docs) / 3
