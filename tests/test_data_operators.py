"""Operators on data: observed graphs, durable rounds, bit sets, selection and vectors of words, against their definitions."""

import random
from collections import Counter, deque

import numpy as np
import pyarrow as pa
import pytest

from kmerloom.functions import arrays
from kmerloom.functions.kspace import KmerSpace
from kmerloom.operators import bits, frontier, observed, scan, select


def random_edges(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def reached(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    out = {}
    for start in {x for e in edges for x in e}:
        todo, seen = deque(ahead.get(start, ())), set()
        while todo:
            x = todo.popleft()
            if x not in seen:
                seen.add(x)
                todo.extend(ahead.get(x, ()))
        out[start] = seen
    return out


def components(edges):
    reach = reached(edges)
    return {(min(y for y in reach[x] if x in reach[y]), x) for x in reach if x in reach[x]}


def test_components_of_any_edges(spark):
    graphs = {"loops": [(1, 1), (2, 3), (3, 2), (3, 4), (5, 5), (5, 6)], "chain": [(i, i + 1) for i in range(9)], "ring": [(i, (i + 1) % 12) for i in range(12)], "two": [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)]}
    graphs |= {f"r{s}": random_edges(40, 55, s) for s in range(3)}
    df = spark.createDataFrame([(k, *e) for k, es in graphs.items() for e in es + es[:2]], "set_id string, src long, dst long")
    got = {}
    for r in observed.components(df).collect():
        got.setdefault(r.set_id, set()).add((r.scc_id, r.node))
    assert got == {k: c for k, es in graphs.items() if (c := components(es))}
    assert observed.components(df.limit(0)).collect() == []


def test_longest_chains(spark):
    graphs = {"chain": [(i, i + 1) for i in range(9)], "cycle": [(1, 2), (2, 1), (2, 3)], "dag": sorted({(min(e), max(e)) for e in random_edges(25, 45, 4) if e[0] != e[1]}), "one": [(7, 8)]}

    def longest(edges):
        best = {}
        for a, b in sorted(edges):
            best[b] = max(best.get(b, 1), best.get(a, 1) + 1)
        return max(best.values())

    df = spark.createDataFrame([(k, *e) for k, es in graphs.items() for e in es], "set_id string, src long, dst long")
    got = {r.set_id: (r.n_nodes, r.longest) for r in observed.chains(df).collect()}
    assert got == {k: (len({x for e in es for x in e}), None if k == "cycle" else longest(es)) for k, es in graphs.items()}


def test_rounds_go_on_after_the_driver_died(spark, tmp_path, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(0, 3), (5, 1)], "src long, dst long")
    starts, where = spark.createDataFrame([(0,), (0,)], "node long"), f"file://{tmp_path}/loop"
    expected = {0: 0, 1: 1, 3: 1, 2: 2, 4: 2, 5: 3, 6: 4, 7: 5}
    commit, written = frontier.Manifest.commit, []

    def dies(self, number, tables):
        written.append(number)
        if number == 3:
            raise KeyboardInterrupt
        commit(self, number, tables)

    monkeypatch.setattr(frontier.Manifest, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        frontier.hops(edges, starts, where)
    assert written == [1, 2, 3]
    left = {p.name for p in (tmp_path / "loop/tables").iterdir()}
    monkeypatch.setattr(frontier.Manifest, "commit", lambda self, n, t: (written.append(n), commit(self, n, t))[1])
    got = frontier.hops(edges.limit(0), starts.limit(0), where)  # all it needs is in the folder
    assert {r.node: r.hops for r in got.collect()} == expected and got.count() == len(expected)
    assert written[3:] == [3, 4, 5, 6, 7]
    kept = {p.name for p in (tmp_path / "loop/tables").iterdir()}
    assert len(left - kept) == 1 and len([p for p in (tmp_path / "loop").iterdir() if p.name.startswith("round-")]) == 1


def test_bit_sets(spark):
    r = random.Random(1)
    a, b = ({r.randrange(300) for _ in range(90)} for _ in range(2))
    x, y = (bits.bits_of(spark.createDataFrame([(m,) for m in [*s, *list(s)[:5]]] + [(None,)], "mer long")) for s in (a, b))
    words = lambda df: sorted(row.mer for row in bits.mers_of(df).collect())
    assert words(x) == sorted(a) and words(bits.both(x, y)) == sorted(a & b) and words(bits.either(x, y)) == sorted(a | b)
    assert words(bits.only_first(x, y)) == sorted(a - b) and x.agg(bits.size(x)).first()[0] == len(a)
    assert x.limit(0).agg(bits.size(x)).first()[0] == 0
    edge = bits.bits_of(spark.createDataFrame([(63,), (64,), (0,), (127,)], "mer long"))
    assert words(edge) == [0, 63, 64, 127]
    space = KmerSpace(4, 2)
    rc = lambda m: (3 - m % 4) * 4 + 3 - m // 4
    texts = spark.createDataFrame([("acgtt",), ("GGAC",), (None,), ("a",)], "text string")
    own = {4 * i + j for s in ("0123 3".replace(" ", ""), "2201") for i, j in zip(map(int, s), map(int, s[1:]), strict=False)}
    assert words(bits.text_bits(texts, space)) == sorted(own)
    assert words(bits.text_bits(texts, space, canonical=True)) == sorted({min(m, rc(m)) for m in own})
    everything, chosen = bits.bits_of(spark.range(16).withColumnRenamed("id", "mer")), bits.bits_of(spark.createDataFrame([(1,), (14,)], "mer long"))
    by = {"straight": {1, 14}, "union": {1, 14, rc(1), rc(14)}, "canonical": {m for m in range(16) if min(m, rc(m)) in (1, 14)}}
    assert {m: set(words(bits.under_mode(space, everything, chosen, m))) for m in by} == by


@pytest.mark.parametrize("n", [0, 1, 7, 40, 199, 200, 500])
def test_smallest_by_radix_selection(spark, n):
    """Many ties in the value, and more ties than the tail holds."""
    r = random.Random(3)
    rows = [(r.choice((0, 5, 5, 5, 1 << 20, r.randrange(1 << 30))), i) for i in range(200)]
    got = select.smallest(spark.createDataFrame(rows, "v long, id long").repartition(5), n, value="v", tie="id", bits=40, tail=3)
    assert sorted(map(tuple, got.collect())) == sorted(rows)[:n]


def test_vectors_of_words():
    r = random.Random(9)
    texts = ["".join(r.choice("acgtnACGT ") for _ in range(n)) for n in (0, 3, 70, 5, 33, 200)]
    digits = arrays.digits_of(pa.array(texts), arrays.symbol_table("acgt", True))
    whole = [["acgt".index(c) for c in t.lower() if c in "acgtACGT"] for t in texts]
    number = lambda d: int("".join(map(str, d)) or "0", 4)
    for k in (1, 2, 3, 5, 11, 31):
        places, counts = arrays.word_places(digits, k)
        windows = [w[i : i + k] for w in whole for i in range(len(w) - k + 1)]
        assert counts.tolist() == [max(0, len(w) - k + 1) for w in whole]
        assert arrays.codes(digits.values, k, 4)[places].tolist() == [number(w) for w in windows]
        assert arrays.complement_codes(digits.values, k, 4)[places].tolist() == [number([3 - d for d in reversed(w)]) for w in windows]
        turn = arrays.least_rotations(digits.values, places, k)
        assert turn.tolist() == [min(range(k), key=lambda i, w=w: (w[i:] + w[:i], i)) for w in windows]


@pytest.mark.parametrize("width", [1, 2, 7, 50])
def test_sliding_least_is_leftmost(width):
    r = np.random.default_rng(width)
    for values in (r.integers(0, 4, 300), r.integers(0, 1 << 62, 300), np.zeros(40, np.int64), np.zeros(0, np.int64)):
        got = arrays.sliding_least(values, width)
        for i in range(len(values) - width + 1):
            assert got[i] == i + int(np.argmin(values[i : i + width]))


def test_feistel_order_is_a_permutation():
    assert len(np.unique(arrays.feistel_order(np.arange(1 << 12), 5, 6))) == 1 << 12


def test_words_over_rows(spark):
    """Streams as rows, one of them over all tasks; null digits end a stretch, short and null keys too."""
    r = random.Random(2)
    streams = {"hot": [r.randrange(3) for _ in range(500)], "b": [0, 1], "c": [2], None: [1, 1, 1, 2], "gap": [0, 1, None, 2, 2, 2, None]}
    rows = [(k, i, d) for k, ds in streams.items() for i, d in enumerate(ds)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, d int")
    for k in (1, 2, 3, 5):
        expected = Counter(sum(x * 3 ** (k - 1 - j) for j, x in enumerate(ds[i : i + k])) for ds in streams.values() for i in range(len(ds) - k + 1) if None not in ds[i : i + k])
        for parts in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            try:
                got = scan.ordered_word_counts(df, KmerSpace(3, k), "k", ["i"], "d").collect()
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", "8")
            assert {row.mer: row.n for row in got} == dict(expected)


def test_small_batches_bound_what_python_gets(spark):
    from kmerloom.shared import small_batches, written

    def tasks(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with small_batches(spark):
        sizes = written(spark.range(3000).coalesce(1).mapInArrow(tasks, "n long"), "sizes")
    assert max(r.n for r in sizes.collect()) <= 256 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
