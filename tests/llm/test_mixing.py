"""Entropy balancing against its targets, its optimality conditions, brute force on rounding and SQL."""

import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from kmerloom.llm import mixing, queries

SIZES = {"a": [random.Random(1).randrange(0, 400) for _ in range(900)], "b": [5000, 3, 3, 3, 40], None: [100] * 50, "é": [7], "Z": [0, 0], "z": [random.Random(2).randrange(1, 90) for _ in range(200)]}


def docs(spark, sizes=SIZES):
    rows = [(f"{s}{i}", " w\n" * n, s, i) for s, each in sizes.items() for i, n in enumerate(each)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string, mix_rate int")


def filled(sizes, weights, share, most):
    """Targets by handing the excess on until none is over its limit."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    words, weight = {s: sum(sizes[s]) for s in order}, {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), share * sum(words.values())
    while True:
        rest = total - sum(most * words[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * words[s]}
        if not over:
            return {s: most * words[s] if s in capped else level * weight[s] for s in order}
        capped |= over


@pytest.mark.parametrize("weights, share, most", [((5.0, 2.0, 1.0), 1.5, 2), ((1.0,), 0.3, 1), ((1.0, 9.0), 2.5, 3)])
def test_targets_copies_and_partitions(spark, weights, share, most):
    table = docs(spark)
    first = mixing.mix(table.repartition(7), weights, share=share, most=most)
    assert first.columns == [*table.columns, "mix_words", "mix_source_words", "mix_target", "_mix_rate", "mix_copies"]
    rows = first.collect()
    again = mixing.mix(table.repartition(3, "doc_id"), weights, share=share, most=most).collect()
    assert sorted((r.doc_id, r.mix_copies, r.mix_rate) for r in rows) == sorted((r.doc_id, r.mix_copies, r.mix_rate) for r in again)
    targets = filled(SIZES, weights, share, most)
    for s, each in SIZES.items():
        own = [r for r in rows if r.source == s]
        assert len(own) == len(each)
        assert all(r.mix_words == each[r.mix_rate] for r in own)
        assert own[0].mix_target == pytest.approx(targets[s]) and own[0].mix_source_words == sum(each)
        taken = sum(r.mix_words * r.mix_copies for r in own)
        assert all(0 <= r.mix_copies <= most for r in own)
        assert abs(taken - targets[s]) <= max(each) / 2 + 1e-6 * targets[s]
        assert all(abs(r.mix_copies - r._mix_rate) < 1 for r in own if r._mix_rate is not None and r.mix_words)


def test_newton_meets_the_targets(spark):
    """At the dual's optimum the tilted rates add up to each target."""
    sizes = [(0, s, 0.5) for s in SIZES["a"]] + [(1, s, 0.5) for s in SIZES["b"]] + [(2, s, 0.5) for s in SIZES["z"]]
    share = {0: 1.9, 1: 0.3, 2: 1.0}
    total = {k: sum(s for n, s, _ in sizes if n == k) for k in share}
    mean = {k: total[k] / sum(1 for n, s, _ in sizes if n == k and s) for k in share}
    groups = spark.createDataFrame([(n, s, s / mean[n], 1) for n, s, _ in sizes if s], "number long, size long, x double, n long")
    sources = spark.createDataFrame([(k, total[k], share[k] * total[k]) for k in share], "number long, words long, target double")
    for r in mixing.newton(groups, sources, 2).collect():
        reached = sum(s * min(2.0, math.exp(r["lambda"] * s / mean[r.number])) for n, s, _ in sizes if n == r.number)
        assert reached == pytest.approx(r.target, rel=2e-6)


def test_words_and_edges(spark):
    texts = [None, "", " \t\n", "one", " one\x0b two\x0c\r", "a b c", "x" * 100_000, "w " * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", mixing.n_words(F.col("t")).alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == [0, 0, 0, 1, 2, 2, 1, 100_000]
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty, [1.0]).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert sorted(r.mix_copies * r.mix_words for r in mixing.mix(nothing, [1.0, 2.0]).collect()) == [0, 0]
    with pytest.raises(ValueError):
        mixing.mix(empty, [0.0])


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(tuple(r) for r in queries.op12_mixing(spark, data).select(*columns).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP12_SQL})").fetchall())
