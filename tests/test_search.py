"""Searches hold what they promise: sets are minimum and decycling, reductions stay decycling."""

import pytest

from kmerloom.functions.kspace import KmerSpace
from kmerloom.operators import components, graph, moves, search, sets
from kmerloom.sources import text


def rows_of(spark, found):
    return spark.createDataFrame([(r.seed, m) for r in found for m in r.mers], "set_id long, mer long")


@pytest.mark.parametrize("space", [KmerSpace(2, 5), KmerSpace(3, 3)])
def test_random_sets_are_minimum_and_decycling(spark, space):
    found = search.random_decycling_sets(spark, space, 6).collect()
    assert len({tuple(r.mers) for r in found}) > 1
    rows = rows_of(spark, found)
    assert all(r.decycling for r in graph.is_decycling(space, rows).collect())
    for r in found:
        one = spark.createDataFrame([(m,) for m in r.mers], "mer long")
        assert sets.one_per_register(space, one).first().one_per_register


def test_crossings_leave_the_component_and_keep_sets_minimum_and_decycling(spark):
    space = KmerSpace(2, 4)
    found = {n: search.random_decycling_sets(spark, space, 4, steps=3, crossings=n) for n in (0, 1)}
    held = {n: [r.asDict() for r in f.collect()] for n, f in found.items()}
    rows = spark.createDataFrame([(n * 100 + r["seed"], m) for n, each in held.items() for r in each for m in r["mers"]], "set_id long, mer long")
    assert all(r.decycling for r in graph.is_decycling(space, rows).collect())
    assert all(len(r["mers"]) == 6 for each in held.values() for r in each)
    names = {r.set_id: str(r.signature) for r in moves.signatures(space, rows).collect()}
    assert len({v for k, v in names.items() if k < 100}) == 1 and len(set(names.values())) > 1


def test_fresh_seeds_differ_and_repeat_a_search_from_their_file(spark, tmp_path):
    one, two = search.fresh_seeds(spark, 3), search.fresh_seeds(spark, 3)
    drawn = [r.seed for r in one.collect()]
    assert len({*drawn, *(r.seed for r in two.collect())}) == 6 and drawn == [r.seed for r in one.collect()]
    text.write_seeds(one, str(tmp_path / "seeds"))
    space, again = KmerSpace(2, 5), text.read_seeds(spark, str(tmp_path / "seeds"))
    assert sorted(r.seed for r in again.collect()) == sorted(drawn)
    first, second = (sorted((r.seed, tuple(r.mers)) for r in search.random_decycling_sets(spark, space, s).collect()) for s in (one, again))
    assert first == second and [s for s, _ in first] == sorted(drawn)


@pytest.mark.parametrize("keep", [False, True])
def test_reduction_keeps_the_union_decycling(spark, keep):
    space = KmerSpace(2, 6)
    start = sets.generate(spark, space, sets.in_mykkeltveit(space, "mer"))
    before = {r.mer for r in start.collect()}
    found = search.reduce_under_complement(spark, space, start, 3, keep_canonical=keep).collect()
    assert {r.seed for r in found} == {0, 1, 2}
    assert all(set(r.mers) <= before for r in found)
    union = graph.effective(space, rows_of(spark, found), "union")
    assert all(r.decycling for r in graph.is_decycling(space, union).collect())


def test_order_does_every_fmove_once(spark):
    space = KmerSpace(4, 3)
    start = moves.as_arrays(sets.generate(spark, space, sets.in_mykkeltveit(space, "mer")).selectExpr("0 AS set_id", "mer"))
    order = moves.fmove_order(space, start).first().fmoves
    assert sorted(order) == list(range(space.fmoves))
    now = set(start.first().mers)
    for f in order:
        left = {f + b * space.fmoves for b in range(space.alpha)}
        assert left <= now
        now = now - left | {f * space.alpha + b for b in range(space.alpha)}
    assert now == set(start.first().mers)


def test_layer_report(spark):
    space = KmerSpace(2, 4)
    start = moves.as_arrays(sets.generate(spark, space, sets.in_mykkeltveit(space, "mer")).selectExpr("0 AS set_id", "mer"))
    nodes, links = components.layers(space, start)
    r = components.layer_report(nodes, links).first()
    assert (r.n_layers, r.n_sets) == (8, nodes.count()) and r.least_width <= r.most_width and r.shortest_range <= r.longest_range


@pytest.mark.parametrize("mode", ["straight", "canonical"])
def test_components_by_joins_equal_those_of_one_task(spark, mode):
    space = KmerSpace(2, 5)
    some = spark.createDataFrame([(s, m) for s, ms in ((1, (0, 31)), (2, (0, 4, 10, 12, 13, 14, 30, 31)), (3, (5, 9, 17, 22))) for m in ms], "set_id long, mer long")
    one = sorted(map(tuple, graph.scc(space, some, mode=mode).collect()))
    assert sorted(map(tuple, graph.scc(space, some, mode=mode, most_nodes=0).collect())) == one
    assert len({(s, c) for s, c, _ in one}) >= 2
