"""Text files written and read back."""

import pytest

from kmerloom.functions.kspace import KmerSpace
from kmerloom.operators import moves, sketch
from kmerloom.sources import text


def put(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return f"file://{tmp_path}/{name}"


def test_fasta_headers_are_whole_lines(spark, tmp_path):
    path = put(tmp_path, "a.fa", "ACGT\nAC\n>r1 a->b desc\nAC\nGT > x\n>r2\n\tTT\r\n>r3\n>r4\nA")
    rows = {(r.seq_name, r.seq) for r in text.read_fasta(spark, path).collect()}
    assert rows == {("", "ACGTAC"), ("r1 a->b desc", "ACGT>x"), ("r2", "TT"), ("r3", ""), ("r4", "A")}


def test_fasta_over_several_files_and_splits(spark, tmp_path):
    expected = set()
    for f in range(3):
        records = [(f"f{f} r{i}", "ACGT" * (i % 7)) for i in range(500)]
        put(tmp_path, f"{f}.fa", "".join(f">{n}\n{s}\n" for n, s in records))
        expected |= set(records)
    put(tmp_path, "bare.fa", "GATTACA\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = [(r.seq_name, r.seq) for r in text.read_fasta(spark, f"file://{tmp_path}/*.fa").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(rows) == sorted(expected | {("", "GATTACA")})


def test_equal_lines_are_lists_of_their_own(spark, tmp_path):
    path = put(tmp_path, "moves.txt", "3 6 5\n3 6 5\n1\n")
    rows = text.read_fmove_lists(spark, path).collect()
    lists = {}
    for r in rows:
        lists.setdefault(r.list_id, []).append((r.pos, r.fm))
    assert sorted(sorted(x) for x in lists.values()) == [[(0, 1)], [(0, 3), (1, 6), (2, 5)], [(0, 3), (1, 6), (2, 5)]]


def test_sets_from_files_and_arguments(spark, tmp_path):
    path = put(tmp_path, "set.txt", "1,2 3\n7\n")
    assert sorted(r.mer for r in text.read_set(spark, path, 9, 2).collect()) == [1, 2, 3, 7, 9]
    assert sorted(r.mer for r in text.read_set(spark, None, 4).collect()) == [4]
    lines = text.read_set_lines(spark, put(tmp_path, "sets.txt", "2,1\n1 2\n\n5\n")).collect()
    assert sorted(r.mers for r in lines) == [[1, 2], [5]]


def test_histograms_round_trip(spark, tmp_path):
    rows = [("r1", 3, 10), ("r1", 12, 1), ("r2", 1, 4)]
    hist = spark.createDataFrame(rows, "seq_name string, gap long, n long")
    text.write_histograms(hist, f"file://{tmp_path}/out")
    part = next(p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size)
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    path = put(tmp_path, "genome_myk_set1_c.histo", whole)
    got = text.read_histograms(spark, path).collect()
    assert part and sorted((r.seq_name, r.gap, r.n) for r in got) == sorted(rows)
    assert {(r.dataset, r.sketch, r.method) for r in got} == {("genome", "myk", "c")}


def test_components_round_trip(spark, tmp_path):
    rows = [(0, [3, 1], [(1, 2), (5, 1)]), (1, [2], [])]
    df = spark.createDataFrame(rows, "comp_id long, fms array<long>, ims array<struct<fm:long,mask:int>>")
    df.select(text.component_line().alias("line")).coalesce(1).write.text(f"file://{tmp_path}/components")
    got = text.read_components(spark, f"file://{tmp_path}/components").collect()
    assert sorted((r.comp_id, r.fms, [tuple(x) for x in r.ims]) for r in got) == rows


def test_alphabets_are_checked():
    with pytest.raises(ValueError):
        sketch.symbols("text", "acga")
    with pytest.raises(ValueError):
        sketch.symbols("text", "acgt", alpha=3)


def test_complement_pairs(spark):
    space = KmerSpace(4, 2)
    rows = text.complement_pairs(spark.createDataFrame([(0,), (6,)], "mer long"), space).collect()
    assert [r.line for r in rows] == ["0,15", "6,6"] or [r.line for r in rows][0] == "0,15"


def test_a_crossing_gives_a_decycling_set_in_another_component(spark):
    from kmerloom.operators import components, graph

    space = KmerSpace(2, 4)
    start = moves.as_arrays(spark.createDataFrame([(0, m) for m in (0, 1, 5, 9, 13, 15)], "set_id long, mer long"))
    if not graph.is_decycling(space, moves.as_rows(start)).first().decycling:
        pytest.skip("not a decycling set")
    crossings = moves.imoves(space, moves.as_rows(start))
    crossed = components.across(space, crossings, moves.fmove_order(space, start))
    rows = crossed.select("fm", "mask", "mers").collect()
    keyed = spark.createDataFrame([(i, m) for i, r in enumerate(rows) for m in r.mers], "set_id long, mer long")
    assert all(r.decycling for r in graph.is_decycling(space, keyed).collect())


def test_scc_files_and_their_statistics(spark, tmp_path):
    for i, (c, n) in enumerate([(1, 10), (3, 14)]):
        put(tmp_path, f"genome_syncmer_set{i}_u.scc", f"{c},{n}\n")
    rows = text.scc_statistics(text.read_scc(spark, f"file://{tmp_path}/*.scc")).collect()
    assert [(r.dataset, r.sketch, r.method, r.mean_n_scc, r.min_n_nodes, r.max_n_nodes) for r in rows] == [("genome", "syncmer", "u", 2.0, 10, 14)]
    assert rows[0].stdev_n_scc == pytest.approx(2**0.5)


def test_components_are_added_to_a_folder(spark, tmp_path):
    path = f"file://{tmp_path}/queue"
    for i in range(2):
        text.write_components(spark.createDataFrame([(i, [3, i], [(1, 2)])], "comp_id long, fms array<long>, ims array<struct<fm:long,mask:int>>"), path)
    assert sorted((r.comp_id, r.fms) for r in text.read_components(spark, path).collect()) == [(0, [3, 0]), (1, [3, 1])]


def test_layers_are_drawn_with_tooltips_and_paths(spark):
    nodes = spark.createDataFrame([(0, [1, 2], 3, 5), (1, [2, 4], 2, 2)], "layer int, mers array<long>, shortest int, longest int")
    links = spark.createDataFrame([(0, [1, 2], [2, 4], 7), (1, [2, 4], [1, 2], 6)], "layer int, src array<long>, dst array<long>, fm long")
    lines = [r.line for r in text.layer_dot(nodes, links).collect()]
    assert sum('tooltip="1,2", label="3:5"' in x for x in lines) == 1 and sum(x.startswith("{ rank=same") for x in lines) == 2
    assert sorted(x.split("label=")[1] for x in lines if "->" in x) == ['"6"];', '"7"];']
    assert 'label="3' not in "".join(r.line for r in text.layer_dot(nodes.drop("shortest"), links).collect())


def test_density_lines(spark):
    rows = spark.createDataFrame([("a", 1, 4), ("a", 1, 4), ("b", 0, 0)], "seq_name string, n_hits long, n_kmers long")
    assert [tuple(r) for r in text.density_lines(rows).collect()] == [("a", "# density 0.25")]
