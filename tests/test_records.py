"""Records in chunks, in files cut by byte ranges, and in streams out of order, against whole records."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import arrays
from kmerloom.functions.kspace import KmerSpace
from kmerloom.operators import chunks, scan
from kmerloom.sources import records as files
from kmerloom.sources import text
from kmerloom.streaming import records
from kmerloom.streaming import sketch as stream

SPACE = KmerSpace(4, 4)
TAKEN = np.arange(SPACE.size) % 7 == 3
HITS = scan.table_hits(SPACE, TAKEN)


def brute(letters):
    """(gap, n) of one record, word by word."""
    digits = ["acgt".index(c) for c in letters.lower() if c in "acgtACGT"]
    last, gaps = 0, {}
    for i in range(len(digits) - 3):
        if TAKEN[digits[i] * 64 + digits[i + 1] * 16 + digits[i + 2] * 4 + digits[i + 3]]:
            gaps[i - last] = gaps.get(i - last, 0) + 1
            last = i
    return gaps


def told(rows, key):
    out = {}
    for r in rows.collect():
        out.setdefault(r[key], {})[r["gap"]] = r["n"]
    return out


def letters(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("acgtACGTxé \n") for _ in range(n))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_chunks_of_any_size_equal_whole_records(spark, size):
    """Words over several chunks, chunks without a letter, empty and null records, one record with most of the rows."""
    whole = {i: letters(n, i) for i, n in enumerate([0, 1, 3, 4, 5, 50, 400, 9, 3000])} | {100: None, 101: "x" * 50 + "acgtacgt" + "é" * 40 + "acg", 102: "a" * 200}
    df = spark.createDataFrame(list(whole.items()), "seq_id long, text string")
    pieces = chunks.cut_texts(df, "seq_id", size=size)
    joined = pieces.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "").alias("t"))
    assert {r.seq_id: r.t for r in joined.collect()} == {k: v or "" for k, v in whole.items()}
    for tasks in (1, 6):
        got = told(chunks.gap_counts(pieces.repartition(tasks, F.xxhash64("seq_id", "chunk")), HITS, 4), "seq_id")
        assert got == {k: g for k, v in whole.items() if (g := brute(v or ""))}


def test_one_long_record_over_many_tasks(spark):
    sequence = letters(400_000, 7)
    df = spark.createDataFrame([(None, sequence)], "seq_id string, text string")
    pieces = chunks.cut_texts(df, "seq_id", size=1000).repartition(8)
    assert told(chunks.gap_counts(pieces, HITS, 4), "seq_id") == {None: brute(sequence)}


def test_no_chunks(spark):
    assert chunks.gap_counts(spark.createDataFrame([], "seq_id long, chunk long, text string"), HITS, 4).collect() == []


@pytest.mark.parametrize("split", [5, 64, 100_000])
def test_fasta_by_byte_ranges(spark, tmp_path, split):
    whole = {"r1 first": letters(90, 1).replace("\n", "").replace("é", ""), "r2": "", "r3": "acgt" * 40, "a>b": "ttt\nacg", "last": "acgtacgtaca"}
    (tmp_path / "a.fa").write_text("gattaca\n" + "".join(f">{n}\n{s}\n" for n, s in whole.items()))
    (tmp_path / "b.fa").write_text(">only header")
    (tmp_path / "_SUCCESS").write_text("")
    pieces = files.read_fasta_chunks(spark, f"file://{tmp_path}", split_bytes=split)
    rows = {}
    for r in pieces.collect():
        rows.setdefault((r.record, r.seq_name), []).append((r.chunk, r.text))
    got = {n: "".join("".join(t for _, t in sorted(x)).split()) for (_, n), x in rows.items()}
    assert got == {n: "".join(s.split()) for n, s in whole.items()} | {"": "gattaca", "only header": ""}


def test_fasta_and_histogram_writers_commit(spark, tmp_path):
    files.register(spark)
    rows = [(f"s{i}", "ACGT" * i) for i in range(40)]
    path = f"file://{tmp_path}/out"
    spark.createDataFrame(rows, "name string, text string").repartition(5).write.format("kmer_fasta").mode("append").save(path)
    assert sorted((r.seq_name, r.seq) for r in text.read_fasta(spark, path + "/*.fa").collect()) == sorted(rows)
    bad = spark.createDataFrame(rows, "name string, text string").select("name", F.when(F.col("name") == "s39", F.raise_error(F.lit("no"))).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception, match="no"):
        bad.repartition(3).write.format("kmer_fasta").mode("append").save(f"file://{tmp_path}/bad")
    assert not (tmp_path / "bad").exists() or not [p for p in (tmp_path / "bad").iterdir() if p.name.startswith("part")]
    hist = spark.createDataFrame([("a", 3, 2, 0.25), ("a", 5, 1, 0.25), ("b", 1, 9, None)], "seq_name string, gap long, n long, share double")
    files.write_histograms(hist, f"file://{tmp_path}/h", density="share")
    written = "".join(p.read_text() for p in sorted((tmp_path / "h").glob("part-*")))
    assert sorted(written.split(">")) == ["", "a\n# density 0.25\n3 2\n5 1\n", "b\n1 9\n"]
    (tmp_path / "genome_x_set1_c.histo").write_text(written)
    back = text.read_histograms(spark, f"file://{tmp_path}/genome_x_set1_c.histo").collect()
    assert sorted((r.seq_name, r.gap, r.n, r.density) for r in back) == [("a", 3, 2, 0.25), ("a", 5, 1, 0.25), ("b", 1, 9, None)]


def test_pieces_in_any_order_over_batches(spark, tmp_path):
    """Repeated pieces, marks before pieces, empty pieces, a record whose mark never comes and a record of no pieces."""
    whole = {1: letters(60, 3), 2: "acgtacgtacgtaacc", 3: "", 4: letters(30, 4)}
    rows = [(k, i, v[i * 7 : i * 7 + 7], None) for k, v in whole.items() for i in range(-(-len(v) // 7))]
    rows += [(k, None, None, -(-len(v) // 7)) for k, v in whole.items() if k != 4] + rows[:3]
    random.Random(1).shuffle(rows)
    schema = "seq_id long, piece long, text string, n long"
    for b in range(3):
        spark.createDataFrame(rows[b::3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    with records.keyed_state(spark):
        out = stream.drained(records.record_gaps(records.pieces_of(source, "seq_id", "piece", ends="n"), HITS, 4, "seq_id"), "test")
    got = told(out.where("gap IS NOT NULL").groupBy("seq_id", "gap").agg(F.count("*").alias("n")), "seq_id")
    assert got == {k: g for k, v in whole.items() if (g := brute(v))}
    assert {(r.seq_id, r.closed) for r in out.where("gap IS NULL").collect()} >= {(1, 9), (2, 3), (3, 0)}


def test_a_record_that_is_whole_in_its_batch_leaves_no_state():
    """Each call to the state store is a round trip: none go to the map of early pieces where none wait, and the run of pieces is worked on once."""
    calls, runs = [], []

    class Store:
        def __getattr__(self, name):
            return lambda *args: calls.append(name) or (False if name == "exists" else None)

    class Handle:
        def getValueState(self, *args):
            return Store()

        def getMapState(self, *args):
            return None

    def hits(digits):
        runs.append(digits)
        return HITS(digits)

    whole = letters(60, 3)
    table = arrays.symbol_table("acgt", True)
    pieces = [(1, i, bytes(arrays.digits_of(pa.array([whole[i * 7 : i * 7 + 7]]), table).values), None) for i in range(-(-len(whole) // 7))]
    random.Random(2).shuffle(pieces)
    made = records.RecordGaps(hits, 4, "seq_id")
    made.init(Handle())
    out = list(made.handleInputRows((1,), iter([*pieces[:4], (1, None, None, len(pieces)), *pieces[4:], *pieces[:2]]), None))
    assert sorted(calls) == ["clear", "exists"] and len(runs) == 1
    assert dict(Counter(r.gap for r in out if r.gap is not None)) == brute(whole) and [r.closed for r in out if r.gap is None] == [len(pieces)]


def test_stretches_and_errors():
    import pyarrow as pa

    table = arrays.symbol_table("acgt", True)
    texts = pa.array(["acgxta c", None, "", "xx", "gXXt"])
    split = arrays.digits_of(texts, table, "split")
    assert (split.counts[split.counts > 0].tolist(), split.owner[split.counts > 0].tolist()) == ([3, 3, 1, 1], [0, 0, 4, 4])
    assert arrays.digits_of(texts, table).counts.tolist() == [6, 0, 0, 0, 2]
    with pytest.raises(ValueError, match="at 4"):
        arrays.digits_of(texts, table, "error")
    assert arrays.digits_of(pa.array(["a c\n"]), table, "error").counts.tolist() == [2]
