"""Sequence and histogram files as Python data sources: FASTA read by byte ranges that may lie inside a record, and writers that commit.

``register`` makes the formats ``kmer_fasta`` and ``kmer_histograms`` known. Files are reached by pyarrow's file systems, so paths are URIs of one that
pyarrow knows (``file://``, ``hdfs://``, ``s3://``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes read at a time; a row of sequence is no longer. Header lines are shorter than ``HEADER``.
BLOCK, HEADER = 1 << 20, 1 << 16


def files_under(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The files of a folder, or a file; names that begin with a dot or a line are no data."""
    system, where = pafs.FileSystem.from_uri(path)
    info = system.get_file_info(where)
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(where))
    return system, sorted((f for f in found if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    file: str
    split: int
    start: int
    end: int


class FastaReader(DataSourceReader):
    """Rows (file, split, at, head, record, text): headers (``head`` is the name, the text is empty) and pieces of sequence, with the byte they begin at.

    ``record`` is the byte at which the row's record begins, null if that is before the range. With ``headers`` only headers come.
    """

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("split_bytes", 32 << 20))
        self.headers = options.get("headers", "false") == "true"

    def partitions(self) -> list[Range]:
        _, files = files_under(self.path)
        ranges = [Range(f.path, i, a, min(f.size, a + self.size)) for f in files for i, a in enumerate(range(0, f.size, self.size))]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.end <= part.start:
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        with system.open_input_file(part.file) as source:
            seen = source.read_at(min(HEADER, part.start), part.start - min(HEADER, part.start))
            line = seen[seen.rfind(b"\n") + 1 :]
            in_header = line[:1] == b">" and (b"\n" in seen or part.start <= HEADER)
            at, fresh, record = part.start, not line, None if part.start else 0
            while at < part.end:
                raw = source.read_at(min(BLOCK, part.end - at), at)
                if in_header:  # the rest of a header that began in an earlier range
                    end = raw.find(b"\n") + 1
                    in_header, fresh, at = not end, bool(end), at + (end or len(raw))
                    continue
                place = 0 if fresh and raw[:1] == b">" else raw.find(b"\n>") + 1 or len(raw)
                piece = raw[:place] if raw[:1] != b">" or not fresh else b""
                if piece.strip() and not self.headers:
                    yield part.file, part.split, at, None, record, piece.decode(errors="replace")
                at, fresh = at + len(piece), piece[-1:] == b"\n" if piece else fresh
                if len(piece) < len(raw):
                    head = source.read_at(HEADER, at)
                    end = head.find(b"\n") + 1 or len(head)
                    yield part.file, part.split, at, head[1:end].decode(errors="replace").strip(), at, ""
                    record, at, fresh = at, at + end, True


class _Committed(DataSourceWriter):
    """Each task writes one hidden file; all are renamed when every task is done, and deleted if one fails."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.width = int(options.get("width", 60))

    def lines(self, rows: Iterator) -> Iterator[str]:
        raise NotImplementedError

    def write(self, rows: Iterator) -> Hidden:
        from pyspark import TaskContext

        system, where = pafs.FileSystem.from_uri(self.path)
        system.create_dir(where, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}{self.suffix}"
        hidden = f"{where}/.{context.taskAttemptId()}-{name}"
        n = 0
        with system.open_output_stream(hidden) as out:
            for line in self.lines(rows):
                out.write(line.encode())
                n += 1
        return Hidden(hidden, f"{where}/{name}", n)

    def commit(self, messages: list[Hidden | None]) -> None:
        system, where = pafs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for f in files_under(self.path)[1]:
                system.delete_file(f.path)
        for m in messages:
            if m and m.n:
                system.move(m.hidden, m.name)
            elif m:
                system.delete_file(m.hidden)
        with system.open_output_stream(f"{where}/_SUCCESS"):
            pass

    def abort(self, messages: list[Hidden | None]) -> None:
        system, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and system.get_file_info(m.hidden).is_file:
                system.delete_file(m.hidden)


@dataclass
class Hidden(WriterCommitMessage):
    hidden: str
    name: str
    n: int


class FastaWriter(_Committed):
    """Rows (name, text): a header line, and the sequence in lines of ``width``."""

    suffix = ".fa"

    def lines(self, rows: Iterator) -> Iterator[str]:
        for r in rows:
            text = r["text"] or ""
            yield f">{r['name'] or ''}\n" + "".join(text[i : i + self.width] + "\n" for i in range(0, len(text), self.width))


class HistogramWriter(_Committed):
    """Rows (name, density, gap, n), those of a name together: a header, the density, then a line for each gap."""

    suffix = ".histo"

    def lines(self, rows: Iterator) -> Iterator[str]:
        last = object()
        for r in rows:
            if r["name"] != last:
                last = r["name"]
                density = "" if r["density"] is None else f"# density {r['density']!r}\n"
                yield f">{last or ''}\n{density}"
            if r["gap"] is not None:
                yield f"{r['gap']} {r['n']}\n"


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kmer_fasta"

    def schema(self) -> str:
        return "file string, split int, at long, head string, record long, text string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        return FastaWriter(dict(self.options), overwrite)


class Histograms(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kmer_histograms"

    def schema(self) -> str:
        return "name string, density double, gap long, n long"

    def writer(self, schema, overwrite: bool) -> HistogramWriter:
        return HistogramWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    for kind in (Fasta, Histograms):
        spark.dataSource.register(kind)


def read_fasta_chunks(spark: SparkSession, path: str, *, split_bytes: int = 32 << 20) -> DataFrame:
    """(record, seq_name, chunk, text): sequences in pieces, none longer than ``BLOCK`` bytes; ``record`` is the file and the byte at which a record begins.

    Ranges are read by themselves, so one record may lie over many tasks. A first pass takes the headers alone; the last header of each range
    names the pieces that later ranges begin with. What stands before the first header of a file is a record without name.
    """
    register(spark)
    source = spark.read.format("kmer_fasta").option("path", path).option("split_bytes", split_bytes)
    heads = source.option("headers", "true").load().where("head IS NOT NULL").select("file", "split", F.col("record").alias("begin"), F.col("head").alias("seq_name"))
    last = heads.groupBy("file", "split").agg(F.max(F.struct("begin", "seq_name")).alias("last"))
    rows = source.option("headers", "false").load()
    earlier = last.select("file", F.col("split").alias("from"), "last", F.lead("split").over(Window.partitionBy("file").orderBy("split")).alias("next"))  # a row for each range
    ranged = rows.select("file", "split").distinct().join(earlier, "file").where("split > from AND (next IS NULL OR split <= next)").select("file", "split", "last")
    known = rows.where("record IS NOT NULL").join(heads, (rows["file"] == heads["file"]) & (rows["split"] == heads["split"]) & (rows["record"] == heads["begin"]), "left").select(
        rows["file"], F.col("record").alias("begin"), F.coalesce("seq_name", F.lit("")).alias("seq_name"), "at", "text"
    )
    carried = rows.where("record IS NULL").join(ranged, ["file", "split"], "left").select("file", F.coalesce("last.begin", F.lit(0)).alias("begin"), F.coalesce("last.seq_name", F.lit("")).alias("seq_name"), "at", "text")
    return known.union(carried).select(F.concat_ws(":", "file", "begin").alias("record"), "seq_name", F.col("at").alias("chunk"), "text")


def write_histograms(hist: DataFrame, path: str, *, name: str = "seq_name", density: str | None = None) -> None:
    """Histograms (name, gap, n) as text with their density lines; a record's lines are together, records are spread over files."""
    register(hist.sparkSession)
    share = F.col(density) if density else F.lit(None).cast("double")
    rows = hist.select(F.col(name).alias("name"), share.alias("density"), "gap", "n")
    rows.repartition("name").sortWithinPartitions("name", "gap").write.format("kmer_histograms").mode("append").save(path)
