"""Text sources and sinks: sets, sequences, histograms, components and graph drawings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kspace import col

NUMBER = r"\d+"


def numbers(text) -> Column:
    """All decimals in a text, whatever separates them."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(f"({NUMBER})")), lambda x: x.cast("bigint"))


def read_set(spark: SparkSession, path: str | None = None, *more: int) -> DataFrame:
    """(mer): every number of text files, and those given."""
    given = spark.createDataFrame([(int(m),) for m in more], "mer long")
    if path is None:
        return given.distinct()
    return spark.read.text(path).select(F.explode(numbers("value")).alias("mer")).union(given).distinct()


def read_set_lines(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, mers): one set per line that holds a number; the id is a hash of the sorted set, so equal sets are one."""
    lines = spark.read.text(path).select(F.array_sort(F.array_distinct(numbers("value"))).alias("mers")).where(F.size("mers") > 0)
    return lines.select(F.xxhash64(F.to_json("mers")).alias("set_id"), "mers").dropDuplicates(["mers"])


def write_seeds(seeds: DataFrame, path: str) -> None:
    """The column seed as text, a number a line, which ``read_seeds`` gives to any search again."""
    seeds.select(F.col("seed").cast("string").alias("value")).write.text(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seed): the whole numbers of text files, signs included."""
    found = F.regexp_extract_all("value", F.lit(r"(-?\d+)"))
    return spark.read.text(path).select(F.explode(F.transform(found, lambda x: x.cast("bigint"))).alias("seed"))


def read_fmove_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list_id, pos, fm): one ordered list of moves per line; each line is a list of its own, numbered by its place in the files' splits."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("list_id"), numbers("value").alias("fms"))
    return lines.select("list_id", F.posexplode("fms").alias("pos", "fm"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_name, seq): a record per line that begins with ``>``; white space inside a sequence is dropped. What stands before the first
    header of a file is the record named by an empty string. A ``>`` inside a line is part of it."""
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", meta["file_path"].alias("path"), (meta["file_block_start"] == 0).alias("at_start"))

    def headed(batches):
        last = None
        for batch in batches:
            rows = []
            for value, place, at_start in zip(*(batch.column(c).to_pylist() for c in ("value", "path", "at_start")), strict=True):
                opens, last = at_start and place != last, place
                rows.append(value[1:] if opens and value.startswith(">") else "\n" + value if opens else value)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["record"])

    parts = F.split("record", "\n", 2)
    rows = raw.mapInArrow(headed, "record string").select(
        F.trim(F.regexp_replace(parts[0], "\r$", "")).alias("seq_name"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "").alias("seq")
    )
    return rows.where("seq_name <> '' OR seq <> ''")


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(comp_id, fms, ims) of lines ``index TAB moves TAB count TAB fm:mask ...``; lines that do not hold as many I-moves as
    they say raise."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) <> ''").select(p[0].cast("bigint").alias("comp_id"), numbers(p[1]).alias("fms"), p[2].cast("int").alias("n"), F.regexp_extract_all(F.coalesce(F.get(p, F.lit(3)), F.lit("")), F.lit(r"(\d+:\d+)")).alias("ims"))
    moves = F.transform("ims", lambda x: F.struct(F.split(x, ":")[0].cast("bigint").alias("fm"), F.split(x, ":")[1].cast("int").alias("mask")))
    checked = F.when(F.size("ims") == F.col("n"), moves).otherwise(F.raise_error(F.lit("broken component line")).cast("array<struct<fm:bigint,mask:int>>"))
    return rows.select("comp_id", "fms", checked.alias("ims"))


def read_histograms(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, sketch, method, seq_name, density, gap, n) of histogram files named ``<dataset>_<sketch>_set..._<method>.histo``; the density is null
    where a record has no such line."""
    name = F.regexp_extract(F.col("_metadata.file_name"), "(.*)", 1)
    lines = spark.read.text(path, wholetext=True).select(name.alias("file"), F.explode(F.split("value", "(?m)^(?=>)")).alias("record")).where("trim(record) <> ''")
    rows = lines.select(
        F.regexp_extract("file", "^(.*?)_", 1).alias("dataset"),
        F.regexp_extract("file", "_(.*?)_set", 1).alias("sketch"),
        F.regexp_extract("file", r"_(.)\.", 1).alias("method"),
        F.regexp_extract("record", "^>([^\n]*)", 1).alias("seq_name"),
        F.expr(r"try_cast(nullif(regexp_extract(record, '(?m)^# density (\\S+)', 1), '') as double)").alias("density"),
        F.explode(F.regexp_extract_all("record", F.lit(r"(?m)^(\d+ \d+)\s*$"))).alias("pair"),
    )
    return rows.select("dataset", "sketch", "method", "seq_name", "density", F.split("pair", " ")[0].cast("bigint").alias("gap"), F.split("pair", " ")[1].cast("bigint").alias("n"))


def read_scc(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, sketch, method, n_scc, n_nodes) of files named ``<dataset>_<sketch>_set..._<method>.scc`` with lines ``components,nodes``."""
    counts = numbers("value")
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), counts.alias("n")).where(F.size("n") == 2)
    return lines.select(
        F.regexp_extract("file", "^(.*?)_", 1).alias("dataset"), F.regexp_extract("file", "_(.*?)_set", 1).alias("sketch"),
        F.regexp_extract("file", r"_(.)\.", 1).alias("method"), F.col("n")[0].alias("n_scc"), F.col("n")[1].alias("n_nodes"),
    )


def scc_statistics(counts: DataFrame) -> DataFrame:
    """Mean and deviation of both counts over the repeats of each dataset, sketch and method."""
    return counts.groupBy("dataset", "sketch", "method").agg(
        *[f(c).alias(f"{name}_{c}") for c in ("n_scc", "n_nodes") for name, f in (("mean", F.avg), ("stdev", lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0))), ("min", F.min), ("max", F.max))]
    )


def set_line(mers, separator: str = ",") -> Column:
    """A set as one sorted, separated line."""
    return F.array_join(F.transform(F.array_sort(col(mers)), lambda m: m.cast("string")), separator)


def write_set(mers: DataFrame, path: str, separator: str = ",") -> None:
    """Sets (set_id, mer) as one line each."""
    mers.groupBy("set_id").agg(F.collect_list("mer").alias("mers")).select(set_line("mers", separator)).write.text(path)


def complement_pairs(mers: DataFrame, space) -> DataFrame:
    """(line): each word of column mer with its reverse complement, ``m,rc``."""
    return mers.select(F.format_string("%d,%d", "mer", space.reverse_complement("mer")).alias("line"))


def component_line(comp_id="comp_id", fms="fms", ims="ims") -> Column:
    pairs = F.array_join(F.transform(col(ims), lambda x: F.concat_ws(":", x["fm"].cast("string"), x["mask"].cast("string"))), " ")
    return F.concat_ws("\t", col(comp_id).cast("string"), set_line_unsorted(fms), F.size(col(ims)).cast("string"), pairs)


def write_components(rows: DataFrame, path: str) -> None:
    """Components (comp_id, fms, ims) added to those of a folder, a line each."""
    rows.select(component_line().alias("line")).write.mode("append").text(path)


def set_line_unsorted(values, separator: str = " ") -> Column:
    return F.array_join(F.transform(col(values), lambda m: m.cast("string")), separator)


def component_dot(edges: DataFrame) -> DataFrame:
    """(line) of a drawing of component edges (src, dst, fm, mask)."""
    return edges.select(F.format_string("n_%d -> n_%d [label=\"%d:%d\"];", "src", "dst", "fm", "mask").alias("line"))


def fmove_dot(edges: DataFrame) -> DataFrame:
    """(line) of a drawing of F-move edges between sets (src and dst arrays, fm)."""
    return edges.select(F.format_string("\"%s\" -> \"%s\" [label=\"%d\"];", set_line("src"), set_line("dst"), F.col("fm")).alias("line"))


def layer_dot(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(line) of a ranked drawing: a line for each node, the nodes of each layer on one rank, then the edges.

    A node's tooltip is its set. Where ``nodes`` has the columns ``shortest`` and ``longest`` (paths outside the set) they are its label.
    """
    of = lambda layer, mers: F.concat(F.lit("n"), layer.cast("string"), F.lit("_"), F.hex(F.xxhash64(F.to_json(mers))))
    told = {"shortest", "longest"} <= set(nodes.columns)
    label = F.format_string(", label=\"%d:%d\"", "shortest", "longest") if told else F.lit("")
    named = nodes.select("layer", of(F.col("layer"), F.col("mers")).alias("node"), set_line("mers").alias("tip"), label.alias("label"))
    each = named.select(F.format_string("%s [tooltip=\"%s\"%s];", "node", "tip", "label").alias("line"))
    ranks = named.groupBy("layer").agg(F.array_join(F.array_sort(F.collect_list("node")), "; ").alias("nodes"))
    last = links.agg(F.max("layer").alias("m"))
    closed = links.join(F.broadcast(last), F.lit(True)).withColumn("to", F.when(F.col("layer") == F.col("m"), 0).otherwise(F.col("layer") + 1))
    drawn = closed.select(F.format_string("%s -> %s [label=\"%d\"];", of(F.col("layer"), F.col("src")), of(F.col("to"), F.col("dst")), F.col("fm")).alias("line"))
    return each.union(ranks.select(F.format_string("{ rank=same; %s }", "nodes").alias("line"))).union(drawn)


def write_dot(lines: DataFrame, path: str) -> None:
    """A digraph of lines, in one file: drawings are small, and a drawing cannot be in parts."""
    spark = lines.sparkSession
    whole = spark.createDataFrame([(0, "digraph {")], "part int, line string").union(lines.select(F.lit(1).alias("part"), "line")).union(spark.createDataFrame([(2, "}")], "part int, line string"))
    whole.coalesce(1).sortWithinPartitions("part", "line").select("line").write.text(path)


def histogram_lines(hist: DataFrame, name: str = "seq_name") -> DataFrame:
    """(seq_name, pos, line): a header and ``gap n`` lines for each record of a histogram."""
    rows = hist.select(name, F.col("gap").cast("int").alias("pos"), F.format_string("%d %d", "gap", "n").alias("line"))
    heads = hist.select(name).distinct().select(name, F.lit(-1).alias("pos"), F.concat(F.lit(">"), F.col(name)).alias("line"))
    return heads.union(rows)


def density_lines(sketched: DataFrame, name: str = "seq_name") -> DataFrame:
    """(seq_name, line): ``# density d`` of each record of a sketch, selected words in all words; records without words have none."""
    rows = sketched.groupBy(name).agg(F.sum("n_hits").alias("n"), F.sum("n_kmers").alias("all")).where("all > 0")
    return rows.select(name, F.concat(F.lit("# density "), (F.col("n") / F.col("all")).cast("string")).alias("line"))


def write_histograms(hist: DataFrame, path: str, name: str = "seq_name") -> None:
    """Histograms as text, the lines of each record together and in order; records are spread over files."""
    histogram_lines(hist, name).repartition(name).sortWithinPartitions(name, "pos").select("line").write.text(path)


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with their ordinal inside a key."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
