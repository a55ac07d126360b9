"""Queries over the driver tables whose words come from the data: chunks, observed graphs, bit sets, long words, selection."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, kspace
from ..functions.kspace import KmerSpace
from ..operators import bits, chunks, frontier, graph, observed, scan, select, sets
from ..shared import shared_dir, small_batches, written
from ..sources import records as files
from ..streaming import records
from ..streaming import sketch as stream
from .queries import A4K4, SQL_SEQ, SQL_TURNS, hits_under, query, sql_gaps, sql_kmers, sql_mykkeltveit, sql_rc, sql_universe, table, texts

A4K5, A4K12, A4K6 = KmerSpace(4, 5), KmerSpace(4, 12), KmerSpace(4, 6)

# 1. records in chunks ------------------------------------------------------------------------------


@query(sql_gaps("canonical") + " SELECT doc_id, gap, count(*) AS n FROM g GROUP BY doc_id, gap")
def chunked_hist_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap histograms of documents that come in chunks of 1,000 bytes, dealt over all tasks."""
    pieces = chunks.cut_texts(table(spark, sf_dir, "documents"), "doc_id", size=1000).repartition("doc_id", "chunk")
    return chunks.gap_counts(pieces, hits_under(spark, A4K4, lambda m: sets.in_mykkeltveit(A4K4, m), "canonical"), A4K4.k, key="doc_id")


@query(
    sql_gaps("straight").replace("SELECT doc_id, source, lang, regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM documents", "SELECT source AS doc_id, source, source AS lang, regexp_replace(lower(string_agg(coalesce(text, ''), '' ORDER BY doc_id)), '[^acgt]', '', 'g') AS seq FROM documents GROUP BY source")
    + " SELECT source, CAST(count(*) AS BIGINT) AS n_hits, max(gap) AS widest, CAST(sum(gap) AS BIGINT) AS reach FROM g GROUP BY source"
)
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as one long record whose chunks are its documents: hits, the widest gap and the place of the last hit."""
    pieces = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    found = chunks.gap_counts(pieces, hits_under(spark, A4K4, lambda m: sets.in_mykkeltveit(A4K4, m)), A4K4.k, key="source", order="doc_id")
    return found.groupBy("source").agg(F.sum("n").alias("n_hits"), F.max("gap").alias("widest"), F.sum(F.col("gap") * F.col("n")).alias("reach"))


# 2. graphs of observed words -----------------------------------------------------------------------

def _sql_links(k: int) -> str:
    """Pairs of words of k letters that follow one another."""
    words = sql_kmers(k + 1).replace("SELECT doc_id, source, lang, CAST(i AS BIGINT) AS pos,", "SELECT")
    return words + f", e AS MATERIALIZED (SELECT DISTINCT CAST(mer // 4 AS BIGINT) AS src, CAST(mer % {4**k} AS BIGINT) AS dst FROM k)"


SQL_TAKEN = sql_universe(4, 5) + f", m AS (SELECT mer, {sql_rc('mer', 4, 5)} AS rc, {sql_mykkeltveit('mer', 4, 5)} AS held FROM u)"


def _sql_components() -> str:
    taken = {
        "straight": "SELECT mer FROM m WHERE held", "union": "SELECT mer FROM m WHERE held OR rc IN (SELECT mer FROM m WHERE held)",
        "canonical": "SELECT mer FROM m WHERE least(mer, rc) IN (SELECT mer FROM m WHERE held)",
    }
    edges = " UNION ALL ".join(f"SELECT '{mode}' AS mode, src, dst FROM e WHERE src NOT IN ({s}) AND dst NOT IN ({s})" for mode, s in taken.items())
    return "WITH RECURSIVE " + _sql_links(5) + ", " + SQL_TAKEN + f""", f AS ({edges}), r AS (SELECT mode, src AS a, dst AS b FROM f UNION SELECT r.mode, r.a, f.dst FROM r JOIN f ON f.mode = r.mode AND f.src = r.b),
    c AS (SELECT mode, a, (SELECT min(y.b) FROM r y WHERE y.mode = x.mode AND y.a = x.a AND EXISTS (SELECT 1 FROM r z WHERE z.mode = y.mode AND z.a = y.b AND z.b = y.a)) AS scc FROM r x WHERE a = b),
    n AS (SELECT unnest(['straight', 'canonical', 'union']) AS mode)
    SELECT n.mode, count(DISTINCT scc) AS n_scc, count(a) AS n_nodes FROM n LEFT JOIN c ON c.mode = n.mode GROUP BY n.mode"""


def _observed(spark: SparkSession, sf_dir: str, space: KmerSpace, modes: tuple[str, ...]) -> DataFrame:
    """(set_id, src, dst): the words that follow one another in documents, without the Mykkeltveit set under each mode."""
    chosen = sets.generate(spark, space, sets.in_mykkeltveit(space, "mer")).select(F.lit(0).alias("set_id"), "mer")
    with small_batches(spark):
        links = written(observed.word_edges(texts(spark, sf_dir), space), "links")
    parts = []
    for mode in modes:
        taken = graph.effective(space, chosen, mode).select(F.lit(mode).alias("set_id"), "mer")
        parts.append(observed.without(links.select(F.lit(mode).alias("set_id"), "src", "dst"), taken))
    return reduce(DataFrame.union, parts)


@query(_sql_components())
def observed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components among the 5-mers of documents outside the Mykkeltveit set, by mode."""
    modes = ("straight", "canonical", "union")
    found = observed.components(_observed(spark, sf_dir, A4K5, modes)).groupBy("set_id").agg(F.countDistinct("scc_id").alias("n_scc"), F.count("*").alias("n_nodes"))
    zero = F.lit(0).cast("bigint")
    named = spark.createDataFrame([(m,) for m in modes], "mode string")
    return named.join(found, named["mode"] == found["set_id"], "left").select("mode", F.coalesce("n_scc", zero).alias("n_scc"), F.coalesce("n_nodes", zero).alias("n_nodes"))


@query(
    "WITH RECURSIVE " + _sql_links(4) + ", " + sql_universe(4, 4) + f", m AS (SELECT mer FROM u WHERE {sql_mykkeltveit('mer', 4, 4)}), "
    "f AS (SELECT src, dst FROM e WHERE src NOT IN (SELECT mer FROM m) AND dst NOT IN (SELECT mer FROM m)), p AS (SELECT src AS node, 1 AS n FROM f UNION SELECT f.dst, p.n + 1 FROM p JOIN f ON f.src = p.node) "
    "SELECT (SELECT count(*) FROM (SELECT src FROM f UNION SELECT dst FROM f)) AS n_nodes, CAST(max(n) AS BIGINT) AS longest FROM p"
)
def observed_longest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest chain of 4-mers that follow one another in documents and meet no word of the Mykkeltveit set."""
    return observed.chains(_observed(spark, sf_dir, A4K4, ("straight",))).select("n_nodes", "longest")


@query("WITH RECURSIVE " + _sql_links(5) + ", h AS (SELECT 27 AS node, 0 AS hops UNION SELECT e.dst, h.hops + 1 FROM h JOIN e ON e.src = h.node WHERE h.hops < 12) SELECT CAST(node AS BIGINT) AS node, CAST(min(hops) AS BIGINT) AS hops FROM h GROUP BY node")
def observed_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest steps from the word acgt (after a first a) to each 5-mer over words that follow one another in documents; the rounds outlive the driver."""
    starts = spark.createDataFrame([(27,)], "node long")
    return frontier.hops(observed.word_edges(texts(spark, sf_dir), A4K5), starts, f"{shared_dir(spark)}/hops-{uuid.uuid4().hex}")


# 3. bit sets ---------------------------------------------------------------------------------------


def _sql_words(source: str, k: int, name: str) -> str:
    power = " + ".join(f"(strpos('acgt', substr(seq, CAST(i AS BIGINT) + {j + 1}, 1)) - 1) * {4 ** (k - 1 - j)}" for j in range(k))
    return f"{name}q AS (SELECT regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM {source}), {name} AS (SELECT DISTINCT CAST({power} AS BIGINT) AS mer FROM (SELECT seq, unnest(range(greatest(length(seq) - {k - 1}, 0))) AS i FROM {name}q))"


SQL_SHARED = "WITH " + _sql_words("documents", 12, "d") + ", " + _sql_words("benchmark", 12, "b")


@query(SQL_SHARED + " SELECT mer FROM d INTERSECT SELECT mer FROM b")
def benchmark_words_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12-mers of documents that occur in the benchmark too, by bit sets."""
    known = bits.text_bits(table(spark, sf_dir, "benchmark"), A4K12)
    return bits.mers_of(bits.both(bits.text_bits(texts(spark, sf_dir), A4K12), known))


@query(
    SQL_SHARED + f""", c AS (SELECT mer, {sql_rc('mer', 4, 12)} AS rc FROM d), x AS (SELECT mer, rc, mer IN (SELECT mer FROM b) AS own, rc IN (SELECT mer FROM b) AS turned FROM c)
    SELECT 'straight' AS mode, count(*) FILTER (own) AS n_inside, count(*) FILTER (NOT own) AS n_outside FROM x
    UNION ALL SELECT 'union', count(*) FILTER (own OR turned), count(*) FILTER (NOT (own OR turned)) FROM x
    UNION ALL SELECT 'canonical', count(*) FILTER (CASE WHEN mer <= rc THEN own ELSE turned END), count(*) FILTER (NOT CASE WHEN mer <= rc THEN own ELSE turned END) FROM x"""
)
def benchmark_words_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many 12-mers of documents are in the benchmark's set and outside it, under each membership mode."""
    words, known = (written(bits.text_bits(x, A4K12), "bits") for x in (texts(spark, sf_dir), table(spark, sf_dir, "benchmark")))
    parts = []
    for mode in ("straight", "canonical", "union"):
        inside = bits.under_mode(A4K12, words, known, mode)
        counts = inside.agg(bits.size(inside).alias("n_inside")).crossJoin(words.agg(bits.size(words).alias("n")))  # a row each
        parts.append(counts.select(F.lit(mode).alias("mode"), "n_inside", (F.col("n") - F.col("n_inside")).alias("n_outside")))
    return reduce(DataFrame.union, parts)


# 4. syncmers of long words -------------------------------------------------------------------------


def _sql_syncmers(k: int, s: int, t: int, order: int, rank: str = "code") -> str:
    power = " + ".join(f"(strpos('acgt', substr(seq, CAST(i AS BIGINT) + {j + 1}, 1)) - 1) * {4 ** (s - 1 - j)}" for j in range(s))
    steps, x = "", rank
    for r in range(4 if order else 0):
        mask = (1 << s) - 1
        steps += f", r{r} AS (SELECT doc_id, pos, n, ((({x} & {mask}) << {s}) | xor({x} >> {s}, ((({x} & {mask}) * 40503 + {order * 9176 + r * 7919}) // 8) & {mask})) AS c{r} FROM {'s' if r == 0 else f'r{r - 1}'})"
        x = f"c{r}"
    last = "r3" if order else "s"
    return f"""WITH q AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM documents),
    s AS (SELECT doc_id, CAST(i AS BIGINT) AS pos, length(seq) AS n, CAST({power} AS BIGINT) AS code FROM (SELECT *, unnest(range(greatest(length(seq) - {s - 1}, 0))) AS i FROM q)){steps},
    w AS (SELECT doc_id, pos, n, min({{'v': {x}, 'p': pos}}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - s} FOLLOWING) AS best FROM {last}),
    h AS (SELECT doc_id, pos FROM w WHERE pos + {k} <= n AND best.p - pos = {t}),
    g AS (SELECT doc_id, pos - lag(pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM h) SELECT gap, count(*) AS n FROM g GROUP BY gap"""


@query(_sql_syncmers(31, 11, 10, 5))
def long_syncmer_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of 31-mers whose least 11-mer, in a permuted order, is in the middle."""
    return scan.gap_counts(texts(spark, sf_dir), scan.syncmer_hits(4, 31, 11, 10, lambda x: arrays.feistel_order(x, 5, 11)))


@query(_sql_syncmers(101, 14, 0, 0))
def wide_syncmer_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of 101-mers that begin with their least 14-mer in plain order; no word of 101 letters is ever formed."""
    return scan.gap_counts(texts(spark, sf_dir), scan.syncmer_hits(4, 101, 14, 0))


@query(_sql_syncmers(12, 5, 3, 0, "((code * 7368787 + 12345) % 1024)"))
def default_syncmer_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of 12-mers whose least 5-mer (half the length less one), by a table of ranks, is fourth."""
    return scan.gap_counts(texts(spark, sf_dir), scan.default_syncmer_hits(4, 12, 3))


@query(_sql_syncmers(40, 19, 20, 12345))
def default_syncmer_hist_of_long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of 40-mers whose least 19-mer is in the 21st place: more s-mers than a table holds, so their ranks are computed."""
    return scan.gap_counts(texts(spark, sf_dir), scan.default_syncmer_hits(4, 40, 20))


def _sql_rounds(x: str, seed: int, half: int) -> str:
    """Four CTEs of the rounds of ``feistel_order`` over a table w(mer)."""
    mask, out = (1 << half) - 1, ""
    for r in range(4):
        out += f", f{r} AS (SELECT mer, (({x} & {mask}) << {half}) | xor({x} >> {half}, ((({x} & {mask}) * 40503 + {seed * 9176 + r * 7919}) // 8) & {mask}) AS x{r} FROM {'w' if r == 0 else f'f{r - 1}'})"
        x = f"x{r}"
    return out


@query("WITH " + sql_kmers(6).replace("SELECT doc_id, source, lang, CAST(i AS BIGINT) AS pos,", "SELECT") + ", w AS (SELECT DISTINCT mer FROM k)" + _sql_rounds("mer", 3, 6) + " SELECT mer, CAST(x3 AS BIGINT) AS rank FROM f3")
def permuted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 6-mers of documents and their ranks under four Feistel rounds."""
    return scan.word_counts(texts(spark, sf_dir), A4K6).select("mer", kspace.feistel_order("mer", 3, 6).alias("rank"))


# 5. long words -------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT translate(regexp_replace(lower(text), '[^acgt]', '', 'g'), 'acgt', 'ACGT') AS letters FROM documents WHERE text IS NOT NULL),
w AS (SELECT substr(letters, CAST(i AS BIGINT) + 1, 41) AS word FROM (SELECT letters, unnest(range(greatest(length(letters) - 40, 0))) AS i FROM t)),
c AS (SELECT least(word, reverse(translate(word, 'ACGT', 'TGCA'))) AS word, count(*) AS n FROM w GROUP BY 1)
SELECT CAST(n AS BIGINT) AS times, count(*) AS n_words, min(word) AS least, max(word) AS most FROM c GROUP BY n
""")
def canonical_41mers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many canonical words of 41 letters occur how often in documents, with the least and the greatest of each."""
    word = F.struct("high", "low")
    counts = scan.long_word_counts(texts(spark, sf_dir), 41).groupBy(F.col("n").alias("times")).agg(F.count("*").alias("n_words"), F.min(word).alias("a"), F.max(word).alias("z"))
    return counts.select("times", "n_words", scan.long_word_text(41, "a.high", "a.low").alias("least"), scan.long_word_text(41, "z.high", "z.low").alias("most"))


@query("""
WITH t AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^acgt]', '', 'g'), 'acgt', 'ACGT') AS letters FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, substr(letters, CAST(i AS BIGINT) + 1, 35) AS word FROM (SELECT doc_id, letters, unnest(range(greatest(length(letters) - 34, 0))) AS i FROM t)),
x AS (SELECT doc_id, word, list_min(list_transform(range(35), lambda i: substr(word, i + 1) || substr(word, 1, i))) AS pcr FROM w)
SELECT doc_id, count(*) AS n_words, count(*) FILTER (word = pcr) AS n_least, min(pcr) AS least, max(pcr) AS most FROM x GROUP BY doc_id
""")
def registers_of_35mers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registers of all words of 35 letters of each document, by least rotations in linear time."""
    return scan.registers(texts(spark, sf_dir), 35, "doc_id")


# 6. stretches between foreign symbols --------------------------------------------------------------


@query("""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]', '', 'g'), '[^acgt]')) AS seq FROM documents),
s AS (SELECT doc_id, seq FROM p WHERE length(seq) >= 4),
k AS (SELECT doc_id, ((strpos('acgt', substr(seq, i + 1, 1)) - 1) * 64 + (strpos('acgt', substr(seq, i + 2, 1)) - 1) * 16 + (strpos('acgt', substr(seq, i + 3, 1)) - 1) * 4 + strpos('acgt', substr(seq, i + 4, 1)) - 1)::BIGINT AS mer
      FROM (SELECT doc_id, seq, unnest(range(length(seq) - 3)) AS i FROM s))
SELECT k.doc_id, count(*) AS n_kmers, any_value(n) AS n_stretches, CAST(sum(mer) AS BIGINT) AS total, min(mer) AS least, max(mer) AS most
FROM k JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) c ON c.doc_id = k.doc_id GROUP BY k.doc_id
""")
def kmers_between_foreign_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-mers of documents that do not bridge a symbol outside the alphabet."""
    return scan.word_totals(texts(spark, sf_dir), A4K4, "doc_id", on_invalid="split")


# 7. selection --------------------------------------------------------------------------------------

SQL_SMALLEST = "WITH " + _sql_words("documents", 12, "d")


@query(SQL_SMALLEST + " SELECT mer, (mer * 7368787 + 12345) % 16777216 AS rank FROM d ORDER BY rank LIMIT 500")
def smallest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 distinct 12-mers of documents with the smallest numbers under a permutation: a sample of exact size, by radix selection."""
    words = bits.mers_of(bits.text_bits(texts(spark, sf_dir), A4K12))
    ranked = written(words.select("mer", A4K12.affine_permutation("mer", 7368787, 12345).alias("rank")), "ranked")
    return select.smallest(ranked, 500, value="rank", tie="mer", bits=24, tail=64)


# 8. statistics on three levels ---------------------------------------------------------------------


@query(
    "WITH " + sql_universe(4, 4) + f", m AS (SELECT mer, {sql_rc('mer', 4, 4)} AS rc, {sql_mykkeltveit('mer', 4, 4)} AS held FROM u), " + sql_kmers() + """,
    t AS (SELECT mer, 'mykkeltveit' AS sketch, 'straight' AS mode FROM m WHERE held UNION ALL SELECT mer, 'mykkeltveit', 'canonical' FROM m WHERE least(mer, rc) IN (SELECT mer FROM m WHERE held)
          UNION ALL SELECT mer, 'every_third', 'straight' FROM m WHERE mer % 3 = 0 UNION ALL SELECT mer, 'every_third', 'canonical' FROM m WHERE least(mer, rc) % 3 = 0),
    n AS (SELECT DISTINCT sketch, mode FROM t), h AS (SELECT doc_id, sketch, mode, count(*) AS hits FROM k JOIN t USING (mer) GROUP BY ALL)
    SELECT q.source AS dataset, n.sketch, n.mode AS method, round(avg(coalesce(hits, 0)), 6) AS mean, round(coalesce(stddev_samp(coalesce(hits, 0)), 0), 6) AS stdev,
           min(coalesce(hits, 0)) AS min, max(coalesce(hits, 0)) AS max
    FROM q CROSS JOIN n LEFT JOIN h ON h.doc_id = q.doc_id AND h.sketch = n.sketch AND h.mode = n.mode GROUP BY ALL"""
)
def statistics_by_dataset_sketch_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a document over dataset (source), sketch and method (mode), documents without hits included."""
    kinds = {"mykkeltveit": lambda m: sets.in_mykkeltveit(A4K4, m), "every_third": lambda m: m % 3 == 0}
    parts = []
    for name, predicate in kinds.items():
        for mode in ("straight", "canonical"):
            counts = scan.text_hits(texts(spark, sf_dir), hits_under(spark, A4K4, predicate, mode), "source")
            parts.append(counts.select(F.col("source").alias("dataset"), F.lit(name).alias("sketch"), F.lit(mode).alias("method"), "n_hits"))
    rows = reduce(DataFrame.union, parts).groupBy("dataset", "sketch", "method")
    spread = F.round(F.coalesce(F.stddev_samp("n_hits"), F.lit(0.0)), 6)
    return rows.agg(F.round(F.avg("n_hits"), 6).alias("mean"), spread.alias("stdev"), F.min("n_hits").alias("min"), F.max("n_hits").alias("max"))




# 9. records that arrive out of order -----------------------------------------------------------------


@query(sql_gaps("canonical").replace(SQL_SEQ, SQL_TURNS) + " SELECT doc_id AS conv_id, gap, count(*) AS n FROM g GROUP BY doc_id, gap")
def shuffled_turns_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of conversations whose turns arrive in any order over several batches, each with a mark that tells how many there are."""
    turns = table(spark, sf_dir, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = turns.select("conv_id", place.alias("piece"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("bigint").alias("n"))
    marks = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.lit(None).cast("int").alias("piece"), F.lit(None).cast("string").alias("text"), "n")
    where = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    arrivals = rows.union(marks).withColumn("batch", F.pmod(F.xxhash64("conv_id", "piece"), F.lit(4)))
    arrivals.repartition("batch").write.partitionBy("batch").parquet(where)
    chunks_ = spark.readStream.schema(arrivals.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/batch=*")
    pieces = records.pieces_of(chunks_, "conv_id", "piece", ends="n")
    hits = hits_under(spark, A4K4, lambda m: sets.in_mykkeltveit(A4K4, m), "canonical")
    with records.keyed_state(spark):
        found = stream.drained(records.record_gaps(pieces, hits, A4K4.k, "conv_id"), "record-gaps")
    return found.where("gap IS NOT NULL").groupBy("conv_id", "gap").agg(F.count("*").alias("n"))


# 10. files ------------------------------------------------------------------------------------------

SQL_PAGES = "SELECT page_id AS doc_id, '' AS source, '' AS lang, regexp_replace(lower(coalesce(html, '')), '[^acgt]', '', 'g') AS seq FROM pages"


@query(sql_gaps("canonical").replace(SQL_SEQ, SQL_PAGES) + " SELECT doc_id AS page_id, gap, count(*) AS n FROM g GROUP BY doc_id, gap")
def pages_as_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as FASTA records and read back by byte ranges of 50,000 bytes, which cut records: the gaps of each page."""
    files.register(spark)
    where = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    letters = F.upper(F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), "[^acgt]", ""))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), letters.alias("text"))
    with small_batches(spark):
        pages.write.format("kmer_fasta").mode("append").save(where)
    pieces = files.read_fasta_chunks(spark, where, split_bytes=50_000)
    hits = hits_under(spark, A4K4, lambda m: sets.in_mykkeltveit(A4K4, m), "canonical")
    with small_batches(spark):
        found = chunks.gap_counts(pieces.select("seq_name", "chunk", "text"), hits, A4K4.k, key="seq_name")
    return found.select(F.col("seq_name").cast("bigint").alias("page_id"), "gap", "n")
