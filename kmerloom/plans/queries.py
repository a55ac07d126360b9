"""Registered queries over the driver tables, with equivalent SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kspace, words
from ..functions.kspace import KmerSpace, TextKmers
from ..operators import components, graph, moves, scan, search, sets, sketch
from ..streaming import sketch as stream

A4K4, A3K5, A4K3, A2K6, A2K4, A2K5 = KmerSpace(4, 4), KmerSpace(3, 5), KmerSpace(4, 3), KmerSpace(2, 6), KmerSpace(2, 4), KmerSpace(2, 5)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the same mathematics, written on digit lists ------------------------------------------------


def sql_digits(m: str, a: int, k: int) -> str:
    return f"list_transform(range({k}), lambda i: CAST(({m} // CAST({a} ** ({k} - 1 - i) AS BIGINT)) % {a} AS BIGINT))"


def sql_number(digits: str, a: int) -> str:
    return f"CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), {digits}), lambda x, y: x * {a} + y) AS BIGINT)"


def sql_rotations(m: str, a: int, k: int) -> str:
    return f"list_transform(range({k}), lambda r: CAST(({m} % CAST({a} ** ({k} - r) AS BIGINT)) * CAST({a} ** r AS BIGINT) + {m} // CAST({a} ** ({k} - r) AS BIGINT) AS BIGINT))"


def sql_pcr(m: str, a: int, k: int) -> str:
    return f"list_min({sql_rotations(m, a, k)})"


def sql_rc(m: str, a: int, k: int) -> str:
    return sql_number(f"list_transform(list_reverse({sql_digits(m, a, k)}), lambda d: {a - 1} - d)", a)


def sql_embedding(m: str, a: int, k: int, offset: int = 1) -> tuple[str, str]:
    space = KmerSpace(a, k)
    return tuple(
        "(" + " + ".join(f"(({m} // {a**i}) % {a}) * ({space.root_of_unity(k + offset - 1 - i)[axis]!r})" for i in range(k)) + ")" for axis in (0, 1)
    )  # type: ignore[return-value]


def sql_mykkeltveit(m: str, a: int, k: int) -> str:
    f = a ** (k - 1)
    re, im = sql_embedding(m, a, k)
    _, im_next = sql_embedding(f"(({m} % {f}) * {a} + {m} // {f})", a, k)
    e = "1e-10"
    return f"(CASE WHEN abs({re}) < {e} AND abs({im}) < {e} THEN {m} = {sql_pcr(m, a, k)} ELSE (abs({im}) < {e} AND {re} < 0) OR ({im} < -{e} AND {im_next} > {e}) END)"


def sql_universe(a: int, k: int, name: str = "u") -> str:
    return f"{name} AS (SELECT CAST(range AS BIGINT) AS mer FROM range({a**k}))"


# 1. algebra --------------------------------------------------------------------------------------


@query("WITH " + sql_universe(4, 4) + f", d AS (SELECT mer, {sql_digits('mer', 4, 4)} AS d FROM u) SELECT mer, d[1] AS left_base, d[4] AS right_base, d[2] AS second FROM d")
def mer_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A4K4
    return s.universe(spark).select("mer", s.left_base("mer").alias("left_base"), s.right_base("mer").alias("right_base"), s.digit("mer", 1).alias("second"))


@query("WITH " + sql_universe(3, 5) + f" SELECT mer, ({sql_rotations('mer', 3, 5)})[2] AS next FROM u")
def mer_rotate_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A3K5.universe(spark).select("mer", A3K5.rotate_next("mer").alias("next"))


@query("WITH " + sql_universe(3, 5) + f" SELECT mer, ({sql_rotations('mer', 3, 5)})[5] AS prev FROM u")
def mer_rotate_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A3K5.universe(spark).select("mer", A3K5.rotate_prev("mer").alias("prev"))


@query("WITH " + sql_universe(4, 4) + " SELECT u.mer, CAST(b.range AS BIGINT) AS base, CAST((u.mer * 4 + b.range) % 256 AS BIGINT) AS dst FROM u, range(4) b")
def graph_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A4K4.universe(spark).select("mer", F.posexplode(A4K4.successors("mer")).alias("base", "dst")).select("mer", F.col("base").cast("bigint").alias("base"), "dst")


@query("WITH " + sql_universe(4, 4) + " SELECT u.mer, CAST(b.range AS BIGINT) AS base, CAST(u.mer // 4 + b.range * 64 AS BIGINT) AS src FROM u, range(4) b")
def graph_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A4K4.universe(spark).select("mer", F.posexplode(A4K4.predecessors("mer")).alias("base", "src")).select("mer", F.col("base").cast("bigint").alias("base"), "src")


@query("WITH " + sql_universe(4, 4) + " SELECT a.mer, b.mer AS companion FROM u a JOIN u b ON a.mer % 64 = b.mer % 64")
def companions_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A4K4
    return s.universe(spark).select("mer", F.explode(F.array(*[s.left_companion("mer", b) for b in range(4)])).alias("companion"))


@query("WITH " + sql_universe(4, 4) + " SELECT a.mer, b.mer AS companion FROM u a JOIN u b ON a.mer // 4 = b.mer // 4")
def companions_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A4K4
    return s.universe(spark).select("mer", F.explode(F.array(*[s.right_companion("mer", b) for b in range(4)])).alias("companion"))


@query("WITH " + sql_universe(3, 5) + " SELECT mer, mer % 81 AS fmove, mer // 3 AS rfmove FROM u")
def fmove_rfmove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A3K5.universe(spark).select("mer", A3K5.suffix("mer").alias("fmove"), A3K5.prefix("mer").alias("rfmove"))


@query("WITH " + sql_universe(3, 5) + f", d AS (SELECT mer, {sql_digits('mer', 3, 5)} AS d FROM u) SELECT mer, len(list_distinct(d)) = 1 AS homopolymer, len(list_distinct(d[2:5])) = 1 AS fmove_homopolymer FROM d")
def homopolymers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A3K5
    return s.universe(spark).select("mer", s.is_homopolymer("mer").alias("homopolymer"), s.is_homopolymer_fmove(s.suffix("mer")).alias("fmove_homopolymer"))


@query("WITH " + sql_universe(4, 4) + f" SELECT mer, CAST(list_sum({sql_digits('mer', 4, 4)}) AS BIGINT) AS weight FROM u")
def weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A4K4.universe(spark).select("mer", A4K4.weight("mer").alias("weight"))


@query("WITH " + sql_universe(3, 5) + f" SELECT mer, {sql_rc('mer', 3, 5)} AS rc FROM u")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A3K5.universe(spark).select("mer", A3K5.reverse_complement("mer").alias("rc"))


@query("WITH " + sql_universe(4, 4) + f" SELECT mer, least(mer, {sql_rc('mer', 4, 4)}) AS canonical FROM u")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A4K4.universe(spark).select("mer", A4K4.canonical("mer").alias("canonical"))


@query("WITH " + sql_universe(4, 4) + f", t AS (SELECT mer, array_to_string({sql_digits('mer', 4, 4)}, '') AS word FROM u) SELECT mer, word, translate(word, '0123', 'ACGT') AS letters, translate(translate(word, '0123', 'ACGT'), 'ATCG', 'TAGC') AS complement, CAST((mer // 4) % 16 AS BIGINT) AS middle FROM t")
def mer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A4K4
    letters = F.translate(s.text("mer"), "0123", "ACGT")
    return s.universe(spark).select("mer", s.text("mer").alias("word"), letters.alias("letters"), kspace.transposition(letters, "AT", "CG").alias("complement"), s.subword("mer", 1, 2).alias("middle"))


@query("WITH " + sql_universe(4, 4) + f", s AS (SELECT mer, CAST(b.range AS BIGINT) AS base, CAST((mer % 64) * 4 + b.range AS BIGINT) AS dst FROM u, range(4) b) SELECT mer, base, dst, {sql_rc('dst', 4, 4)} AS rc FROM s")
def successors_with_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A4K4
    first = s.reverse_complement(s.successor("mer", 0))
    rows = s.universe(spark).select("mer", first.alias("first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("base"))
    return rows.select("mer", "base", s.successor("mer", F.col("base")).alias("dst"), s.successor_rc("first", F.col("base")).alias("rc"))


LONG = TextKmers("ACGT", 35)


@query("""
WITH t AS (SELECT doc_id, substr(translate(regexp_replace(lower(text), '[^acgt]', '', 'g'), 'acgt', 'ACGT'), 1, 35) AS word FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, word, reverse(translate(word, 'ACGT', 'TGCA')) AS rc FROM t WHERE length(word) = 35)
SELECT doc_id, word, rc, least(word, rc) AS canonical, substr(word, 2) || substr(word, 1, 1) AS next,
       list_min(list_transform(range(35), lambda i: substr(word, i + 1) || substr(word, 1, i))) AS pcr FROM w
""")
def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 35 letters, too long for numbers, from the start of every document."""
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^acgt]", ""), "acgt", "ACGT")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(letters, 1, 35).alias("word")).where(F.length("word") == 35)
    w = LONG
    return rows.select("doc_id", "word", w.reverse_complement("word").alias("rc"), w.canonical("word").alias("canonical"), w.rotate_next("word").alias("next"), w.pcr("word").alias("pcr"))


@query("""
WITH t AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^acgt]', '', 'g'), 'acgt', 'ACGT') AS letters FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, substr(letters, CAST(i AS BIGINT) + 1, 35) AS word FROM (SELECT doc_id, letters, unnest(range(greatest(length(letters) - 34, 0))) AS i FROM t)),
x AS (SELECT doc_id, least(word, reverse(translate(word, 'ACGT', 'TGCA'))) AS canonical, word, substr(word, 2) || substr(word, 1, 1) AS next,
       list_min(list_transform(range(35), lambda i: substr(word, i + 1) || substr(word, 1, i))) AS pcr FROM w)
SELECT doc_id, count(*) AS n_words, count(*) FILTER (word = canonical) AS n_canonical, min(canonical) AS least_canonical, max(canonical) AS most_canonical,
       max(next) AS most_next, min(pcr) AS least_pcr, max(pcr) AS most_pcr FROM x GROUP BY doc_id
""")
def long_words_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 35 letters from every place of every document, as pairs of numbers; no word is ever a string."""
    return scan.long_word_ends(texts(spark, sf_dir), 35, "doc_id")


@query("WITH " + sql_universe(2, 6) + " SELECT count(*) AS n, count(DISTINCT (mer * 13 + 5) % 64) AS distinct_values FROM u")
def permutation_is_bijective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A2K6.universe(spark).agg(F.count("*").alias("n"), F.countDistinct(A2K6.affine_permutation("mer", 13, 5)).alias("distinct_values"))


@query("SELECT CAST(65536 AS BIGINT) AS n, CAST(65536 AS BIGINT) AS distinct_values")
def feistel_is_bijective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-round permutation of 16-bit numbers hits each once."""
    return spark.range(1 << 16).agg(F.count("*").alias("n"), F.countDistinct(kspace.pseudo_random_permutation("id", 7, half=8)).alias("distinct_values"))


# 2. words and registers --------------------------------------------------------------------------


@query("WITH " + sql_universe(4, 4) + f", p AS (SELECT mer, {sql_pcr('mer', 4, 4)} AS pcr, CAST(list_sum({sql_digits('mer', 4, 4)}) AS BIGINT) AS weight FROM u) SELECT mer, pcr, weight, row_number() OVER (PARTITION BY pcr ORDER BY mer) - 1 AS pos FROM p")
def pcr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import numbered

    rows = A4K4.universe(spark).select("mer", A4K4.pcr("mer").alias("pcr"), A4K4.weight("mer").alias("weight"))
    return numbered(rows, "pcr", "mer").select("mer", "pcr", "weight", F.col("ordinal").cast("bigint").alias("pos"))


@query("WITH " + sql_universe(2, 6) + f" SELECT {sql_pcr('mer', 2, 6)} AS pcr, count(*) AS n FROM u GROUP BY 1")
def pcr_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A2K6.universe(spark).groupBy(A2K6.pcr("mer").alias("pcr")).agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS alpha, CAST({k} AS BIGINT) AS k, CAST((SELECT sum(CAST({a} ** gcd(i, {k}) AS BIGINT)) FROM range(1, {k} + 1) t(i)) // {k} AS BIGINT) AS registers" for a, k in ((2, 3), (2, 8), (2, 10), (4, 4), (4, 6), (4, 8))))
def necklace_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, k, kspace.necklace_count(a, k)) for a, k in ((2, 3), (2, 8), (2, 10), (4, 4), (4, 6), (4, 8))]
    return spark.createDataFrame(rows, "alpha long, k long, registers long")


SQL_WORDS = "WITH " + sql_universe(2, 6) + f", w AS (SELECT mer, array_to_string({sql_digits('mer', 2, 6)}, '') AS word FROM u)"
SQL_LYNDON = "len(list_filter(range(1, len({w})), lambda j: NOT ({w} < substr({w}, j + 1)))) = 0"


@query(SQL_WORDS + f" SELECT mer, {SQL_LYNDON.format(w='word')} AS lyndon, {SQL_LYNDON.format(w='word')} AS lyndon_by_prefixes FROM w")
def lyndon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A2K6.universe(spark).select("mer", A2K6.text("mer").alias("word"))
    return rows.select("mer", words.is_lyndon("word").alias("lyndon"), words.is_lyndon_by_prefixes("word").alias("lyndon_by_prefixes"))


SQL_DIVISION = SQL_WORDS + f""", d AS (
  SELECT w.mer, w.word, i, (6 // i) * i AS power FROM w, range(1, 7) t(i)
  WHERE {SQL_LYNDON.format(w='word[1:i]')} AND word[1:(6 // i) * i] = repeat(word[1:i], 6 // i)
), m AS (SELECT mer, word, min(i) AS root FROM d GROUP BY mer, word)
SELECT mer, CAST(root AS BIGINT) AS root, CAST((6 // root) * root AS BIGINT) AS power, word[(6 // root) * root + 1:6] || word[1:(6 // root) * root] AS turned FROM m"""


@query(SQL_DIVISION)
def main_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A2K6.universe(spark).select("mer", A2K6.text("mer").alias("word"))
    d = words.main_division("word", 6)
    return rows.where(d.isNotNull()).select("mer", d["root"].cast("bigint").alias("root"), d["power"].cast("bigint").alias("power"), words.division_reversed("word", 6).alias("turned"))


SQL_FACTORS = """
, w AS (SELECT mer, array_to_string(list_transform(range(6), lambda i: (mer // CAST(2 ** (5 - i) AS BIGINT)) % 2), '') AS word FROM u),
f AS (SELECT mer, word, list_filter(range(1, 6), lambda i: substr(word, i + 1) < list_min(list_transform(range(i), lambda j: substr(word, j + 1)))) AS starts,
             list_filter(range(1, 7), lambda s: substr(word, 6 % s + 1) = repeat(substr(word, 6 % s + 1, s), CAST(6 // s AS INT)))[1] AS root FROM w)
SELECT mer, array_to_string(list_append(starts, 6), ',') AS factor_ends, CAST(6 % root AS BIGINT) AS rest, CAST(root AS BIGINT) AS root FROM f
"""


@query("WITH " + sql_universe(2, 6) + SQL_FACTORS)
def lyndon_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A2K6.universe(spark).select("mer", A2K6.text("mer").alias("word"))
    inverse = words.inverse_division("word", 6)
    ends = F.array_join(F.transform(words.lyndon_factors("word"), lambda x: x.cast("string")), ",")
    return rows.select("mer", ends.alias("factor_ends"), inverse["rest"].cast("bigint").alias("rest"), inverse["root"].cast("bigint").alias("root"))


# 3. sets -----------------------------------------------------------------------------------------


@query("WITH " + sql_universe(4, 4) + f" SELECT mer FROM u WHERE {sql_mykkeltveit('mer', 4, 4)}")
def mykkeltveit_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.generate(spark, A4K4, sets.in_mykkeltveit(A4K4, "mer"))


@query("WITH " + sql_universe(4, 6) + f" SELECT mer FROM u WHERE {sql_mykkeltveit('mer', 4, 6)}")
def mykkeltveit_set_a4k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = KmerSpace(4, 6)
    return sets.generate(spark, space, sets.in_mykkeltveit(space, "mer"))


SQL_CHAMPARNAUD = "WITH " + sql_universe(2, 6) + f""", r AS (SELECT DISTINCT {sql_pcr('mer', 2, 6)} AS mer FROM u),
w AS (SELECT mer, array_to_string({sql_digits('mer', 2, 6)}, '') AS word FROM r),
d AS (SELECT w.word, i FROM w, range(1, 7) t(i) WHERE {SQL_LYNDON.format(w='word[1:i]')} AND word[1:(6 // i) * i] = repeat(word[1:i], 6 // i)),
m AS (SELECT word, min(i) AS root FROM d GROUP BY word),
t AS (SELECT word[(6 // root) * root + 1:6] || word[1:(6 // root) * root] AS turned FROM m)
SELECT CAST(list_sum(list_transform(range(6), lambda i: CAST(turned[i + 1] AS BIGINT) * CAST(2 ** (5 - i) AS BIGINT))) AS BIGINT) AS mer FROM t"""


@query(SQL_CHAMPARNAUD)
def champarnaud_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word for each register, from the register's least word."""
    least = A2K6.universe(spark).where(F.col("mer") == A2K6.pcr("mer"))
    return least.select(words.champarnaud_of(A2K6, "mer").alias("mer"))


@query(SQL_CHAMPARNAUD)
def champarnaud_brute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same set as a predicate over the universe."""
    return sets.generate(spark, A2K6, sets.in_champarnaud(A2K6, "mer"))


def sql_syncmer(m: str, a: int, k: int, s: int) -> str:
    parts = f"list_transform(range({k - s + 1}), lambda i: CAST(({m} // CAST({a} ** ({k - s} - i) AS BIGINT)) % {a**s} AS BIGINT))"
    return f"list_position({parts}, list_min({parts})) - 1"


@query("WITH " + sql_universe(4, 4) + f" SELECT mer, CAST({sql_syncmer('mer', 4, 4, 1)} AS BIGINT) AS t FROM u WHERE {sql_syncmer('mer', 4, 4, 1)} IN (0, 1, 2)")
def syncmer_set_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sets.min_smer_position(A4K4, "mer", 1).cast("bigint")
    return A4K4.universe(spark).select("mer", t.alias("t")).where("t IN (0, 1, 2)")


@query("WITH " + sql_universe(4, 4) + f", o AS (SELECT mer, list_transform(range(3), lambda i: CAST((((mer // CAST(4 ** (2 - i) AS BIGINT)) % 16) * 7 + 3) % 16 AS BIGINT)) AS r FROM u) SELECT mer, CAST(list_position(r, list_min(r)) - 1 AS BIGINT) AS t FROM o")
def syncmer_set_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmers under a permuted order of s-mers."""
    small = KmerSpace(4, 2)
    t = sets.min_smer_position(A4K4, "mer", 2, lambda x: small.affine_permutation(x, 7, 3)).cast("bigint")
    return A4K4.universe(spark).select("mer", t.alias("t"))


@query("WITH " + sql_universe(4, 4) + " SELECT mer FROM u ORDER BY (mer * 77 + 19) % 256 LIMIT 70")
def frac_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.fraction_set(spark, A4K4, order=A4K4.affine_permutation("mer", 77, 19))


@query()
def frac_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.generate(spark, A4K4, sets.in_fraction(A4K4, "mer", 0.25, 42))


@query("WITH " + sql_universe(4, 4) + f", s AS (SELECT mer FROM u WHERE {sql_mykkeltveit('mer', 4, 4)}), g AS (SELECT {sql_pcr('mer', 4, 4)} AS pcr, count(*) AS n FROM s GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS size, count(*) AS registers, count(*) = 70 AND max(n) = 1 AS one_per_register FROM g")
def set_is_one_per_pcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.one_per_register(A4K4, mykkeltveit_set(spark, sf_dir))


@query("WITH " + sql_universe(4, 4) + f", s AS (SELECT mer, {sql_rc('mer', 4, 4)} AS rc FROM u WHERE {sql_mykkeltveit('mer', 4, 4)}) SELECT CAST(sum(CASE WHEN mer = rc THEN 1 WHEN mer < rc THEN 2 ELSE 0 END) AS BIGINT) AS canonicalized_size FROM s")
def canonicalize_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.canonicalized_size(A4K4, mykkeltveit_set(spark, sf_dir))


@query("WITH " + sql_universe(4, 4) + f", s AS (SELECT mer, {sql_rc('mer', 4, 4)} AS rc FROM u WHERE {sql_mykkeltveit('mer', 4, 4)}), a AS (SELECT mer FROM s UNION SELECT rc FROM s) SELECT count(*) AS union_size FROM a")
def union_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_size(A4K4, mykkeltveit_set(spark, sf_dir))


@query()
def mykkeltveit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.all_mykkeltveit(spark, A2K6, offsets=(1, 4))


@query()
def mykkeltveit_path_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of all choices with the shortest and the longest remaining path."""
    every = sets.all_mykkeltveit(spark, A2K6).select(F.xxhash64(F.to_json("mers")).alias("set_id"), "mers")
    paths = graph.longest_path(A2K6, moves.as_rows(every)).join(every, "set_id")
    return paths.agg(F.min("longest").alias("least"), F.min_by("mers", F.struct("longest", "mers")).alias("least_set"), F.max("longest").alias("most"), F.max_by("mers", F.struct("longest", "mers")).alias("most_set"))


# 4. sequences ------------------------------------------------------------------------------------

SQL_SEQ = "SELECT doc_id, source, lang, regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM documents"


def sql_kmers(k: int = 4) -> str:
    power = " + ".join(f"(strpos('acgt', substr(seq, CAST(i AS BIGINT) + {j + 1}, 1)) - 1) * {4 ** (k - 1 - j)}" for j in range(k))
    return f"q AS ({SQL_SEQ}), k AS (SELECT doc_id, source, lang, CAST(i AS BIGINT) AS pos, CAST({power} AS BIGINT) AS mer FROM (SELECT *, unnest(range(greatest(length(seq) - {k - 1}, 0))) AS i FROM q))"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are; small files are dealt to all cores."""
    return scan.dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", "source", "lang", sketch.symbols("text", "acgt", lower=True).alias("digits"))


@query("WITH " + sql_kmers() + " SELECT doc_id, count(*) AS n_kmers, CAST(sum(mer) AS BIGINT) AS total, min(mer) AS least, max(mer) AS most FROM k GROUP BY doc_id")
def kmers_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.word_totals(texts(spark, sf_dir), A4K4, "doc_id").drop("n_stretches")


@query("WITH " + sql_kmers() + f" SELECT least(mer, {sql_rc('mer', 4, 4)}) AS canonical, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, canonical LIMIT 20")
def kmer_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = scan.word_counts(texts(spark, sf_dir), A4K4, canonical=True).withColumnRenamed("mer", "canonical")
    return counts.orderBy(F.desc("n"), "canonical").limit(20)


def hits_under(spark: SparkSession, space: KmerSpace, predicate, mode: str = "straight") -> scan.Hits:
    """Hits by a table of all words of a small space, so that the predicate is computed once for each word and not at each position."""
    return scan.table_hits(space, scan.flags(spark, space, sets.under_mode(space, predicate, mode)))


def _hits(spark: SparkSession, mode: str) -> scan.Hits:
    return hits_under(spark, A4K4, lambda m: sets.in_mykkeltveit(A4K4, m), mode)


def sql_gaps(mode: str) -> str:
    inside = sql_mykkeltveit("mer", 4, 4)
    rc = sql_rc("mer", 4, 4)
    member = {
        "straight": "EXISTS_M(mer)", "canonical": "EXISTS_M(least(mer, rc))",
        "union": "EXISTS_M(mer) OR EXISTS_M(rc)", "union_histo": "EXISTS_M(mer) OR EXISTS_M(least(mer, rc))",
    }[mode]
    member = re.sub(r"EXISTS_M\((least\(mer, rc\)|mer|rc)\)", r"(\1 IN (SELECT mer FROM s))", member)
    return (
        "WITH " + sql_universe(4, 4) + f", s AS (SELECT mer FROM u WHERE {inside}), t AS (SELECT mer FROM (SELECT mer, {rc} AS rc FROM u) WHERE {member}), "
        + sql_kmers() + ", h AS (SELECT doc_id, source, lang, pos FROM k WHERE mer IN (SELECT mer FROM t)), "
        + "g AS (SELECT doc_id, source, lang, pos - lag(pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM h)"
    )


def _hist(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan.gap_counts(texts(spark, sf_dir), _hits(spark, mode))

    run.__name__ = f"sketch_hist_{mode}"
    return run


for _mode in sets.MODES:
    query(sql_gaps(_mode) + " SELECT gap, count(*) AS n FROM g GROUP BY gap")(_hist(_mode))


@query(sql_gaps("canonical") + " SELECT gap, count(*) AS n FROM g GROUP BY gap")
def gap_histogram_mykkeltveit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: gaps between canonical 4-mers in the Mykkeltveit set."""
    return scan.gap_counts(texts(spark, sf_dir), _hits(spark, "canonical"))


@query(sql_gaps("straight") + " SELECT doc_id, gap, count(*) AS n FROM g GROUP BY doc_id, gap")
def sketch_hist_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.gap_counts(texts(spark, sf_dir), _hits(spark, "straight"), "doc_id")


@query(sql_gaps("straight") + ", c AS (SELECT doc_id, count(*) AS n_hits FROM h GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS n_kmers FROM k GROUP BY doc_id) SELECT q.doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(n_kmers, 0) AS n_kmers, CAST(coalesce(n_hits, 0) AS DOUBLE) / n_kmers AS density FROM q LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)")
def density_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.density(scan.text_hits(texts(spark, sf_dir), _hits(spark, "straight"), "doc_id"), "doc_id")


@query(sql_gaps("straight") + " SELECT doc_id, CAST(sum(CASE WHEN gap >= 5 THEN gap ELSE 0 END) AS BIGINT) AS weighted_sum FROM g GROUP BY doc_id")
def weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.weighted_sum(sketch_hist_per_doc(spark, sf_dir), "doc_id", least=5)


@query(sql_gaps("straight") + " SELECT source, CAST(sum(CASE WHEN gap >= 20 THEN gap ELSE 0 END) AS BIGINT) AS unmappable FROM g GROUP BY source")
def unmappable_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.unmappable(scan.gap_counts(texts(spark, sf_dir), _hits(spark, "straight"), "source"), "source", threshold=20)


@query("WITH " + sql_kmers() + f", h AS (SELECT doc_id, pos FROM k WHERE {sql_syncmer('mer', 4, 4, 2)} = 1), g AS (SELECT pos - lag(pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM h) SELECT gap, count(*) AS n FROM g GROUP BY gap")
def syncmer_sketch_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.gap_counts(texts(spark, sf_dir), hits_under(spark, A4K4, lambda m: sets.in_syncmer(A4K4, m, 2, 1)))


SQL_TURNS = "SELECT conv_id AS doc_id, '' AS source, '' AS lang, regexp_replace(lower(string_agg(coalesce(text, ''), '' ORDER BY turn)), '[^acgt]', '', 'g') AS seq FROM conversations GROUP BY conv_id"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a stream of chunks."""
    schema = table(spark, sf_dir, "conversations").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*").select("conv_id", "turn", "text")


@query(sql_gaps("canonical").replace(SQL_SEQ, SQL_TURNS) + " SELECT gap, count(*) AS n FROM g GROUP BY gap")
def stream_sketch_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of canonical 4-mers over streamed conversations, whose turns are the chunks of a sequence."""
    chosen = sets.under_mode(A4K4, lambda m: sets.in_mykkeltveit(A4K4, m), "canonical")
    gaps = stream.stream_gaps(_turns(spark, sf_dir), A4K4, chosen, key="conv_id", order="turn")
    return stream.stream_histogram(stream.drained(gaps, "stream-gaps"))


@query(("WITH " + sql_kmers() + f", h AS (SELECT doc_id, pos FROM k WHERE {sql_syncmer('mer', 4, 4, 2)} = 1), g AS (SELECT pos - lag(pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM h) SELECT gap, count(*) AS n FROM g GROUP BY gap").replace(SQL_SEQ, SQL_TURNS))
def stream_syncmer_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = stream.stream_syncmer_gaps(_turns(spark, sf_dir), A4K4, 2, 1, key="conv_id", order="turn")
    return stream.stream_histogram(stream.drained(gaps, "stream-gaps"))


@query(sql_gaps("straight") + ", d AS (SELECT source, lang, doc_id, CAST(count(*) AS DOUBLE) AS hits FROM h GROUP BY ALL) SELECT source, lang, round(avg(hits), 6) AS mean, round(coalesce(stddev_samp(hits), 0), 6) AS stdev, min(hits) AS min, max(hits) AS max FROM d GROUP BY source, lang")
def stats_by_dataset_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.text_hits(texts(spark, sf_dir), _hits(spark, "straight"), "source", "lang").where("n_hits > 0").select("source", "lang", F.col("n_hits").cast("double").alias("hits"))
    out = sketch.describe(rows, "source", "lang", value="hits")
    return out.withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS BIGINT) AS d FROM events),
t AS (SELECT a.user_id, a.d * 25 + b.d * 5 + c.d AS mer FROM e a JOIN e b ON a.user_id = b.user_id AND b.i = a.i + 1 JOIN e c ON a.user_id = c.user_id AND c.i = a.i + 2)
SELECT mer, count(*) AS n FROM t GROUP BY mer
""")
def event_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-mers over the five event types of each user in time order."""
    space = KmerSpace(5, 3)
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.array_position(kinds, F.col("event_type")) - 1).alias("d"))
    return scan.ordered_word_counts(rows, space, "user_id", ["ts", "event_id"], "d")


@query("WITH s AS (SELECT l_orderkey, l_linenumber, CAST(strpos('ANR', l_returnflag) - 1 AS BIGINT) AS d FROM lineitem), k AS (SELECT d * 9 + lead(d, 1) OVER w * 3 + lead(d, 2) OVER w AS mer FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, d)), c AS (SELECT mer FROM k WHERE mer IS NOT NULL) SELECT least(mer, " + sql_rc("mer", 3, 3) + ") AS canonical, count(*) AS n FROM c GROUP BY 1")
def returnflag_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical 3-mers over the return flags of each order: an alphabet of three letters."""
    space = KmerSpace(3, 3)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1).alias("d"))
    counts = scan.ordered_word_counts(rows, space, "l_orderkey", ["l_linenumber", "d"], "d")
    return counts.groupBy(space.canonical("mer").alias("canonical")).agg(F.sum("n").alias("n"))


# 5. moves ----------------------------------------------------------------------------------------


def as_set(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(0).cast("bigint").alias("set_id"), "mer")


def myk(spark: SparkSession, space: KmerSpace) -> DataFrame:
    return as_set(sets.generate(spark, space, sets.in_mykkeltveit(space, "mer")))


def champ(spark: SparkSession, space: KmerSpace) -> DataFrame:
    return as_set(sets.generate(spark, space, sets.in_champarnaud(space, "mer")))


def sql_myk_set(a: int, k: int) -> str:
    return "WITH " + sql_universe(a, k) + f", s AS (SELECT mer FROM u WHERE {sql_mykkeltveit('mer', a, k)})"


@query(sql_myk_set(4, 3) + " SELECT CAST(0 AS BIGINT) AS set_id, mer % 16 AS fm FROM s GROUP BY mer % 16 HAVING count(*) = 4")
def possible_fmoves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.possible_fmoves(A4K3, myk(spark, A4K3))


@query(sql_myk_set(2, 6) + " SELECT CAST(0 AS BIGINT) AS set_id, mer // 2 AS fm FROM s GROUP BY mer // 2 HAVING count(*) = 2")
def possible_rfmoves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.possible_rfmoves(A2K6, myk(spark, A2K6))


SQL_FM = sql_myk_set(2, 6) + ", f AS (SELECT mer % 32 AS fm FROM s GROUP BY mer % 32 HAVING count(*) = 2)"


@query(SQL_FM + " SELECT f.fm, n.mer FROM f, LATERAL (SELECT mer FROM s WHERE mer % 32 <> f.fm UNION SELECT f.fm * 2 + range FROM range(2)) n(mer)")
def apply_fmove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set after each possible F-move."""
    arrays = moves.as_arrays(myk(spark, A2K6)).select("mers", F.explode(moves.fmoves_of(A2K6, "mers")).alias("fm"))
    return arrays.select("fm", F.explode(moves.fmove(A2K6, "mers", "fm")).alias("mer"))


@query(sql_myk_set(2, 6) + ", f AS (SELECT mer // 2 AS fm FROM s GROUP BY mer // 2 HAVING count(*) = 2) SELECT f.fm, n.mer FROM f, LATERAL (SELECT mer FROM s WHERE mer // 2 <> f.fm UNION SELECT f.fm + 32 * range FROM range(2)) n(mer)")
def apply_rfmove(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = moves.as_arrays(myk(spark, A2K6)).select("mers", F.explode(moves.rfmoves_of(A2K6, "mers")).alias("fm"))
    return arrays.select("fm", F.explode(moves.rfmove(A2K6, "mers", "fm")).alias("mer"))


@query(sql_myk_set(2, 6) + """, l AS (SELECT mer % 32 AS fm, 1 AS l, 0 AS r FROM s UNION ALL SELECT mer // 2, 0, 1 FROM s),
n AS (SELECT fm, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right FROM l GROUP BY fm)
SELECT fm, n_left, n_right, CASE WHEN n_left = 2 THEN 'F' WHEN n_right = 2 THEN 'RF' WHEN n_left + n_right = 2 + (CASE WHEN fm IN (0, 31) THEN 1 ELSE 0 END) THEN 'I' ELSE 'none' END AS kind FROM n""")
def classify_fmoves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.classify_fmoves(A2K6, myk(spark, A2K6)).drop("set_id")


@query(sql_myk_set(2, 6) + ", f AS (SELECT CAST(range AS BIGINT) AS fm FROM range(32)), h AS (SELECT mer % 32 AS fm, count(*) AS n, sum(CAST(1 AS BIGINT) << CAST(mer // 32 AS BIGINT)) AS mask FROM s GROUP BY 1) SELECT f.fm, CASE WHEN n = 2 THEN 'complete' WHEN n = 1 THEN 'incomplete' ELSE 'no' END AS kind, CAST(coalesce(mask, 0) AS BIGINT) AS mask FROM f LEFT JOIN h USING (fm)")
def fmove_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete each F-move is in the set, and the bits of its left companions there."""
    rows = myk(spark, A2K6)
    return moves.completeness(A2K6, rows).join(moves.as_arrays(rows), "set_id").select("fm", "kind", moves.companion_mask(A2K6, "mers", "fm").cast("bigint").alias("mask"))


@query(sql_myk_set(2, 6) + ", t AS (SELECT list_sort(list(mer)) AS mers FROM s), r AS (SELECT mer, (mer % 32) * 2 + mer // 32 AS next, mer // 2 + (mer % 2) * 32 AS prev FROM s) SELECT mer, array_to_string(list_sort(list_distinct(list_append(list_filter(mers, lambda x: x <> mer), next))), ',') AS forth, array_to_string(list_sort(list_distinct(list_append(list_filter(mers, lambda x: x <> mer), prev))), ',') AS back FROM r, t")
def moved_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set with each of its words gone on, and gone back, by one place on its register."""
    from ..sources.text import set_line

    arrays = moves.as_arrays(myk(spark, A2K6)).select("mers", F.explode("mers").alias("mer"))
    return arrays.select("mer", set_line(moves.moved_word(A2K6, "mers", "mer")).alias("forth"), set_line(moves.moved_word(A2K6, "mers", "mer", back=True)).alias("back"))


@query("""
WITH m(pos, fm) AS (VALUES (0, 3), (1, 6), (2, 5), (3, 3), (4, 0)),
t AS (SELECT pos, fm + 8 * range AS mer, 0 AS state FROM m, range(2) UNION ALL SELECT pos, fm * 2 + range, 1 FROM m, range(2)),
l AS (SELECT mer, arg_max(state, pos * 2 + state) AS state FROM t GROUP BY mer)
SELECT CAST(mer AS BIGINT) AS mer FROM l WHERE state = 1
""")
def fmoves_to_mds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list of F-moves leaves, without a replay."""
    lists = spark.createDataFrame([(0, p, f) for p, f in enumerate((3, 6, 5, 3, 0))], "list_id long, pos int, fm long")
    return moves.fmoves_to_set(A2K4, lists).select("mer")


@query("WITH RECURSIVE " + sql_myk_set(4, 3)[5:] + """,
o(done, mers, ready) AS (
  SELECT CAST([] AS BIGINT[]), z.taken, list_filter(range(16), lambda f: list_has_all(z.taken, [f, f + 16, f + 32, f + 48])) FROM (SELECT list(mer) AS taken FROM s) z
  UNION ALL
  SELECT n.did, n.now, list_filter(range(16), lambda f: NOT list_contains(n.did, f) AND list_has_all(n.now, [f, f + 16, f + 32, f + 48]))
  FROM (
    SELECT list_concat(o.done, o.ready) AS did, list_distinct(list_concat(list_filter(o.mers, lambda m: NOT list_contains(o.ready, m % 16)), flatten(list_transform(o.ready, lambda f: [f * 4, f * 4 + 1, f * 4 + 2, f * 4 + 3])))) AS now
    FROM o WHERE len(o.ready) > 0
  ) n
)
SELECT CAST(0 AS BIGINT) AS set_id, array_to_string(done, ',') AS fmoves FROM o WHERE len(ready) = 0""")
def fmove_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = moves.fmove_order(A4K3, moves.as_arrays(myk(spark, A4K3)))
    return order.select("set_id", F.array_join(F.transform("fmoves", lambda f: f.cast("string")), ",").alias("fmoves"))


@query(SQL_FM + ", n AS (SELECT f.fm, list_sort(list(DISTINCT x.mer)) AS dst FROM f, LATERAL (SELECT mer FROM s WHERE mer % 32 <> f.fm UNION SELECT f.fm * 2 + range FROM range(2)) x(mer) GROUP BY f.fm) SELECT array_to_string((SELECT list_sort(list(mer)) FROM s), ',') AS src, array_to_string(dst, ',') AS dst, fm FROM n")
def fmove_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import set_line

    e = moves.fmove_edges(A2K6, moves.as_arrays(myk(spark, A2K6)))
    return e.select(set_line("src").alias("src"), set_line("dst").alias("dst"), "fm")


# 6. graph ----------------------------------------------------------------------------------------

SQL_E = sql_myk_set(2, 6) + ", e AS (SELECT a.mer AS src, CAST((a.mer * 2 + b.range) % 64 AS BIGINT) AS dst FROM u a, range(2) b), f AS (SELECT * FROM e WHERE src NOT IN (SELECT mer FROM s) AND dst NOT IN (SELECT mer FROM s))"


@query(SQL_E + " SELECT src, dst FROM f")
def graph_minus_set_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_outside(A2K6, myk(spark, A2K6).select("mer")).select("src", "dst")


@query(SQL_E.replace("WITH ", "WITH RECURSIVE ", 1) + ", r AS (SELECT src AS start, dst AS node FROM f UNION SELECT r.start, f.dst FROM r JOIN f ON r.node = f.src) SELECT start, node FROM r")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph.edges_outside(A2K6, myk(spark, A2K6).select("mer"))
    return graph.reachable(links, links.select(F.col("src").alias("start")).distinct())


def sql_scc(mode: str) -> str:
    rc = sql_rc("mer", 2, 6)
    taken = {"straight": "SELECT mer FROM s", "canonical": f"SELECT mer FROM (SELECT mer, least(mer, {rc}) AS c FROM u) WHERE c IN (SELECT mer FROM s)", "union": f"SELECT mer FROM s UNION SELECT {rc} FROM s"}[mode]
    return (
        sql_myk_set(2, 6).replace("WITH ", "WITH RECURSIVE ", 1) + f", t AS ({taken}), e AS (SELECT a.mer AS src, CAST((a.mer * 2 + b.range) % 64 AS BIGINT) AS dst FROM u a, range(2) b), "
        "f AS (SELECT * FROM e WHERE src NOT IN (SELECT mer FROM t) AND dst NOT IN (SELECT mer FROM t)), "
        "r AS (SELECT src, dst FROM f UNION SELECT r.src, f.dst FROM r JOIN f ON r.dst = f.src), "
        "c AS (SELECT a.src AS mer, min(a.dst) AS scc FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) "
        "SELECT count(DISTINCT scc) AS n_scc, count(*) AS n_nodes FROM c"
    )


def _scc(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.scc_counts(A2K6, myk(spark, A2K6), mode=mode).select("n_scc", "n_nodes")

    run.__name__ = f"scc_counts_{mode}"
    return run


for _mode in ("straight", "canonical", "union"):
    query(sql_scc(_mode))(_scc(_mode))

SQL_LONGEST = SQL_E.replace("WITH ", "WITH RECURSIVE ", 1) + ", p AS (SELECT mer, CAST(1 AS BIGINT) AS n FROM u WHERE mer NOT IN (SELECT mer FROM s) UNION SELECT f.dst, p.n + 1 FROM p JOIN f ON p.mer = f.src WHERE p.n < 64)"


@query(SQL_LONGEST + " SELECT max(n) AS longest FROM p")
def longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_path(A2K6, myk(spark, A2K6)).select("longest")


@query(SQL_E.replace("WITH ", "WITH RECURSIVE ", 1) + """, h AS (SELECT mer % 32 AS fm FROM s GROUP BY 1 HAVING count(*) = 2),
p AS (SELECT DISTINCT fm * 2 + range AS node, 1 AS n FROM h, range(2) UNION SELECT e.dst, n + 1 FROM p JOIN e ON p.node = e.src WHERE e.dst NOT IN (SELECT mer FROM s) AND n < 64),
t AS (SELECT src FROM e GROUP BY src HAVING bool_and(dst IN (SELECT mer FROM s)))
SELECT CAST(0 AS BIGINT) AS set_id, CAST(min(n) AS BIGINT) AS shortest FROM p WHERE node IN (SELECT src FROM t)""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(A2K6, myk(spark, A2K6))


@query(SQL_LONGEST + " SELECT max(n) < 64 AS decycling FROM p")
def is_decycling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.is_decycling(A2K6, myk(spark, A2K6)).select("decycling")


# 7. components -----------------------------------------------------------------------------------


@query("WITH RECURSIVE " + sql_universe(2, 4) + f""", g AS (SELECT {sql_pcr('mer', 2, 4)} AS pcr, list(mer) AS words FROM u GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY pcr) AS i, words FROM g),
c(i, mers) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT n.i, list_append(c.mers, w.mer) FROM c JOIN n ON n.i = c.i + 1, LATERAL (SELECT unnest(n.words) AS mer) w),
d AS (SELECT list_sort(mers) AS mers FROM c WHERE i = (SELECT max(i) FROM n)),
r(mers, src, dst) AS (
  SELECT mers, u.mer, CAST((u.mer * 2 + b.range) % 16 AS BIGINT) FROM d, u, range(2) b WHERE NOT list_contains(mers, u.mer) AND NOT list_contains(mers, CAST((u.mer * 2 + b.range) % 16 AS BIGINT))
  UNION
  SELECT mers, src, CAST((dst * 2 + b.range) % 16 AS BIGINT) FROM r, range(2) b WHERE NOT list_contains(mers, CAST((dst * 2 + b.range) % 16 AS BIGINT))
)
SELECT array_to_string(mers, ',') AS mers FROM d WHERE mers NOT IN (SELECT mers FROM r WHERE src = dst)""")
def exhaustive_mds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import set_line

    return components.exhaustive(spark, A2K4).select(set_line("mers").alias("mers"))


def _layers(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return components.layers(A2K4, moves.as_arrays(myk(spark, A2K4)))


SQL_LAYERS = "WITH RECURSIVE " + sql_myk_set(2, 4)[5:] + """, f AS (SELECT CAST(range AS BIGINT) AS fm FROM range(8)),
z(mers) AS (
  SELECT list_sort(list(mer)) FROM s
  UNION
  SELECT list_sort(list_distinct(list_concat(list_filter(t.mers, lambda m: m // 2 <> t.fm), [t.fm, t.fm + 8])))
  FROM (
    SELECT a.mers, f.fm FROM (
      SELECT list_sort(list_distinct(list_concat(list_filter(z.mers, lambda m: m % 8 <> f.fm), [2 * f.fm, 2 * f.fm + 1]))) AS mers
      FROM z, f WHERE list_has_all(z.mers, [f.fm, f.fm + 8])
    ) a, f WHERE list_has_all(a.mers, [2 * f.fm, 2 * f.fm + 1])
  ) t
),
l(layer, mers) AS (
  SELECT CAST(0 AS BIGINT), mers FROM z
  UNION
  SELECT l.layer + 1, list_sort(list_distinct(list_concat(list_filter(l.mers, lambda m: m % 8 <> f.fm), [2 * f.fm, 2 * f.fm + 1])))
  FROM l, f WHERE l.layer < 7 AND list_has_all(l.mers, [f.fm, f.fm + 8])
),
d AS (SELECT DISTINCT f.fm, l.layer FROM l, f WHERE list_has_all(l.mers, [f.fm, f.fm + 8])),
i AS (SELECT fm, layer, layer - row_number() OVER (PARTITION BY fm ORDER BY layer) AS island FROM d),
r AS (SELECT fm, min(layer) AS first, max(layer) AS last FROM i GROUP BY fm, island)
"""


@query(SQL_LAYERS + " SELECT layer, array_to_string(mers, ',') AS mers FROM l")
def fmove_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import set_line

    return _layers(spark)[0].select(F.col("layer").cast("bigint").alias("layer"), set_line("mers").alias("mers"))


@query(SQL_LAYERS + " SELECT layer, count(*) AS width FROM l GROUP BY layer")
def layer_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark)[0].groupBy(F.col("layer").cast("bigint").alias("layer")).agg(F.count("*").alias("width"))


@query(SQL_LAYERS + " SELECT fm, first, last FROM r")
def fmove_layer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.fmove_ranges(_layers(spark)[1]).select("fm", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


@query(SQL_LAYERS + ", w AS (SELECT layer, count(*) AS width FROM l GROUP BY layer) SELECT count(*) AS n_layers, CAST(sum(width) AS BIGINT) AS n_sets, min(width) AS least_width, max(width) AS most_width, (SELECT min(last - first + 1) FROM r) AS shortest_range, (SELECT max(last - first + 1) FROM r) AS longest_range FROM w")
def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.layer_report(*_layers(spark))


SQL_IMOVES = sql_myk_set(2, 4).replace("WITH ", "WITH RECURSIVE ", 1) + """, forth AS (SELECT mer AS s, mer AS u FROM s UNION SELECT f.s, (f.u % 8) * 2 + b.range FROM forth f, range(2) b WHERE (f.u % 8) * 2 + b.range NOT IN (SELECT mer FROM s)),
back AS (SELECT mer AS s, mer AS v FROM s UNION SELECT f.s, f.v // 2 + 8 * b.range FROM back f, range(2) b WHERE f.v // 2 + 8 * b.range NOT IN (SELECT mer FROM s)),
e AS (SELECT DISTINCT a.u % 8 AS fm, a.u // 8 AS i, z.v % 2 AS j FROM forth a JOIN back z ON z.s = a.s AND z.v // 2 = a.u % 8 WHERE a.u // 8 <> z.v % 2)
SELECT CAST(f.range AS BIGINT) AS fm, CAST(m.range AS INT) AS mask FROM range(8) f, range(1, 3) m
WHERE f.range NOT IN (0, 7) AND NOT EXISTS (SELECT 1 FROM e WHERE e.fm = f.range AND (m.range >> CAST(e.i AS INT)) & 1 = 1 AND (m.range >> CAST(e.j AS INT)) & 1 = 0)"""


@query(SQL_IMOVES)
def imoves_of_mds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.imoves(A2K4, myk(spark, A2K4)).drop("set_id")


@query()
def component_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = components.traverse(A2K4, moves.as_arrays(myk(spark, A2K4)).select("mers"))
    return links


# 8. searches -------------------------------------------------------------------------------------


@query()
def random_mds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.random_decycling_sets(spark, A2K5, 4)


@query()
def opt_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.reduce_under_complement(spark, A2K6, myk(spark, A2K6).select("mer"), 4)


@query()
def optimize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    mers = sorted(r["mer"] for r in champ(spark, A2K5).collect())
    return search.best_of(search.anneal_path(spark, A2K5, mers, 4, iterations=50))


@query()
def sketch_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets by modes over the documents in one scan: density, unmappable length and SCC counts of each."""
    chosen = {
        "mykkeltveit": lambda m: sets.in_mykkeltveit(A4K3, m), "champarnaud": lambda m: sets.in_champarnaud(A4K3, m),
        "syncmer_0": lambda m: sets.in_syncmer(A4K3, m, 1, 0), "syncmer_1": lambda m: sets.in_syncmer(A4K3, m, 1, 1),
        "fraction": lambda m: sets.in_fraction(A4K3, m, 0.33333, 1),
    }
    kinds = [(name, mode) for name in chosen for mode in ("straight", "canonical", "union")]
    taken = [sets.under_mode(A4K3, chosen[name], mode)(F.col("mer")) for name, mode in kinds]
    of_mer = {r["mer"]: r["held"] for r in A4K3.universe(spark).select("mer", F.array(*taken).alias("held")).collect()}  # 64 rows, whatever the data
    held = [F.array(*[F.lit(bool(of_mer[m][i])) for m in range(A4K3.size)]) for i in range(len(kinds))]

    def one(words, i: int):
        def counts(hits):
            far = F.aggregate(sketch.gaps(hits), F.lit(0).cast("bigint"), lambda a, g: a + F.when(g >= 20, g).otherwise(0))
            return F.struct(F.lit(i).alias("kind"), F.size(hits).cast("bigint").alias("n_hits"), F.size(words).cast("bigint").alias("n_kmers"), far.alias("unmappable"))

        return sketch.bound(sketch.hit_offsets(words, lambda m: F.get(held[i], m.cast("int"))), counts)

    found = sketch.bound(sketch.kmers("digits", A4K3), lambda words: F.array(*[one(words, i) for i in range(len(kinds))]))
    rows = sequences(spark, sf_dir).select(F.explode(found).alias("x")).select("x.*").groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n_hits", "n_kmers", "unmappable")])
    named = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "kind int, sketch string, mode string")
    straight = spark.createDataFrame([(name, m) for i, (name, mode) in enumerate(kinds) if mode == "straight" for m in range(A4K3.size) if of_mer[m][i]], "set_id string, mer long")
    sccs = None
    for mode in ("straight", "canonical", "union"):
        part = graph.scc_counts(A4K3, straight, mode=mode).select(F.col("set_id").alias("sketch"), F.lit(mode).alias("mode"), "n_scc", "n_nodes")
        sccs = part if sccs is None else sccs.union(part)
    density = F.when(F.col("n_kmers") > 0, F.col("n_hits") / F.col("n_kmers")).alias("density")
    return rows.join(named, "kind").join(sccs, ["sketch", "mode"]).select("sketch", "mode", "n_hits", "n_kmers", density, "unmappable", "n_scc", "n_nodes")
