"""The algebra of words, sets and moves on words that occur in the driver tables.

Many sets at once come from the data: each source of documents takes, from every register, the word that is most frequent in its texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kspace, words
from ..functions.kspace import KmerSpace
from ..operators import graph, moves, scan, sets
from ..shared import written
from .queries import A4K3, A4K4, SQL_LYNDON, query, sql_digits, sql_embedding, sql_kmers, sql_mykkeltveit, sql_number, sql_pcr, sql_rc, sql_syncmer, sql_universe, table, texts

# 1. words -------------------------------------------------------------------------------------------

SQL_WORDS = "WITH " + sql_kmers() + f", o AS (SELECT mer, count(*) AS n FROM k GROUP BY mer), w AS (SELECT mer, n, {sql_digits('mer', 4, 4)} AS d, array_to_string({sql_digits('mer', 4, 4)}, '') AS word FROM o)"


def _sql_of(*digits: str) -> str:
    return sql_number("[" + ", ".join(digits) + "]", 4)


@query(
    SQL_WORDS + f""" SELECT mer, n, d[1] AS left_base, d[4] AS right_base, d[2] AS second, {_sql_of('d[2]', 'd[3]', 'd[4]', 'd[1]')} AS next, {_sql_of('d[4]', 'd[1]', 'd[2]', 'd[3]')} AS prev,
    {_sql_of('d[2]', 'd[3]', 'd[4]', '2')} AS successor, {_sql_of('2', 'd[1]', 'd[2]', 'd[3]')} AS predecessor, {_sql_of('d[2]', 'd[3]', 'd[4]')} AS fmove, {_sql_of('d[1]', 'd[2]', 'd[3]')} AS rfmove,
    {_sql_of('1', 'd[2]', 'd[3]', 'd[4]')} AS left_companion, {_sql_of('d[1]', 'd[2]', 'd[3]', '1')} AS right_companion, d[4] = 2 OR d[2:4] = [1, 1, 1] OR d[1:3] = [1, 1, 1] AS near_c, len(list_distinct(d)) = 1 AS homopolymer,
    len(list_distinct(d[2:4])) = 1 AS homopolymer_fmove, CAST(list_sum(d) AS BIGINT) AS weight, {sql_rc('mer', 4, 4)} AS rc, least(mer, {sql_rc('mer', 4, 4)}) AS canonical, {_sql_of('d[2]', 'd[3]')} AS middle,
    word, translate(translate(word, '0123', 'ACGT'), 'ATCG', 'TAGC') AS complement, {_sql_of('3 - d[4]', '3 - d[3]', '3 - d[2]', '3 - d[1]')} - 64 * 0 AS rc_again FROM w"""
)
def observed_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits, rotations, neighbours, companions, weight, complements and texts of the 4-mers of documents."""
    s, m = A4K4, F.col("mer")
    rows = scan.word_counts(texts(spark, sf_dir), s)
    cccc = s.homopolymer(1)
    near = (s.right_base("mer") == 2) | s.are_left_companions("mer", cccc) | s.are_right_companions("mer", cccc)
    first = s.reverse_complement(s.successor(s.rotate_prev("mer"), 0))
    return rows.select(
        "mer", "n", s.left_base("mer").alias("left_base"), s.right_base("mer").alias("right_base"), s.digit("mer", 1).alias("second"), s.rotate_next("mer").alias("next"), s.rotate_prev("mer").alias("prev"),
        s.successor("mer", 2).alias("successor"), s.predecessor("mer", 2).alias("predecessor"), s.suffix("mer").alias("fmove"), s.prefix("mer").alias("rfmove"), s.left_companion("mer", 1).alias("left_companion"),
        s.right_companion("mer", 1).alias("right_companion"), near.alias("near_c"), s.is_homopolymer("mer").alias("homopolymer"), s.is_homopolymer_fmove(s.suffix("mer")).alias("homopolymer_fmove"),
        s.weight("mer").alias("weight"), s.reverse_complement("mer").alias("rc"), s.canonical("mer").alias("canonical"), s.subword("mer", 1, 2).alias("middle"), s.text("mer").alias("word"),
        kspace.transposition(F.translate(s.text("mer"), "0123", "ACGT"), "AT", "CG").alias("complement"), s.successor_rc(first, s.right_base("mer")).alias("rc_again"),
    ).where(m.isNotNull())


@query(
    SQL_WORDS + f""", x AS (SELECT mer, n, word, {sql_pcr('mer', 4, 4)} AS pcr, {SQL_LYNDON.format(w='word')} AS lyndon,
      list_filter(range(1, 4), lambda i: substr(word, i + 1) < list_min(list_transform(range(i), lambda j: substr(word, j + 1)))) AS starts,
      list_filter(range(1, 5), lambda i: {SQL_LYNDON.format(w='word[1:i]')} AND word[1:(4 // i) * i] = repeat(word[1:i], CAST(4 // i AS INT)))[1] AS root,
      list_filter(range(1, 5), lambda s: substr(word, 4 % s + 1) = repeat(substr(word, 4 % s + 1, s), CAST(4 // s AS INT)))[1] AS inner_root FROM w)
    SELECT mer, pcr, mer = pcr AS least, lyndon, lyndon AS lyndon_by_prefixes, array_to_string(list_append(starts, 4), ',') AS factor_ends, CAST(root AS BIGINT) AS root, CAST(4 // root * root AS BIGINT) AS power,
      CASE WHEN root IS NOT NULL THEN word[4 // root * root + 1:4] || word[1:4 // root * root] END AS turned, CAST(4 % inner_root AS BIGINT) AS rest, CAST(inner_root AS BIGINT) AS inner_root FROM x"""
)
def observed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers, Lyndon words and factors, and divisions of the 4-mers of documents."""
    s = A4K4
    rows = scan.word_counts(texts(spark, sf_dir), s).select("mer", s.text("mer").alias("word"))
    main, inner = words.main_division("word", 4), words.inverse_division("word", 4)
    return rows.select(
        "mer", s.pcr("mer").alias("pcr"), (F.col("mer") == s.pcr("mer")).alias("least"), words.is_lyndon("word").alias("lyndon"), words.is_lyndon_by_prefixes("word").alias("lyndon_by_prefixes"),
        F.array_join(F.transform(words.lyndon_factors("word"), lambda x: x.cast("string")), ",").alias("factor_ends"), main["root"].cast("bigint").alias("root"), main["power"].cast("bigint").alias("power"),
        words.division_reversed("word", 4).alias("turned"), inner["rest"].cast("bigint").alias("rest"), inner["root"].cast("bigint").alias("inner_root"),
    )


@query(
    SQL_WORDS + f""", x AS (SELECT mer, n, {sql_pcr('mer', 4, 4)} AS pcr, {sql_embedding('mer', 4, 4)[0]} AS re, {sql_embedding('mer', 4, 4)[1]} AS im, {sql_mykkeltveit('mer', 4, 4)} AS mykkeltveit,
      list_transform(range(3), lambda i: CAST((((mer // CAST(4 ** (2 - i) AS BIGINT)) % 16) * 7 + 3) % 16 AS BIGINT)) AS r FROM w),
    p AS (SELECT DISTINCT pcr, array_to_string({sql_digits('pcr', 4, 4)}, '') AS word FROM x),
    y AS (SELECT pcr, word, list_filter(range(1, 5), lambda i: {SQL_LYNDON.format(w='word[1:i]')} AND word[1:(4 // i) * i] = repeat(word[1:i], CAST(4 // i AS INT)))[1] AS root FROM p),
    c AS (SELECT pcr, word[4 // root * root + 1:4] || word[1:4 // root * root] AS turned FROM y)
    SELECT mer, round(CAST(re AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS re, round(CAST(im AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS im, mykkeltveit, array_to_string({sql_digits('mer', 4, 4)}, '') = turned AS champarnaud, CAST({sql_syncmer('mer', 4, 4, 1)} AS BIGINT) AS lexical,
      CAST(list_position(r, list_min(r)) - 1 AS BIGINT) AS permuted, row_number() OVER (ORDER BY (mer * 77 + 19) % 256) <= 70 AS among_70 FROM x JOIN c USING (pcr)"""
)
def observed_set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which 4-mers of documents the generated sets take: by embedding, by division, by least s-mers, and an exact number of them in a permuted order."""
    from ..operators import select

    s, small = A4K4, KmerSpace(4, 2)
    rows = written(scan.word_counts(texts(spark, sf_dir), s).select("mer", s.affine_permutation("mer", 77, 19).alias("rank")), "observed")
    among = select.smallest(rows, 70, value="rank", tie="mer", bits=8, tail=16).select("mer", F.lit(True).alias("among"))
    re, im = s.embedding("mer")
    return rows.join(among, "mer", "left").select(
        "mer", (F.round(re, 6) + 0.0).alias("re"), (F.round(im, 6) + 0.0).alias("im"), sets.in_mykkeltveit(s, "mer").alias("mykkeltveit"), sets.in_champarnaud(s, "mer").alias("champarnaud"),
        sets.min_smer_position(s, "mer", 1).cast("bigint").alias("lexical"), sets.min_smer_position(s, "mer", 2, lambda x: small.affine_permutation(x, 7, 3)).cast("bigint").alias("permuted"),
        F.coalesce("among", F.lit(False)).alias("among_70"),
    )


@query("WITH " + sql_kmers() + " SELECT mer, count(*) AS n FROM k WHERE (mer * 77 + 19) % 256 < 85 GROUP BY mer")
def observed_words_in_a_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4-mers of documents that a third of all words, in a permuted order, holds."""
    rank = lambda m: A4K4.affine_permutation(m, 77, 19)
    return scan.word_counts(texts(spark, sf_dir), A4K4).where(sets.in_fraction(A4K4, "mer", 1 / 3, 0, order=rank))


# 2. sets of sources ---------------------------------------------------------------------------------

SQL_SETS = "WITH RECURSIVE " + sql_universe(4, 3) + ", " + sql_kmers(3) + f""", c AS (SELECT source, mer, count(*) AS n FROM k GROUP BY ALL),
s AS MATERIALIZED (SELECT set_id, mer FROM (SELECT source AS set_id, mer, row_number() OVER (PARTITION BY source, {sql_pcr('mer', 4, 3)} ORDER BY n DESC, mer) AS place FROM c) WHERE place = 1), i AS (SELECT DISTINCT set_id FROM s)"""


def source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, mer): of each register the 3-mer that is most frequent in the documents of a source."""
    counts = scan.word_counts(texts(spark, sf_dir), A4K3, "source")
    best = counts.groupBy(F.col("source").alias("set_id"), A4K3.pcr("mer").alias("pcr")).agg(F.max_by("mer", F.struct("n", -F.col("mer"))).alias("mer"))
    return written(best.select("set_id", "mer"), "source-sets")


@query(SQL_SETS + ", l AS (SELECT set_id, list_sort(list(mer)) AS mers FROM s GROUP BY set_id) SELECT set_id, array_to_string(mers, ',') AS mers FROM l")
def frequent_word_of_each_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of sources as sorted lines."""
    from ..sources.text import set_line

    return moves.as_arrays(source_sets(spark, sf_dir)).select("set_id", set_line("mers").alias("mers"))


@query(
    SQL_SETS + f""", x AS (SELECT set_id, mer, {sql_rc('mer', 4, 3)} AS rc, {sql_pcr('mer', 4, 3)} AS pcr FROM s), a AS (SELECT set_id, mer FROM x UNION SELECT set_id, rc FROM x), b AS (SELECT set_id, count(*) AS union_size FROM a GROUP BY set_id)
    SELECT set_id, count(*) AS size, count(DISTINCT pcr) AS registers, count(DISTINCT pcr) = 24 AND count(*) = 24 AS one_per_register,
      CAST(sum(CASE WHEN mer = rc THEN 1 WHEN mer < rc THEN 2 ELSE 0 END) AS BIGINT) AS canonicalized_size, any_value(union_size) AS union_size FROM x JOIN b USING (set_id) GROUP BY set_id"""
)
def source_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the sets of sources, whether they hit each register once, and their sizes closed under complement."""
    rows, s = source_sets(spark, sf_dir), A4K3
    rc = s.reverse_complement("mer")
    own = rows.groupBy("set_id").agg(
        F.count("*").alias("size"), F.countDistinct(s.pcr("mer")).alias("registers"),
        F.sum(F.when(F.col("mer") == rc, 1).when(F.col("mer") < rc, 2).otherwise(0)).alias("canonicalized_size"),
    )
    both = rows.union(rows.select("set_id", rc.alias("mer"))).distinct().groupBy("set_id").agg(F.count("*").alias("union_size"))
    want = kspace.necklace_count(4, 3)
    return own.join(both, "set_id").select("set_id", "size", "registers", ((F.col("registers") == want) & (F.col("size") == want)).alias("one_per_register"), "canonicalized_size", "union_size")


@query(
    SQL_SETS + """, l AS (SELECT set_id, mer % 16 AS fm, count(*) AS n, CAST(sum(1 << CAST(mer // 16 AS INT)) AS BIGINT) AS mask FROM s GROUP BY ALL), r AS (SELECT set_id, mer // 4 AS fm, count(*) AS n FROM s GROUP BY ALL),
    f AS (SELECT set_id, CAST(range AS BIGINT) AS fm FROM i, range(16)), x AS (SELECT f.set_id, f.fm, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right, coalesce(l.mask, 0) AS mask, f.fm % 5 = 0 AS same
      FROM f LEFT JOIN l ON l.set_id = f.set_id AND l.fm = f.fm LEFT JOIN r ON r.set_id = f.set_id AND r.fm = f.fm)
    SELECT set_id, fm, n_left, n_right, mask, CASE WHEN n_left = 4 THEN 'complete' WHEN n_left > 0 THEN 'incomplete' ELSE 'no' END AS completeness,
      CASE WHEN n_left = 4 THEN 'F' WHEN n_right = 4 THEN 'RF' WHEN n_left + n_right = 4 + CAST(same AS INT) THEN 'I' ELSE 'none' END AS kind FROM x"""
)
def source_fmoves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every F-move in the sets of sources: companions, their mask, how complete it is, and its class."""
    rows, s = source_sets(spark, sf_dir), A4K3
    kinds = moves.classify_fmoves(s, rows)
    out = moves.completeness(s, rows).withColumnRenamed("kind", "completeness").join(kinds, ["set_id", "fm"], "left").join(moves.as_arrays(rows), "set_id")
    zero = F.lit(0).cast("bigint")
    return out.select("set_id", "fm", F.coalesce("n_left", zero).alias("n_left"), F.coalesce("n_right", zero).alias("n_right"), moves.companion_mask(s, "mers", "fm").cast("bigint").alias("mask"), "completeness", F.coalesce("kind", F.lit("none")).alias("kind"))


SQL_FREQUENT = "WITH " + sql_kmers(3) + """, c AS (SELECT source, mer, count(*) AS n FROM k GROUP BY ALL),
s AS MATERIALIZED (SELECT set_id, mer FROM (SELECT source AS set_id, mer, 8 * n * count(*) OVER (PARTITION BY source) >= sum(n) OVER (PARTITION BY source) AS often FROM c) WHERE often)"""


def frequent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, mer): the 3-mers that occur at least an eighth as often as the average word in the documents of a source."""
    counts = written(scan.word_counts(texts(spark, sf_dir), A4K3, "source"), "source-words")
    whole = counts.groupBy("source").agg(F.count("*").alias("words"), F.sum("n").alias("total"))
    return written(counts.join(whole, "source").where("8 * n * words >= total").select(F.col("source").alias("set_id"), "mer"), "source-sets")


@query(
    SQL_FREQUENT + """, f AS (SELECT set_id, mer % 16 AS fm FROM s GROUP BY ALL HAVING count(*) = 4), r AS (SELECT set_id, mer // 4 AS fm FROM s GROUP BY ALL HAVING count(*) = 4),
    m AS (SELECT 'F' AS kind, f.set_id, f.fm, x.mer FROM f, LATERAL (SELECT mer FROM s WHERE s.set_id = f.set_id AND mer % 16 <> f.fm UNION SELECT f.fm * 4 + range FROM range(4)) x(mer)
      UNION ALL SELECT 'RF', r.set_id, r.fm, x.mer FROM r, LATERAL (SELECT mer FROM s WHERE s.set_id = r.set_id AND mer // 4 <> r.fm UNION SELECT r.fm + 16 * range FROM range(4)) x(mer)),
    l AS (SELECT kind, set_id, fm, list_sort(list(CAST(mer AS BIGINT))) AS mers FROM m GROUP BY ALL) SELECT kind, set_id, CAST(fm AS BIGINT) AS fm, array_to_string(mers, ',') AS mers FROM l"""
)
def source_sets_after_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of sources after each possible F-move and each possible reverse move."""
    from ..sources.text import set_line

    arrays_, s = moves.as_arrays(frequent_sets(spark, sf_dir)), A4K3
    forth = arrays_.select(F.lit("F").alias("kind"), "set_id", "mers", F.explode(moves.fmoves_of(s, "mers")).alias("fm")).select("kind", "set_id", "fm", moves.fmove(s, "mers", "fm").alias("mers"))
    back = arrays_.select(F.lit("RF").alias("kind"), "set_id", "mers", F.explode(moves.rfmoves_of(s, "mers")).alias("fm")).select("kind", "set_id", "fm", moves.rfmove(s, "mers", "fm").alias("mers"))
    return forth.union(back).select("kind", "set_id", "fm", set_line("mers").alias("mers"))


def _sql_source_components() -> str:
    rc = sql_rc("mer", 4, 3)
    return SQL_SETS + f""", t AS (SELECT 'straight' AS mode, set_id, mer FROM s UNION ALL SELECT DISTINCT 'union', set_id, m FROM (SELECT set_id, unnest([mer, {rc}]) AS m FROM s)
      UNION ALL SELECT 'canonical', s.set_id, u.mer FROM s JOIN (SELECT mer, least(mer, {rc}) AS c FROM u) u ON u.c = s.mer),
    n AS (SELECT unnest(['straight', 'canonical', 'union']) AS mode, set_id FROM i), v AS (SELECT n.mode, n.set_id, u.mer FROM n, u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.mode = n.mode AND t.set_id = n.set_id AND t.mer = u.mer)),
    f AS MATERIALIZED (SELECT a.mode, a.set_id, a.mer AS src, b.mer AS dst FROM v a JOIN v b ON a.mode = b.mode AND a.set_id = b.set_id AND b.mer // 4 = a.mer % 16),
    r AS (SELECT mode, set_id, src, dst FROM f UNION SELECT r.mode, r.set_id, r.src, f.dst FROM r JOIN f ON r.mode = f.mode AND r.set_id = f.set_id AND r.dst = f.src),
    x AS (SELECT a.mode, a.set_id, a.src AS mer, min(a.dst) AS scc FROM r a JOIN r b ON a.mode = b.mode AND a.set_id = b.set_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL)
    SELECT n.mode, n.set_id, count(DISTINCT scc) AS n_scc, count(x.mer) AS n_nodes FROM n LEFT JOIN x ON x.mode = n.mode AND x.set_id = n.set_id GROUP BY ALL"""


@query(_sql_source_components())
def source_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components outside the sets of sources, by mode."""
    rows = source_sets(spark, sf_dir)
    parts = [graph.scc_counts(A4K3, rows, mode=m).select(F.lit(m).alias("mode"), "set_id", "n_scc", "n_nodes") for m in ("straight", "canonical", "union")]
    return reduce(DataFrame.union, parts)


@query(
    SQL_SETS + """, v AS (SELECT i.set_id, u.mer FROM i, u WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.set_id = i.set_id AND s.mer = u.mer)), f AS MATERIALIZED (SELECT a.set_id, a.mer AS src, b.mer AS dst FROM v a JOIN v b ON a.set_id = b.set_id AND b.mer // 4 = a.mer % 16),
    p AS (SELECT set_id, mer, CAST(1 AS BIGINT) AS n FROM v UNION SELECT p.set_id, f.dst, p.n + 1 FROM p JOIN f ON f.set_id = p.set_id AND f.src = p.mer WHERE p.n < 64)
    SELECT set_id, max(n) < 64 AS decycling, max(n) AS longest FROM p GROUP BY set_id"""
)
def source_longest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sets of sources leave no cycle, and the longest path outside each."""
    return graph.longest_path(A4K3, source_sets(spark, sf_dir))


SQL_CONSTRAINED = """, forth AS (SELECT set_id, mer AS s, mer AS u FROM s UNION SELECT f.set_id, f.s, (f.u % 16) * 4 + b.range FROM forth f, range(4) b
      WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.set_id = f.set_id AND s.mer = (f.u % 16) * 4 + b.range)),
    back AS (SELECT set_id, mer AS s, mer AS v FROM s UNION SELECT f.set_id, f.s, f.v // 4 + 16 * b.range FROM back f, range(4) b
      WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.set_id = f.set_id AND s.mer = f.v // 4 + 16 * b.range)),
    e AS MATERIALIZED (SELECT DISTINCT a.set_id, a.u % 16 AS fm, a.u // 16 AS i, z.v % 4 AS j FROM forth a JOIN back z ON z.set_id = a.set_id AND z.s = a.s AND z.v // 4 = a.u % 16 WHERE a.u // 16 <> z.v % 4)"""


@query(SQL_SETS + SQL_CONSTRAINED + " SELECT set_id, CAST(fm AS BIGINT) AS fm, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM e")
def source_constrained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between companions that lie on a cycle through exactly one word of a source's set."""
    return moves.constrained_edges(A4K3, source_sets(spark, sf_dir))


@query(
    SQL_SETS + SQL_CONSTRAINED + """ SELECT i.set_id, CAST(f.range AS BIGINT) AS fm, CAST(m.range AS INT) AS mask FROM i, range(16) f, range(1, 15) m
    WHERE NOT (f.range % 5 = 0 AND (m.range = 1 << CAST(f.range % 4 AS INT) OR m.range = 15 - (1 << CAST(f.range % 4 AS INT))))
      AND NOT EXISTS (SELECT 1 FROM e WHERE e.set_id = i.set_id AND e.fm = f.range AND (m.range >> CAST(e.i AS INT)) & 1 = 1 AND (m.range >> CAST(e.j AS INT)) & 1 = 0)"""
)
def source_imoves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed moves of the sets of sources."""
    return moves.imoves(A4K3, source_sets(spark, sf_dir))


@query(
    SQL_FREQUENT.replace("WITH ", "WITH RECURSIVE ", 1) + """, i AS (SELECT DISTINCT set_id FROM s), h AS (SELECT set_id, mer % 16 AS fm FROM s GROUP BY ALL HAVING count(*) = 4),
    p AS (SELECT DISTINCT set_id, fm * 4 + range AS node, 1 AS n FROM h, range(4) UNION SELECT p.set_id, (p.node % 16) * 4 + b.range, n + 1 FROM p, range(4) b WHERE n < 64 AND NOT EXISTS (SELECT 1 FROM s WHERE s.set_id = p.set_id AND s.mer = (p.node % 16) * 4 + b.range)),
    t AS (SELECT set_id, mer // 4 AS fm FROM s GROUP BY ALL HAVING count(*) = 4)
    SELECT i.set_id, CAST(min(n) AS BIGINT) AS shortest FROM i LEFT JOIN (SELECT p.set_id, p.n FROM p JOIN t ON t.set_id = p.set_id AND t.fm = p.node % 16) x ON x.set_id = i.set_id GROUP BY i.set_id"""
)
def source_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the head of a possible F-move to the first word all of whose successors are frequent in the source, breadth first."""
    return graph.shortest_path(A4K3, frequent_sets(spark, sf_dir))


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS BIGINT) AS d FROM events),
m AS (SELECT a.user_id, a.i, a.d * 5 + b.d AS fm FROM e a JOIN e b ON a.user_id = b.user_id AND b.i = a.i + 1),
t AS (SELECT user_id, i, 0 AS state, fm + 25 * range AS mer FROM m, range(5) UNION ALL SELECT user_id, i, 1, fm * 5 + range FROM m, range(5)),
l AS (SELECT user_id, mer, max_by(state, i * 2 + state) AS state FROM t GROUP BY user_id, mer)
SELECT user_id, count(*) AS size, CAST(min(mer) AS BIGINT) AS least, CAST(sum(mer) AS BIGINT) AS total FROM l WHERE state = 1 GROUP BY user_id
""")
def event_moves_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's pairs of events in time order as a list of F-moves over words of three events, replayed from nothing."""
    from pyspark.sql import Window

    kinds = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    digit = F.array_position(kinds, F.col("event_type")) - 1
    rows = table(spark, sf_dir, "events").select("user_id", F.row_number().over(by).alias("pos"), (digit * 5 + F.lead(digit).over(by)).cast("bigint").alias("fm")).where("fm IS NOT NULL")
    found = moves.fmoves_to_set(KmerSpace(5, 3), rows.withColumnRenamed("user_id", "list_id"))
    return found.groupBy(F.col("list_id").alias("user_id")).agg(F.count("*").alias("size"), F.min("mer").alias("least"), F.sum("mer").alias("total"))
