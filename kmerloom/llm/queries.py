"""The registered queries of the training-data operators, and SQL where SQL can express them.

Each query applies its operator, with production parameters, to its whole table and derives the
digest columns from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, centroids, decontaminate, flac, language, mixing, near_dups, packing, passages, secrets, substrings, toxicity, url_filter
from .common import table

URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hex_sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("removed_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed_spans").cast("bigint").alias("n_spans"),
        hex_sha256(F.col("kept")).alias("kept_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))
    crc = F.crc32("token_ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def fold(column: str, parts: int) -> Column:
    """crc32 of a number's text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % parts


PIECES = "piece_bpe_32k.model"


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = language.train(docs.where(~held_out), tokenizer_path(PIECES))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = flac.decode(flac.encode(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"), "media"))
    points = flac.seek_points(F.col("pcm"), F.col("block"))
    last = flac.block_at(F.col("pcm"), F.col("block"), F.element_at(points, -1))
    return read.select(
        "doc_id",
        F.col("n_bytes").cast("bigint").alias("n_bytes"),
        F.octet_length("pcm").cast("bigint").alias("payload_bytes"),
        hex_sha256(F.col("pcm")).alias("payload_sha256"),
        F.crc32(F.substring(last, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        hex_sha256(F.col("media")).alias("media_sha256"),
        F.col("features").alias("feature"),
        F.size(points).alias("n_blocks"),
    )


def op5_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_indexed(docs)
    base = F.filter("secret_spans", lambda s: s["rank"] < len(secrets.BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(r.kind) for r in secrets.BASE_RULES),
        hex_sha256(secrets.joined_spans(base)).alias("base_sha256"),
        secrets.joined_spans(F.col("secret_spans")).alias("spans"),
    )


def op6_sql(rules: tuple[secrets.SecretRule, ...] = secrets.RULES) -> str:
    """Matches and the texts between them alternate; running sums of their lengths are the offsets."""
    kinds = []
    for rank, r in enumerate(rules):
        p = "'" + r.pattern.replace("'", "''") + "'"
        kinds.append(f"""
  SELECT row, {rank} AS rank, '{r.kind}' AS kind, upto - size AS start, upto FROM (
    SELECT row, size, value, CAST(sum(gap + size) OVER (PARTITION BY row ORDER BY place) AS BIGINT) AS upto FROM (
      SELECT row, unnest(range(1, len(m) + 1)) AS place, length(unnest(m)) AS size, length(unnest(v)) AS value, length(unnest(g[1:len(m)])) AS gap FROM (
        SELECT row, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {r.group}) AS v, regexp_split_to_array(text, {p}) AS g
        FROM d WHERE regexp_matches(text, {p})))
  ) WHERE value >= {r.least}""")
    base = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    told = "kind || ':' || start || ':' || upto, ',' ORDER BY start, rank"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL".join(kinds)}
), c AS (
  SELECT row, {base}, string_agg({told}) FILTER (rank < {len(secrets.BASE_RULES)}) AS base, string_agg({told}) AS spans FROM s GROUP BY row
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (row)
"""


TOXIC_AT = 0.7


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Trained on the rows outside the held-out third."""
    return toxicity.train(docs, labels.where(fold("doc_id", 3) != 1))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC_AT).cast("int").alias("predicted"),
        "toxic_passages",
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        hex_sha256(F.array_join("hit_items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _sql_words(table_: str, key: str) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table_}"


OP9_SQL = f"""
WITH d AS MATERIALIZED ({_sql_words('documents', 'row_number() OVER () AS row, doc_id')}),
b AS ({_sql_words('benchmark', 'CAST(item_id AS VARCHAR) AS item_id')} WHERE item_id IS NOT NULL),
i AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[place:place + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS place FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM i),
v AS (SELECT row, n, place, array_to_string(w[place:place + n - 1], ' ') AS g FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS place FROM d, sizes WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT v.row, v.place, v.n, i.item_id FROM v JOIN i ON i.n = v.n AND i.g = v.g),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT row, unnest(range(place, place + n)) AS p FROM h) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, item_id FROM h) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, '.' || host AS dotted FROM parts
), found AS (
  SELECT page_id, host, path,
         CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/'
              WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         END AS rule
  FROM ruled
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM found
"""


BYTE_TOKENIZER = "byte_bpe_50k.json"


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(hex_sha256(F.col("groups")))
    found = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECES), keep={"groups_sha256": digest})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


MIX_WEIGHTS, MIX_SHARE, MIX_MOST = (5.0, 2.0, 1.0), 1.5, 2


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, MIX_WEIGHTS, share=MIX_SHARE, most=MIX_MOST).select(
        "doc_id",
        F.col("mix_words").alias("size"),
        F.col("mix_source_words").alias("source_size"),
        F.round("mix_target", 6).alias("target"),
        (F.col("mix_copies") * F.col("mix_words")).cast("bigint").alias("taken"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, count(*) FILTER (size > 0) AS documents,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, coalesce(sum(2.0 * words) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open,
         1.5 * sum(words) OVER () AS total, row_number() OVER (ORDER BY words / weight, source NULLS LAST) AS place
  FROM s WINDOW w AS (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT min_by((total - capped) / open, place) FILTER (2.0 * words >= (total - capped) / open * weight) AS level FROM o
), t AS (
  SELECT source, words, words::DOUBLE / nullif(documents, 0) AS mean, least(2.0 * words, coalesce(level, 1e300) * weight)::DOUBLE AS target FROM s, l
), e AS (
  SELECT d.source, d.size, ln(u + k) / (size / mean) AS event
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) c(k) WHERE size > 0
), g AS (
  SELECT source, event, CAST(sum(size) AS BIGINT) AS own FROM e GROUP BY source, event
), c AS (
  SELECT g.*, sum(own) OVER (PARTITION BY source ORDER BY event) AS upto FROM g
), x AS (
  SELECT c.source, min(event) AS cut, min_by(upto - own, event) AS below, min_by(own, event) AS own, any_value(target) AS target
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE upto >= target AND target < 2.0 * words GROUP BY c.source
)
SELECT d.doc_id, d.size, t.words AS source_size, round(t.target, 6) AS target,
       CAST(CASE WHEN d.size = 0 THEN 0 WHEN x.cut IS NULL THEN 2 * d.size
            ELSE d.size * (SELECT count(*) FILTER (ln(u + k) / (d.size / mean) < cut OR (ln(u + k) / (d.size / mean) = cut AND below + own - x.target <= x.target - below))
                           FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) c(k)) END AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centers = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = hex_sha256(F.array_join(F.col("centroid").cast("array<string>"), ",")).alias("centroid_sha256")
    return found.join(F.broadcast(centers), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def op13_sql(rounds: int = 10, k: int = 8) -> str:
    squared = "CAST(list_sum(list_transform(list_zip(p.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    out = f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY name, v) - 1 AS j, v AS c FROM (SELECT sha256('3:' || vec_id) AS name, v FROM p ORDER BY name, v LIMIT {k})
)"""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'j': j}}) AS b FROM (SELECT p.row, p.vec_id, p.v, c.j, {squared} AS d FROM p, c{i} c) GROUP BY row
)"""
        if i < rounds:
            out += f""", c{i + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT j, list(CAST(floor_mean AS BIGINT) ORDER BY place) AS c FROM (
      SELECT b.j AS j, place, CAST(sum(v[place]) AS HUGEINT) AS s, count(*) AS n, (s - ((s % n) + n) % n) // n AS floor_mean FROM a{i}, range(1, 65) r(place) GROUP BY b.j, place
    ) GROUP BY j
  ) m ON m.j = c.j
)"""
    return out + f"""
SELECT vec_id, CAST(b.j AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.j = b.j
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_packing": op2_packing,
        "op3_language": op3_language,
        "op4_media": op4_media,
        "op5_near_passages": op5_near_passages,
        "op6_secret_scan": op6_secret_scan,
        "op7_toxicity": op7_toxicity,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_decontamination": op9_decontamination,
        "op10_url_filter": op10_url_filter,
        "op11_alignment": op11_alignment,
        "op12_mixing": op12_mixing,
        "op13_clusters": op13_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_secret_scan": op6_sql(), "op9_decontamination": OP9_SQL, "op10_url_filter": OP10_SQL, "op12_mixing": OP12_SQL, "op13_clusters": op13_sql()}
