"""URL filters by a Bloom filter cascade (DataFrame functions only).

Level 1 encodes the listed keys; each further level encodes the keys of the
other kind that the level before wrongly passes, over the complete universe of
keys the corpus can ask for. Asked for a key of that universe, the cascade is
exact, and a lookup is a few bit tests on a scalar, not a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``host`` and its subdomains below the ``path`` prefix."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: One level: a one-row table of 64-bit words, the number of bits and of hash functions.
@dataclass(frozen=True)
class Level:
    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()
        tests = []
        for i in range(self.hashes):
            at = _position(key, self.bits, self.seed, i)
            word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
            tests.append(word.bitwiseAND(_bit(at)) != 0)
        return reduce(Column.__and__, tests)


def _position(key: Column, bits: int, seed: int, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits).cast("bigint"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))


def bloom_level(keys: DataFrame, n: int, bits_per_key: int, hashes: int, seed: int) -> Level:
    """A Bloom filter over the column ``key``: positions are OR-ed into words by an aggregation."""
    spark = keys.sparkSession
    n_words = max(1, -(-n * bits_per_key // 64))
    bits = n_words * 64
    at = F.explode(F.array(*[_position(F.col("key"), bits, seed, i) for i in range(hashes)])).alias("at")
    words = (
        keys.select(at)
        .groupBy(F.floor(F.col("at") / 64).alias("i"))
        .agg(F.bit_or(_bit(F.col("at"))).alias("w"))
        .join(spark.range(n_words).withColumnRenamed("id", "i"), "i", "right")
        .agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0)).alias("w")))).alias("pairs"))
        .select(F.transform("pairs", lambda p: p["w"]).alias("words"))
    )
    return Level(written(words, "bloom-level"), bits, hashes, seed)


@dataclass(frozen=True)
class BloomCascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether ``key`` is listed; exact for keys of the universe, false for null."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            passed = self.levels[depth].passes(key)
            verdict = F.when(passed, verdict).otherwise(F.lit(depth % 2 == 1))
        return F.when(key.isNull(), F.lit(False)).otherwise(verdict)


class LevelTooLarge(ValueError):
    """A level of a cascade that must not be sent whole."""


def build_cascade(
    listed: DataFrame,
    universe: DataFrame,
    *,
    bits_per_key: int = 12,
    hashes: int = 4,
    max_level_bytes: int = 64 << 20,
) -> BloomCascade:
    """Cascade that tells ``listed`` (column ``key``) from the rest of ``universe`` (column ``key``).

    ``universe`` may hold repeats and is scanned once: only keys that level 1 passes wrongly go on; every 16 levels the bits a key are doubled, so
    that it ends. A level is sent to the tasks as a scalar, so its size is checked against ``max_level_bytes``; ``members`` takes lists of
    any size. Nulls are no keys. An empty list gives a cascade that contains nothing.
    """
    ours = listed.select("key").where("key IS NOT NULL").distinct()
    levels: list[Level] = []
    encode, test = ours, universe.select("key").where("key IS NOT NULL")
    while True:
        n, bits = encode.count(), bits_per_key << len(levels) // 16
        if levels and n == 0:
            return BloomCascade(tuple(levels))
        if n * bits // 8 > max_level_bytes:
            raise LevelTooLarge(f"a level of {n} keys exceeds max_level_bytes; members() goes range by range")
        level = bloom_level(encode, n, bits, hashes, seed=len(levels) + 1)
        levels.append(level)
        wrong = test.where(level.passes(F.col("key")))
        if len(levels) == 1:
            wrong = wrong.distinct().join(ours, "key", "left_anti")
        encode, test = written(wrong, "bloom-wrong"), encode


def members(listed: DataFrame, universe: DataFrame, *, bits_per_key: int = 12, hashes: int = 4, max_level_bytes: int = 64 << 20, depth: int = 0) -> DataFrame:
    """(key): the distinct keys of ``universe`` that are ``listed``, for lists of any size.

    Keys are told apart by ranges of a hash, so many that a range's first level fits ``max_level_bytes`` twice over; each range has its own cascade, which is
    sent, used and done with before the next. Both tables are dealt to the ranges once. A range of which a later level does not fit (a universe
    far larger than the list) is divided again. Nulls are no keys.
    """
    ours, every = (written(x.select("key").where("key IS NOT NULL").distinct(), "bloom-keys") for x in (listed, universe))
    ranges = max(1 + (depth > 0), -(-2 * ours.count() * bits_per_key // (8 * max_level_bytes)))
    part = F.pmod(F.xxhash64("key", F.lit(-1 - depth)), F.lit(ranges))
    if ranges > 1:
        whole, (ours, every) = (ours, every), (written(x.withColumn("range", part).repartition("range"), "bloom-keys") for x in (ours, every))
        dropped(*whole)
    found = []
    for r in range(ranges):
        own, asked = (x.where(F.col("range") == r).select("key") if ranges > 1 else x for x in (ours, every))
        try:
            cascade = build_cascade(own, asked, bits_per_key=bits_per_key, hashes=hashes, max_level_bytes=max_level_bytes)
        except LevelTooLarge:
            found.append(members(own, asked, bits_per_key=bits_per_key, hashes=hashes, max_level_bytes=max_level_bytes, depth=depth + 1))
            continue
        found.append(written(asked.where(cascade.contains(F.col("key"))), "bloom-members"))
        dropped(*(level.words for level in cascade.levels))
    dropped(ours, every)
    return reduce(DataFrame.union, found)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def candidate_keys(host: Column, path: Column, rules: Sequence[Rule]) -> list[tuple[Column, Column, Column]]:
    """Every key that could be a rule fitting this URL: host suffixes by path prefixes.

    Only suffixes of as many labels, and prefixes as long, as some rule has are made, so the count
    per URL is bounded by the rules, not by the URL. Each is (size, host size, key); the key is null
    where the URL has no such part.
    """
    labels = F.split(host, r"\.", -1)
    keys = []
    for n in sorted({r.host.count(".") + 1 for r in rules}):
        suffix = F.substring_index(host, ".", -n)
        for length in sorted({len(r.path) for r in rules if r.host.count(".") + 1 == n}):
            fits = (F.size(labels) >= n) & (F.length(path) >= length)
            key = F.when(fits, F.concat(suffix, F.substring(path, 1, length)))
            keys.append((F.length(suffix) + length, F.length(suffix), key))
    return keys


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow", **cascade) -> DataFrame:
    """``pages`` with host, path, rule and verdict; other columns stay unless they bear these names.

    The rule is the longest one that fits (by characters of host and path, then of the host); where
    none fits, no key of the URL is listed and the verdict is ``default``. Repeated rows are judged
    alike, an empty table gives an empty result. A null or empty url has an empty host and path; urls of any length are judged whole.
    """
    if not rules:
        raise ValueError("no rules")
    spark: SparkSession = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(url))
    at = pages.select(*kept, host.alias("host"), path.alias("path"))
    candidates = candidate_keys(F.col("host"), F.col("path"), rules)
    keyed = at.select(F.explode(F.array(*[key for _, _, key in candidates])).alias("key"))
    lists = [spark.createDataFrame([(r.key,) for r in rules if r.verdict in kinds] or [(None,)], "key string")
             for kinds in (("allow", "block"), ("block",))]
    known, blocked = (build_cascade(listed, keyed, **cascade) for listed in lists)
    fits = [
        F.when(known.contains(key), F.struct(size.alias("size"), host_size.alias("host_size"), key.alias("key")))
        for size, host_size, key in candidates
    ]
    judged = at.select(*kept, "host", "path", F.array_max(F.array(*fits))["key"].alias("rule"))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), "block").otherwise("allow")
    return judged.withColumn("verdict", verdict)
