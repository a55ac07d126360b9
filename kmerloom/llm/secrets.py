"""Secret scans by trigrams (DataFrame functions only).

Every rule's regular expression is turned into a Boolean query over trigrams
that any match must contain. ``trigram_postings`` is the inverted index: (trigram, key of a text) for every asked trigram.
``scan_indexed`` intersects the postings of each way to meet a rule's query, and verifies the texts that are left with the
regular expression; a rule without mandatory trigrams scans every text. ``scan_secrets`` decides the same queries inside each
row, which shuffles nothing and suits a stage that reads every text once; both give the same spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

try:  # the parser of the standard library, under either of its names
    from re import _constants as sre_c
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre_c
    import sre_parse


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern`` (Java syntax) whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN = r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
#: The three base rules, then those that this operator adds; spans are joined in this order.
BASE_RULES = (
    SecretRule("assign", ASSIGN + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18),
    SecretRule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs of under 16 fail, so the longer ones alone are the same spans
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

#: A Boolean query in disjunctive form: some set of trigrams must be there in full. None: no condition.
Query = frozenset[frozenset[str]] | None


def trigram_query(pattern: str, most: int = 64) -> Query:
    """Trigrams, lower-cased, that every match of ``pattern`` contains, as a disjunction of sets.

    Literal runs are followed through groups, alternatives and classes of up to 8 letters (in one case);
    anything else ends a run. None if nothing is mandatory.
    """
    runs = _runs(sre_parse.parse(pattern), most)
    sets = {frozenset(g for run in way for part in [run] for g in _grams(part)) for way in runs}
    if not sets or any(not s for s in sets):
        return None
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _grams(run: str) -> set[str]:
    return {run[i : i + 3] for i in range(len(run) - 2)}


def _runs(items, most: int) -> list[tuple[str, ...]]:
    """Ways to match, each a tuple of literal runs; the last run of a way is still open."""
    ways: list[tuple[str, ...]] = [("",)]

    def close(ways):
        return [(*w, "") for w in ways]

    for op, arg in items:
        if op is sre_c.LITERAL:
            ways = [(*w[:-1], w[-1] + chr(arg).lower()) for w in ways]
        elif op is sre_c.IN and all(o is sre_c.LITERAL for o, _ in arg) and len(letters := {chr(a).lower() for _, a in arg}) <= 8:
            joined = [(*w[:-1], w[-1] + x) for w in ways for x in sorted(letters)]
            ways = joined if len(joined) <= most else close(ways)
        elif op in (sre_c.SUBPATTERN, sre_c.BRANCH):
            branches = arg[1] if op is sre_c.BRANCH else [arg[-1]]
            inner = [x for b in branches for x in _runs(b, most)]
            joined = [(*w[:-1], w[-1] + x[0], *x[1:]) for w in ways for x in inner]
            ways = joined if len(joined) <= most else close(ways)
        elif op in (sre_c.MAX_REPEAT, sre_c.MIN_REPEAT):
            low, high, body = arg
            if (low, high) == (0, 1):
                inner = [("",), *_runs(body, most)]
                joined = [(*w[:-1], w[-1] + x[0], *x[1:]) for w in ways for x in inner]
                ways = joined if len(joined) <= most and all(len(x) == 1 for x in inner) else close(ways)
            elif low >= 1:
                inner = _runs(body, most)
                ways = close([(*w[:-1], w[-1] + x[0], *x[1:]) for w in ways for x in inner] if len(ways) * len(inner) <= most else ways)
            else:
                ways = close(ways)
        else:
            ways = close(ways)
    return ways


def held_trigrams(text: Column, trigrams: Sequence[str]) -> Column:
    """Postings of one text: the numbers of ``trigrams`` that it holds, in either case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _let(low, lambda x: F.array_compact(F.array(*(F.when(F.contains(x, F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams))).cast("array<int>")))


def asked_trigrams(rules: Sequence[SecretRule]) -> list[str]:
    """All trigrams that the queries of ``rules`` ask for."""
    queries = [trigram_query(r.pattern) for r in rules]
    return sorted({g for q in queries if q is not None for s in q for g in s})


def text_key(text: Column) -> Column:
    """SHA-256 of a text; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def trigram_postings(docs: DataFrame, rules: Sequence[SecretRule] = RULES, *, text: str = "text") -> DataFrame:
    """The inverted index of ``docs``: distinct (trigram, text_key) for every trigram that ``rules`` ask for.

    Copies of a text share its postings, and each task merges its own before they are shuffled, so no text is frequent here. Texts
    that hold none of the trigrams (null and empty ones too) have no row. One index serves any rules that ask for no other trigrams.
    """
    asked = asked_trigrams(rules)
    names = F.array(*map(F.lit, asked)).cast("array<string>")
    held = docs.select(text_key(F.col(text)).alias("text_key"), held_trigrams(F.col(text), asked).alias("held"))
    rows = held.select(F.explode_outer("held").alias("n"), "text_key").where("n IS NOT NULL")  # the outer form reads each text once
    return rows.select(F.element_at(names, F.col("n") + 1).alias("trigram"), "text_key").distinct()


def index_candidates(postings: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """(text_key, kinds): the texts in all postings of some way to meet a rule's query, by intersecting them.

    Rules without mandatory trigrams have no candidates here: they scan every text.
    """
    ways = [(r.kind, sorted(s)) for r in rules for s in sorted(trigram_query(r.pattern) or (), key=sorted)]
    rows = [F.struct(F.lit(g).alias("trigram"), F.lit(i).alias("way"), F.lit(len(s)).alias("needed"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(ways) for g in s]
    plan = F.array(*rows).cast("array<struct<trigram:string,way:int,needed:int,kind:string>>")
    asked = postings.sparkSession.range(1).select(F.inline(plan))
    held = postings.join(F.broadcast(asked), "trigram")  # its size is that of the rules
    met = held.groupBy("text_key", "way", "needed", "kind").agg(F.count("*").alias("n")).where("n = needed")
    return met.groupBy("text_key").agg(F.collect_set("kind").alias("kinds"))  # as many as there are rules at most


def candidate_rules(text: Column, rules: Sequence[SecretRule]) -> Column:
    """Kinds of the ``rules`` that the intersected postings of a text let match; rules without mandatory trigrams always."""
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({g for q in asked.values() if q is not None for s in q for g in s})
    number = {g: i for i, g in enumerate(trigrams)}

    def fits(held: Column, query: Query) -> Column:
        ways = [reduce(Column.__and__, [F.array_contains(held, number[g]) for g in sorted(s)]) for s in sorted(query, key=sorted)]
        return reduce(Column.__or__, ways)

    def kinds(held: Column) -> Column:
        every = [F.lit(k) if q is None else F.when(fits(held, q), F.lit(k)) for k, q in asked.items()]
        return F.array_compact(F.array(*every))

    return _let(held_trigrams(text, trigrams), kinds) if trigrams else F.array(*map(F.lit, asked)).cast("array<string>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, how: Callable[[Column, Column], Column], zero: int, block: int = 256) -> Column:
    """Running totals of an array of integers under an associative ``how``, block by block so that time stays all but linear."""

    def within(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(how(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero)), x))))

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / block).cast("int")), lambda i: within(F.slice(xs, (i * block + 1).cast("int"), block)))
        return _let(blocks, joined)

    def joined(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(zero)), within(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, start: F.transform(b, lambda x: how(start, x))))

    return _let(values, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(F.array().cast("array<int>")))


SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def rule_spans(text: Column, rule: SecretRule, order: int) -> Column:
    """Spans of one rule in code points: array of (start, rank, end, kind).

    Texts between matches and the matches themselves alternate, so running sums of their lengths
    are the offsets.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    sizes, gaps, values = (F.transform(x, lambda v: F.length(v)) for x in (matches, F.split(text, rule.pattern, -1), values))
    parts = F.struct(sizes.alias("sizes"), gaps.alias("gaps"), values.alias("values"))

    def spans(p: Column) -> Column:
        ends = running(F.zip_with(p["sizes"], F.slice(p["gaps"], F.lit(1), F.size(p["sizes"])), lambda a, b: a + b), lambda a, b: a + b, 0)
        each = F.arrays_zip(ends.alias("end"), p["sizes"].alias("size"), p["values"].alias("value"))
        long = F.filter(each, lambda x: x["value"] >= rule.least)
        return F.transform(long, lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(order).alias("rank"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return F.when(F.regexp_like(text, F.lit(rule.pattern)), _let(parts, spans)).otherwise(F.array()).cast(f"array<{SPAN}>")


def _found(body: Column, kinds: Column, rules: Sequence[SecretRule]) -> Column:
    """Spans of the rules whose kind is among ``kinds``, by start, then order of rules."""
    empty = F.array().cast(f"array<{SPAN}>")
    each = (F.when(F.array_contains(kinds, r.kind), rule_spans(body, r, i)).otherwise(empty) for i, r in enumerate(rules))
    return F.array_sort(F.concat(empty, *each))


def scan_secrets(docs: DataFrame, rules: Sequence[SecretRule] = RULES, *, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs`` with the column ``out``: array of (start, rank, end, kind), by start, then order of rules.

    A null text is empty and has no spans; a text of any length is scanned whole. Rows are scanned each for itself, so repeated rows have
    equal spans, and no id is needed. An empty table stays empty. Other columns stay as they are; one named ``out`` is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = _let(candidate_rules(body, rules), lambda kinds: _found(body, kinds, rules))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != out), found.alias(out))


def scan_indexed(
    docs: DataFrame, rules: Sequence[SecretRule] = RULES, *, postings: DataFrame | None = None, text: str = "text", out: str = "secret_spans"
) -> DataFrame:
    """The rows of ``scan_secrets`` through the inverted index: ``postings`` (built here if not given) are intersected, and candidates verified.

    Texts meet their candidate kinds by a join on ``text_key``, where a key has one candidate row at most; a text with very
    many copies makes one key of ``docs`` frequent, which adaptive execution splits, since the other side is a row.
    Nulls, empty and long texts, repeated rows, empty tables and other columns are treated as by ``scan_secrets``.
    """
    key, may = fresh(docs, "text_key"), fresh(docs, "kinds")
    postings = trigram_postings(docs, rules, text=text) if postings is None else postings
    candidates = index_candidates(postings, rules).withColumnsRenamed({"text_key": key, "kinds": may})
    whole = F.array(*(F.lit(r.kind) for r in rules if trigram_query(r.pattern) is None)).cast("array<string>")
    kinds = F.concat(F.coalesce(F.col(may), F.array().cast("array<string>")), whole)
    rows = docs.withColumn(key, text_key(F.col(text))).join(candidates, key, "left")
    found = _let(kinds, lambda k: _found(F.coalesce(F.col(text), F.lit("")), k, rules))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c != out), found.alias(out))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, spans: str, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the column ``spans`` replaced by ``mark`` (overlaps once); null texts stay null."""

    def cut(s: Column) -> Column:
        letters = F.split(F.col(text), "")
        reach = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), 0)
        shape = F.struct(letters.alias("letters"), F.arrays_zip(s.alias("span"), F.concat(F.array(F.lit(0)), reach).alias("before")).alias("each"))
        return _let(shape, pieces)

    def pieces(p: Column) -> Column:
        def one(x: Column) -> Column:
            start = F.coalesce(x["span"]["start"], F.size(p["letters"]))
            gap = F.array_join(F.slice(p["letters"], x["before"] + 1, F.greatest(start - x["before"], F.lit(0))), "")
            return F.when(x["span"].isNull(), gap).when(start >= x["before"], F.concat(gap, F.lit(mark))).otherwise("")

        return F.array_join(F.transform(p["each"], one), "")

    return docs.withColumn(text, F.when(F.size(spans) > 0, _let(F.col(spans), cut)).otherwise(F.col(text)))
