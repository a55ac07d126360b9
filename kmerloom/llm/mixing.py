"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words. Among all document rates that meet it, those that stay closest to one copy of each document (least
relative entropy, ``most`` copies at most) are exponentially tilted: rate = min(most, exp(lambda * x)), with x the words of the document over the mean of
its source. The multipliers are the optimum of a convex dual that has one unknown a source; its Newton steps are aggregations of the
table of (source, size, documents), in which documents of one size are one row, so nothing that grows with a hot source meets in one task.

Rates become copies by one random number u a document, taken from its id: the k-th copy is taken where the rate is over k - 1 + u, that is where lambda is over
ln(k - 1 + u) / x. These thresholds are events on one line; the multiplier is moved to the event where the words taken come nearest to the
target, found by counting events in ever finer bins, so a source misses its target by half an event at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, written

SPACES = " \t\n\x0b\f\r"
#: Bins of one counting pass.
BINS = 1024


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space, counted without listing them."""
    begun = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.octet_length(F.regexp_replace(begun, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")).cast("bigint")


def fraction(doc_id: Column) -> Column:
    """A number between 0 and 1 for each id, from its MD5 digest; a null id has that of an empty text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def source_table(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, number, words, documents, weight): sources by code point, null last, with ``weights`` in turn. One row a source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("documents"))
    order = F.col("source").asc_nulls_last()
    place = F.monotonically_increasing_id()  # of a table in order: tasks one after another, rows inside them
    listed = written(sums.orderBy(order).select("*", F.shiftright(place, 33).alias("task"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")), "sources")
    starts, before = {}, 0
    for task, n in sorted(listed.groupBy("task").count().collect()):  # a row for each task
        starts[task], before = before, before + n
    first = listed.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "task long, first long")
    number = F.col("first") + F.col("inside")
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights)).cast("int"))
    return listed.join(F.broadcast(first), "task").select("source", number.alias("number"), "words", "documents", turn.alias("weight"))


def with_targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """Sources with a ``target``: ``share`` of all words by weight; what is over ``most`` times a source's words goes to the others by weight.

    Each round is one aggregation; a target is min(most * words, level * weight) for the last level.
    """
    cap = F.col("words") * float(most)
    level, capped = 0.0, -1
    total = share * float(sources.agg(F.sum("words")).first()[0] or 0)
    while True:
        over = cap < F.lit(level) * F.col("weight")
        kept, n, weight = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.count_if(over), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not weight:
            break
        level, capped = (total - kept) / weight, n
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if weight else cap)


def newton(groups: DataFrame, sources: DataFrame, most: int, tolerance: float = 1e-6, most_rounds: int = 60) -> DataFrame:
    """(number, lambda): the tilt of each source whose words meet its target, by guarded Newton steps on the dual.

    ``groups`` has (number, size, n, x). Steps that leave the bracket known so far are replaced by its middle. A source whose target
    is none or all of its possible words has no finite tilt and no row.
    """
    inner = (F.col("target") > 0) & (F.col("target") < F.col("words") * float(most))
    start = F.log(F.col("target") / F.col("words"))
    nothing = F.lit(None).cast("double")
    state = written(sources.where(inner).select("number", "target", start.alias("lambda"), nothing.alias("low"), nothing.alias("high"), F.lit(1.0).alias("error")), "tilts")
    for _ in range(most_rounds):
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= tolerance:
            break
        rate = F.exp(F.least(F.col("lambda") * F.col("x"), F.lit(700.0)))
        words = F.col("n") * F.col("size")
        slope = F.when(rate < most, words * F.col("x") * rate).otherwise(0.0)
        sums = groups.join(state, "number").groupBy("number", "target", "lambda", "low", "high").agg(
            (F.sum(words * F.least(rate, F.lit(float(most)))) - F.first("target")).alias("over"), F.sum(slope).alias("slope")
        )
        low, high = F.when(F.col("over") > 0, F.col("low")).otherwise(F.col("lambda")), F.when(F.col("over") > 0, F.col("lambda")).otherwise(F.col("high"))
        wide = 1.0 + F.abs("lambda")
        least, greatest = F.coalesce("low", F.col("lambda") - wide), F.coalesce("high", F.col("lambda") + wide)
        step = F.col("lambda") - F.col("over") / F.when(F.col("slope") > 0, F.col("slope"))
        middle = (least + greatest) / 2
        inside = F.when((step > least) & (step < greatest), step).otherwise(F.when(F.col("low").isNull() | F.col("high").isNull(), F.when(F.col("over") > 0, least).otherwise(greatest)).otherwise(middle))
        moved = sums.withColumn("low", low).withColumn("high", high)
        moved = moved.select("number", "target", "lambda", "low", "high", "over", inside.alias("next"), (F.abs("over") / F.col("target")).alias("error"))
        done = F.col("error") <= tolerance
        before, state = state, written(moved.select("number", "target", F.when(done, F.col("lambda")).otherwise(F.coalesce("next", "lambda")).alias("lambda"), "low", "high", "error"), "tilts")
        dropped(before)
    return state.select("number", "target", "lambda")


def event(k: int) -> Column:
    """The tilt from which on the k-th copy of a document is taken."""
    return F.try_divide(F.log(F.col("u") + float(k - 1)), F.col("x"))


def thresholds(docs: DataFrame, tilts: DataFrame, most: int) -> DataFrame:
    """(number, cut, taken): events up to ``cut`` are taken, ``cut`` itself only if ``taken``, so that the words come nearest to the target.

    ``docs`` has (number, size, u, x). The first pass bins events by their distance from the dual's solution, later ones divide
    the bin where the sum crosses the target, until it holds one value; each pass is an aggregation to a row for each source and bin.
    """
    spark = docs.sparkSession
    none = F.lit(None).cast("double")
    state = written(tilts.select("number", "target", "lambda", none.alias("least"), none.alias("greatest"), F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("own")), "events")
    done = spark.createDataFrame([], "number long, cut double, taken boolean")
    while state.agg(F.count("*")).first()[0]:
        one = docs.where("size > 0").join(state, "number").withColumn("event", F.explode(F.array(*[event(k) for k in range(1, most + 1)])))
        one = one.where(F.col("least").isNull() | F.col("event").between(F.col("least"), F.col("greatest")))
        far = F.col("event") - F.col("lambda")
        first = F.signum(far) * F.greatest(F.lit(1.0), F.least(F.lit(BINS / 2.0), 321.0 + F.floor(8.0 * F.log2(F.abs(far)))))
        later = F.least(F.lit(BINS - 1.0), F.floor(F.try_divide(F.col("event") - F.col("least"), F.col("greatest") - F.col("least")) * BINS))
        bin_ = F.when(F.col("least").isNull(), F.when(far == 0, 0.0).otherwise(first)).otherwise(later)
        bins = one.groupBy("number", "target", "lambda", "below", bin_.alias("bin")).agg(F.sum("size").alias("own"), F.min("event").alias("least"), F.max("event").alias("greatest"))
        upto = F.expr("sum(own) over (partition by number order by bin)")  # some thousand rows a source
        crossing = bins.withColumn("upto", F.col("below") + upto).where(F.col("upto") >= F.col("target"))
        found = crossing.groupBy("number").agg(F.min_by(F.struct("target", "lambda", "least", "greatest", (F.col("upto") - F.col("own")).alias("below"), "own"), "bin").alias("b"))
        before, state = state, written(found.select("number", "b.*"), "events")
        dropped(before)
        nearest = F.col("below") + F.col("own") - F.col("target") <= F.col("target") - F.col("below")
        done = done.unionByName(state.where("least = greatest").select("number", F.col("least").alias("cut"), nearest.alias("taken")))
        ended, state = state, written(state.where("least < greatest"), "events")
        done = written(done, "cuts")
        dropped(ended)
    return done


def mix(
    docs: DataFrame,
    weights: Sequence[float],
    *,
    share: float = 1.5,
    most: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with mix_words, mix_source_words, mix_target, mix_rate and mix_copies; names that a column has already get lines in front.

    The words of a document are its runs of characters other than ASCII white space. Sources, in the order of code points and null last, have
    ``weights`` in turn and share ``share`` times all words, up to ``most`` times their own; ``mix_copies`` (0 to ``most``) is the number of
    times that the mix takes the document. Null texts and texts of white space have no words; they are taken once and change nothing. Rows that
    repeat an id are documents of their own with the same random number, so repeated rows are taken alike. Results do not depend on partitions: a
    rerun agrees. An empty table gives no rows. ``mix_rate`` is the tilted rate at the multiplier used, null in a source whose target is all or none of its possible words.
    """
    if most < 1 or share < 0 or not weights or min(weights) <= 0:
        raise ValueError("weights are positive, most is at least 1 and share at least 0")
    names = {n: fresh(docs, f"mix_{n}") for n in ("words", "source_words", "target", "rate", "copies")}
    own = fresh(docs, "mix_number")
    rows = docs.withColumns({names["words"]: n_words(docs[text])})
    plain = written(rows.select(docs[source].alias("source"), F.col(names["words"]).alias("size"), fraction(docs[doc_id]).alias("u")), "mix-sizes")
    sources = written(with_targets(source_table(plain, weights), share, most), "mix-sources")
    mean = F.try_divide("words", "documents")
    numbered = sources.select(F.col("source").alias("of"), "number", mean.alias("mean"))
    sized = written(plain.join(numbered, F.col("source").eqNullSafe(F.col("of"))).select("number", "size", "u", F.try_divide("size", "mean").alias("x")), "mix-documents")
    dropped(plain)
    groups = written(sized.where("size > 0").groupBy("number", "size", "x").agg(F.count("*").alias("n")), "mix-groups")
    cuts = thresholds(sized, newton(groups, sources, most), most)
    dropped(groups, sized)
    final = sources.join(cuts, "number", "left").select(
        F.col("source").alias(own), F.struct("words", "target", mean.alias("mean"), "cut", "taken").alias(own + "_of")
    )
    at = F.col(own + "_of")
    size = F.col(names["words"])
    joined = rows.withColumn(own + "_u", fraction(F.col(doc_id))).join(final, F.col(source).eqNullSafe(F.col(own)))
    x = F.try_divide(size, at["mean"])
    events = [F.try_divide(F.log(F.col(own + "_u") + float(k)), x) for k in range(most)]
    taken = [(e < at["cut"]) | (e == at["cut"]) & at["taken"] for e in events]
    copies = sum((t.cast("int") for t in taken[1:]), taken[0].cast("int"))
    every = F.when(at["target"] > 0, F.lit(most)).otherwise(0)
    out = {
        names["source_words"]: at["words"],
        names["target"]: at["target"],
        names["rate"]: F.least(F.lit(float(most)), F.exp(F.least(at["cut"] * x, F.lit(700.0)))),
        names["copies"]: F.when(size == 0, F.lit(1)).when(at["cut"].isNull(), every).otherwise(copies),
    }
    return joined.withColumns(out).select(*docs.columns, *names.values())
