"""A training corpus from ``documents``: toxic documents go, near-duplicates are thinned, benchmark
passages and secrets are taken out, and what stays is packed into sequences.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``, and any others that docs has, as they were, whatever their names. Null and empty texts are clean and stay in every
stage, and are packed as an end mark each. Rows that repeat a doc_id are judged by their own text; of repeated rows with words near_duplicates keeps
one. Texts of any length are taken whole; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import decontaminate, near_dups, packing, secrets, toxicity
from kmerloom.llm.common import dropped, fresh, table, written
from kmerloom.llm.queries import TOXIC_AT, WORD_TOKENIZER, tokenizer_path, toxicity_model


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its own columns of these names, which an operator is about to make, under free ones; and the columns as they were."""
    free = {c: fresh(docs, "kept_" + c) for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(free), [F.col(f"`{free.get(c, c)}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; the model is trained on labels outside the held-out third."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    rows, columns = aside(docs, "toxicity", "toxic_passages")
    return toxicity.score(rows, model).where(F.col("toxicity") < TOXIC_AT).select(*columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for the least (doc_id, word sequence) of each near-duplicate class; rows without doc_id or words stay."""
    key = [fresh(docs, "key1"), fresh(docs, "key2")]
    worded = fresh(docs, "worded")
    kept = near_dups.duplicate_classes(docs).where("node = class").select("class.*").distinct().withColumnsRenamed({"key1": key[0], "key2": key[1]})
    keyed = near_dups.with_sequence_key(docs, (*key, worded))
    alone = F.col("doc_id").isNull() | ~F.col(worded)
    known = keyed.where(~alone).join(kept, ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key])
    return known.select(*docs.columns).unionByName(keyed.where(alone).select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    rows, columns = aside(docs, "n_words", "n_hit", "hit_spans", "hit_items")
    return decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars counted again where that was done."""
    rows, columns = aside(docs, "secret_spans")
    clean = secrets.redact(secrets.scan_secrets(rows), "secret_spans")
    size = F.when(F.size("secret_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path(WORD_TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Dart-thrown signatures and segment scores have no SQL form; the rows are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
