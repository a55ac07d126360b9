"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none and runs on this machine alone (tests); on a cluster
    that is an error, since executors would not see one another's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Folders of the tables made by ``written``, and of those that are still there.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_STANDING: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: cuts lineage, survives lost executors."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    _STANDING.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _STANDING.discard(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``written`` that nothing reads any more."""
    for table in tables:
        if path := _FOLDERS.pop(table, None):
            _delete(table.sparkSession, path)


@atexit.register
def _drop_the_rest() -> None:
    """Tables that a lazily read result still needed go when the driver ends."""
    spark = SparkSession.getActiveSession()
    for path in list(_STANDING) if spark else []:
        try:
            _delete(spark, path)
        except Exception:  # the session is ending; what is left goes with the shared folder
            return


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many lines before it as it takes to be no column of ``df``."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> pa.Array:
    """Text column with nulls as empty strings and 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (vectorised, wraps around)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting (numpy's own unique hashes long integers, which is slower)."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive segments: owner of each element, and its position inside its owner."""
    lengths = np.asarray(lengths, dtype=np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - starts[owner]


def text_chunks(batches, text: str, most: int = 8 << 20):
    """Record batches cut so that each piece has about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def space_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII spaces and line feeds: code of each word in order, words per text, distinct words."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), counts, coded.dictionary


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over consecutive segments of ``counts`` elements (empty segments: 0)."""
    sums = np.cumsum(values)
    total = np.concatenate((np.zeros(1, sums.dtype), sums))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
