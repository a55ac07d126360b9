"""Tables in the folder all executors share, used to cut lineage between the rounds of a loop."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables made by ``written``, and those that are still there.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_STANDING: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` as a table written to the shared folder and read back. It goes with ``dropped``, or when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    _STANDING.add(path)
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Tables written inside send at most ``rows`` rows at a time to Python, so that its memory does not grow with rows of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _STANDING.discard(path)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the files of tables made by ``written`` that nothing reads any more."""
    for table in tables:
        if table is not None and (path := _FOLDERS.pop(table, None)):
            delete(table.sparkSession, path)


@atexit.register
def _drop_the_rest() -> None:
    """Tables that a lazily read result still needed go when the driver ends."""
    spark = SparkSession.getActiveSession()
    for path in list(_STANDING) if spark else []:
        try:
            delete(spark, path)
        except Exception:  # the session is ending; what is left goes with the shared folder
            return
