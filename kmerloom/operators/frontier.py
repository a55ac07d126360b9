"""Loops whose rounds outlive the driver: tables of finished rounds, and a manifest that says which of them count.

A round writes its tables and then one small manifest, under another name first and renamed at once. A loop that starts again in the same folder goes on
after the last manifest; tables that no manifest names are leftovers and go.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """The finished rounds of one loop in the folder ``where``, which all executors reach."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self._paths(self.where).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.system.mkdirs(self._paths(f"{self.where}/tables"))
        numbers = [int(n.split("-")[1]) for n in self._names(self.where) if n.startswith("round-")]
        self.round = max(numbers, default=0)
        self.tables: dict[str, list[str]] = json.loads(self._read(self.round)) if numbers else {}
        self._tidy(numbers)

    def _names(self, where: str) -> list[str]:
        return [f.getPath().getName() for f in self.system.listStatus(self._paths(where))]

    def _read(self, number: int) -> str:
        return "".join(r["value"] for r in self.spark.read.text(f"{self.where}/round-{number}").collect())

    def _tidy(self, numbers: list[int]) -> None:
        """Deletes manifests before the last one, and tables that it does not name."""
        for n in numbers:
            if n != self.round:
                self.system.delete(self._paths(f"{self.where}/round-{n}"), True)
        named = {t for each in self.tables.values() for t in each}
        for t in self._names(f"{self.where}/tables"):
            if t not in named:
                self.system.delete(self._paths(f"{self.where}/tables/{t}"), True)

    def write(self, df: DataFrame) -> str:
        """The name of a table with the rows of ``df``; it counts once a manifest names it."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.where}/tables/{name}")
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.where}/tables/{t}" for t in self.tables[name]))

    def commit(self, number: int, tables: dict[str, list[str]]) -> None:
        """From now on the loop has finished round ``number`` with these tables; others go."""
        hidden, name = self._paths(f"{self.where}/.{uuid.uuid4().hex}"), self._paths(f"{self.where}/round-{number}")
        out = self.system.create(hidden)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if not self.system.rename(hidden, name):
            raise OSError(f"round {number} was finished by another driver")
        before, self.round, self.tables = self.round, number, tables
        self._tidy([before] if before and before != number else [])


def hops(edges: DataFrame, starts: DataFrame, where: str, *, most: int | None = None) -> DataFrame:
    """(node, hops): the fewest edges (src, dst) from any of the ``starts`` (node) to each node, breadth first; ``most`` ends the search early.

    Each round's frontier is a table of the folder ``where``; what was seen is the union of them, so a node is written once. A call with the folder of a
    call that died goes on where that one was.
    """
    loop = Manifest(edges.sparkSession, where)
    if not loop.tables:
        links = loop.write(edges.select("src", "dst").distinct())
        loop.commit(1, {"links": [links], "seen": [loop.write(starts.select("node", F.lit(0).cast("bigint").alias("hops")).distinct())], "end": []})
    while not loop.tables["end"] and (most is None or loop.round <= most):
        seen, front = loop.read("seen"), loop.spark.read.parquet(f"{loop.where}/tables/{loop.tables['seen'][-1]}")
        ahead = loop.read("links").join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        new = loop.write(ahead.join(seen, "node", "left_anti").select("node", F.lit(loop.round).cast("bigint").alias("hops")))
        empty = loop.spark.read.parquet(f"{loop.where}/tables/{new}").isEmpty()
        tables = loop.tables | ({"end": [loop.tables["seen"][0]]} if empty else {"seen": [*loop.tables["seen"], new]})
        loop.commit(loop.round + 1, tables)
    return loop.read("seen")


