"""Tables by category that grow by small loads.

The rows of a category lie in one of ``SLOTS`` folders, chosen by a hash of its
name.  A load writes new folders for the slots that it touches and never
changes one that exists; which folders are the table is told by a small map,
and a table on disk keeps its map in a manifest that is written last.  A reader
therefore sees all of a load or nothing, and reads only the slots it asks for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 256
# A slot of more pieces than this is written anew as one.
MOST_PIECES = 8


def slot_of(category: Column) -> Column:
    return F.pmod(F.xxhash64(category), F.lit(SLOTS)).cast("int")


def slots_of(spark: SparkSession, categories: list[str]) -> list[int]:
    """Slots of the named categories, without a job."""
    if not categories:
        return []
    named = F.array_distinct(F.transform(F.array(*map(F.lit, categories)), slot_of))
    return list(spark.range(1).select(named).first()[0])


@dataclass(frozen=True)
class Slots:
    """``pieces``: the folders of each slot that has rows."""

    spark: SparkSession
    schema: str
    pieces: dict[int, list[str]]

    def read(self, slots: list[int] | None = None) -> DataFrame:
        chosen = self.pieces if slots is None else {s: self.pieces[s] for s in slots if s in self.pieces}
        folders = [f for s in sorted(chosen) for f in chosen[s]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    @property
    def df(self) -> DataFrame:
        return self.read()

    def _written(self, rows: DataFrame, folder: str) -> dict[int, str]:
        """Write rows by slot, a hot one in many files; the folders by slot."""
        placed = rows.withColumn("slot", slot_of(F.col("category")))
        placed.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(folder)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        names = [s.getPath().getName() for s in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
        return {int(n.removeprefix("slot=")): f"{folder}/{n}" for n in names if n.startswith("slot=")}

    def append(self, rows: DataFrame, folder: str) -> Slots:
        """One more piece for each slot that the rows touch."""
        new = self._written(rows, folder)
        return Slots(self.spark, self.schema, self.pieces | {s: [*self.pieces.get(s, []), f] for s, f in new.items()})

    def compact(self, merge: Callable[[DataFrame], DataFrame], folder: str, most: int = MOST_PIECES) -> Slots:
        """Slots of more than ``most`` pieces become one piece each, through ``merge``."""
        long = [s for s, pieces in self.pieces.items() if len(pieces) > most]
        if not long:
            return self
        new = self._written(merge(self.read(long)), folder)
        return Slots(self.spark, self.schema, {s: p for s, p in self.pieces.items() if s not in long} | {s: [f] for s, f in new.items()})

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], folder: str, touched: list[int]) -> Slots:
        """``merge(old, new)`` for the slots that ``new`` may touch; the others are neither read nor written."""
        done = self._written(merge(self.read(touched), new), folder)
        return Slots(self.spark, self.schema, self.pieces | {s: [f] for s, f in done.items()})


class Manifest:
    """The numbered states of a table folder; the last one counts.

    A state is a small JSON file, written under another name and then renamed,
    so a state is there as a whole or not at all.  Writing a number again
    replaces it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/manifest"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path = lambda name: hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))

    def after(self) -> str:
        """A number between the last state's and the next whole one."""
        return f"{(self._names() or ['-'])[-1]}.1"

    def read(self, before: str | None = None) -> dict:
        """The last state, or the last one below a number."""
        names = [n for n in self._names() if before is None or n < before]
        if not names:
            return {}
        stream = self._fs.open(self._path(f"{names[-1]}.json"))
        try:
            reader = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            return json.loads(reader.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, number: str, state: dict, kept: int = 16) -> None:
        draft = self._path(f".{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        target = self._path(f"{number}.json")
        self._fs.delete(target, False)
        if not self._fs.rename(draft, target):
            raise OSError(f"cannot write {target}")
        for name in self._names()[:-kept]:
            self._fs.delete(self._path(f"{name}.json"), False)
