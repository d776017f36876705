"""Session settings and the shared working folder for intermediate tables.

Loops cut their lineage by writing each step as a parquet table below
``spark.checkpoint.dir``.  Such a table survives the loss of executors, keeps
its columns prunable and has a known size, so Catalyst can decide from the
real file size whether a side may be broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# AQE splits hot partitions of joins at run time, also where an aggregate follows.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # lets parquet check each pushed id against the row group statistics
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
}

_local_base: dict[str, str] = {}
_tables: list[tuple[str, str]] = []  # bucketed tables of this process by their folders
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


@dataclass(frozen=True)
class Stored:
    """A written intermediate table, the number of its rows and of those that were marked.

    The counts are taken while writing; a repeated task may raise both, but what
    is empty counts 0, and they are equal only if every row is marked.
    """

    df: DataFrame
    rows: int
    path: str
    marked: int = 0


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def workspace(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        if app not in _local_base:
            _local_base[app] = tempfile.mkdtemp(prefix="arbora-")
        base = _local_base[app]
    return f"{base.rstrip('/')}/arbora-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return "/".join([workspace(spark), *_scopes.get(), f"{name}-{uuid.uuid4().hex}"])


def materialize(df: DataFrame, name: str = "table", mark: Column | None = None) -> Stored:
    """Write ``df`` to the working folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    marked = F.count_if(F.lit(False) if mark is None else mark).alias("marked")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), marked).write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), seen.get["rows"], path, seen.get["marked"])


class Bucketed:
    """A table below the working folder whose files are dealt out by a hash of ``keys``.

    Joins and groupings on the keys read it without a shuffle.  It is filled in
    steps; each is a partition of its own, which the last column names.
    """

    def __init__(self, like: DataFrame, name: str, keys: list[str], buckets: int, step: str | None = None):
        self.spark, self.step, self.buckets = like.sparkSession, step, buckets
        self.path, self.name = scratch_path(self.spark, name), f"arbora_{uuid.uuid4().hex}"
        self.columns = [c for c in like.columns if c != step]
        fields = ", ".join(f"`{c}` {like.schema[c].dataType.simpleString()}" for c in self.columns)
        by = ", ".join(f"`{k}`" for k in keys)
        more, part = (f", `{step}` BIGINT", f"PARTITIONED BY (`{step}`)") if step else ("", "")
        self.spark.sql(
            f"CREATE TABLE {self.name} ({fields}{more}) USING parquet {part} "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        _tables.append((self.path, self.name))

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, step: int | None = None) -> int:
        """Append rows; returns their number, which is exact if it is 0."""
        seen = Observation()
        rows = rows.select(*self.columns)
        if self.step:
            rows = rows.withColumn(self.step, F.lit(step).cast("bigint"))
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.insertInto(self.name)
        return seen.get["rows"]

    def at(self, step: int) -> DataFrame:
        return self.df.filter(F.col(self.step) == step)


def read_stored(spark: SparkSession, like: Stored, paths: list[str]) -> DataFrame:
    return spark.read.schema(like.df.schema).parquet(*paths)


def _delete(spark: SparkSession, folder: str) -> None:
    for place, name in [t for t in _tables if t[0].startswith(f"{folder}/")]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _tables.remove((place, name))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside the block when it ends.

    Results have to be written or collected before; a graph that should outlive
    the block must be built, and its edge tables used, outside.  A thread sees
    the blocks that it opened itself, no other thread's.
    """
    inner = (*_scopes.get(), f"scope-{uuid.uuid4().hex}")
    token = _scopes.set(inner)
    try:
        yield
    finally:
        _scopes.reset(token)
        _delete(spark, "/".join([workspace(spark), *inner]))


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    _delete(spark, workspace(spark))


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small parameter table (roots, search terms) from driver values."""
    return spark.createDataFrame(rows, schema)


def empty_like(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))
