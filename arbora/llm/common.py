"""What several of the operators share: tables, folds, Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that Spark hands to Python at once; a batch of long texts stays small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(column: str) -> Column:
    """The text as bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_counted(
    rows: DataFrame, counted: DataFrame, keys: list[str], total: int, how: str = "inner", n: str = "n", share: int = 1000
) -> DataFrame:
    """Inner or left join of ``rows`` with a table that has one row per key and, in ``n``, how many rows have the key.

    Keys with more than one in ``share`` of the ``total`` rows are broadcast: there
    are at most ``share`` of them, however large the tables are.  All others meet
    in a shuffle in which no key holds a larger part.
    """
    hot = F.broadcast(counted.filter(F.col(n) > total / share))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(counted.filter(F.col(n) <= total / share), keys, how)
    return rows.join(hot, keys).unionByName(rest)


def text_print(text: Column) -> Column:
    """Two 64-bit hashes of a whole text, which stand for it in joins."""
    return F.struct(F.xxhash64(text, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))
