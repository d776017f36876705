"""How a set of filters acts on a corpus in every order, from one pass over the texts.

Each document gets a mask with a bit per filter that it fails.  What any order of
the filters keeps and removes at each step depends on the masks only, so the
documents are counted by mask (and part of the corpus, and label), and all orders
are evaluated on those counts, which add up.

Whether a text repeats an earlier one needs other documents.  A counting Bloom
filter is the prepass: each task counts the cells of its texts, the sketches are
merged by adding them, and a text one of whose cells was counted once occurs
nowhere else.  Only the others are shuffled, as whole texts, to find the
smallest id of each.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import join_counted, text_print

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
REPEATED = "E"
# Cells per text and per sketch segment, cells that each text counts. A sketch has at most
# MOST_SEGMENTS segments (a bit of each cell is broadcast: 32 MB); with more texts than that
# serves, more of them go through the exact step.
CELLS_PER_TEXT, SEGMENT, HASHES, MOST_SEGMENTS = 16, 1 << 16, 3, 1 << 12
SKETCH = "segment INT, cells BINARY, counts BINARY"
SPACE = r"[\x20\x09-\x0D]+"


def fails(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at a text alone; null is empty."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def cells_of(a: np.ndarray, b: np.ndarray, segments: int) -> np.ndarray:
    """Cells of texts by their two hashes (texts, HASHES)."""
    step = b.view(np.uint64)[:, None] | np.uint64(1)
    at = a.view(np.uint64)[:, None] + step * np.arange(HASHES, dtype=np.uint64)[None, :]
    at = (at ^ (at >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((at >> np.uint64(16)) % np.uint64(segments * SEGMENT)).astype(np.int64)


def _sketch(segments: int):
    """Cells that a task's texts count, by segment, with counts up to two."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
            # a text counts a cell once, even if two of its hashes meet there
            cells = np.sort(cells_of(a, b, segments), axis=1)
            fresh = np.ones(cells.shape, bool)
            fresh[:, 1:] = cells[:, 1:] != cells[:, :-1]
            found, times = np.unique(cells[fresh], return_counts=True)
            yield _by_segment(found, np.minimum(times, 2).astype(np.uint8))

    return sketch


def _by_segment(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    segment = cells // SEGMENT
    used, first = np.unique(segment, return_index=True)
    ends = [*first[1:], len(cells)]
    short = (cells % SEGMENT).astype(np.uint16)
    columns = [
        pa.array(used.astype(np.int32)),
        pa.array([short[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
        pa.array([counts[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "cells", "counts"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add sketches; segments come in order, and each becomes a bitmap of the cells counted twice or more."""
    at, total = None, np.zeros(SEGMENT, np.uint8)

    def done() -> pa.RecordBatch:
        bits = np.packbits(total >= 2, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits], pa.binary())], names=["segment", "bits"])

    for batch in batches:
        for segment, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if segment != at:
                if at is not None:
                    yield done()
                at = segment
                total[:] = 0
            where = np.frombuffer(cells.as_buffer(), np.uint16)
            total[where] = np.minimum(total[where] + np.frombuffer(counts.as_buffer(), np.uint8), 2)
    if at is not None:
        yield done()


def repeated_cells(prints: DataFrame, texts: int) -> np.ndarray:
    """Bitmap of the cells that two or more of the rows ``a, b`` count; at most 32 MB."""
    segments = int(min(max(-(-texts * CELLS_PER_TEXT // SEGMENT), 1), MOST_SEGMENTS))
    sketches = prints.select("a", "b").mapInArrow(_sketch(segments), SKETCH)
    merged = sketches.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment INT, bits BINARY").toArrow()
    bitmap = np.zeros((segments, SEGMENT // 8), np.uint8)
    for segment, bits in zip(merged["segment"].to_pylist(), merged["bits"].to_pylist(), strict=True):
        bitmap[segment] = np.frombuffer(bits, np.uint8)
    return bitmap.reshape(-1)


def _perhaps(bitmap: Broadcast):
    """Whether a text with these hashes may occur elsewhere."""

    @F.pandas_udf("boolean")
    def perhaps(a: pd.Series, b: pd.Series) -> pd.Series:
        bits = bitmap.value
        cells = cells_of(a.to_numpy(np.int64), b.to_numpy(np.int64), len(bits) * 8 // SEGMENT)
        return pd.Series((bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).all(axis=1))

    return perhaps


def _flagged(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``key, part, a, b, mask``: bits of the filters that look at the text alone, and the text's print."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("text")
    )
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in fails(F.col("text")).items()]
    return rows.select("key", "part", text_print(F.col("text")).alias("print"), sum(bits, F.lit(0)).alias("mask")).select("key", "part", "print.*", "mask")


def repeated_texts(docs: DataFrame, flagged: DataFrame, rows: int, key: str, text: str) -> DataFrame:
    """``a, b, n, least``: prints of texts that occur again, how often, and the smallest key."""
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_cells(flagged, rows))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), body.alias("text"))
    a, b = (text_print(F.col("text"))[c] for c in ("a", "b"))
    again = marked.filter(_perhaps(bitmap)(a, b)).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    return again.filter("n > 1").select(a.alias("a"), b.alias("b"), "n", "least")


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``key, part, mask`` of every row: bit n is set if the row fails the n-th of ``FILTERS``.

    A null text is empty, a null part the empty string.  E fails if a row with a
    smaller key has the same text; null keys are neither smaller nor larger.
    """
    flagged = materialize(_flagged(docs, key, text, part), "flags")
    again = materialize(repeated_texts(docs, flagged.df, max(flagged.rows, 1), key, text), "repeats").df
    every = join_counted(flagged.df, again, ["a", "b"], max(flagged.rows, 1), "left")
    late = F.when(F.col("key") > F.col("least"), 1 << FILTERS.index(REPEATED)).otherwise(0)
    return every.select("key", "part", (F.col("mask") + late).alias("mask"))


def mask_counts(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: rows with each mask, those labelled quality 1, and those labelled toxic 1.

    A key that is labelled more than once counts as good or toxic if one of its
    labels says so; labels without a key say nothing.
    """
    told = labels.select(F.col(f"`{key}`").cast("bigint").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told = told.filter("key IS NOT NULL").groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # Rows of one key collapse before the join, however many there are.
    once = masked.groupBy("key", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    sums = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return once.join(told, "key", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def _steps() -> Column:
    """Every order of the filters, step by step: its letters, the filter's bit and those of the filters before it."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for n, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            steps.append({"filter_order": "".join(order), "step": n + 1, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(steps)), "ARRAY<STRUCT<filter_order: STRING, step: INT, bit: INT, before: INT>>")


def orders(counted: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the counts by mask; zeros included."""
    cases = counted.withColumn("at", F.explode(_steps())).select("part", "mask", "n", "good", "toxic", "at.*")
    failing = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    orders_in_all = len(list(permutations(FILTERS)))
    # In one of as many orders as a document fails filters, this is the first of them.
    first_in = (F.lit(orders_in_all) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("bigint")
    count = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(0)).cast("bigint")
    return cases.groupBy("part", "filter_order", "step").agg(
        count(~failing & ~earlier).alias("kept"),
        count(failing & ~earlier).alias("removed"),
        count(failing & earlier).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(failing & ~earlier, "good").alias("good_lost"),
        count(failing & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(failing, F.col("n") * first_in).otherwise(0)).cast("bigint").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each of the 120 orders of the five filters keeps and removes, per part of the corpus and step.

    Without documents there are no parts and no rows.  Documents without a label
    count in neither ``good_lost`` nor ``toxic_lost``.  Other columns are not read.
    """
    return orders(mask_counts(masks(docs, key, text, part), labels, key))
