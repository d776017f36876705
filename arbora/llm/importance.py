"""Importance resampling towards a target distribution, with segments counted once.

Texts become bags of hashed n-grams of words.  A bucket's gain is the logarithm of
how much more frequent it is in the target's texts than in the documents; a
document's weight is the sum of the gains of its features, and the weights plus
Gumbel noise, largest first, draw documents without replacement.

Newlines cut the documents into lines, and copies of a line are one line: the
features within a line are counted once per distinct line and multiplied by its
number of occurrences, and so are gains.  N-grams that run over a line's end are
few; each document keeps the buckets of its own.

The hash is the CRC-32 of the n-gram's bytes.  CRCs are linear, so those of n-grams
are composed from those of their words for a whole batch of texts at once.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import dense_index
from ..session import materialize
from .common import free_name, join_counted, small_batches, text_print

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, "42"
# Bytes of text that are cut into words at once; a longer text is alone.
AT_ONCE = 4 << 20
# Longer words and shifts take another way, with the same result.
LONG = 64


def _word_bytes() -> np.ndarray:
    """Lower-case byte of each byte that can be part of a word, 0 for the others."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    for first, last in (("0", "9"), ("a", "z")):
        table[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of single bytes, and of ``L`` zero bytes after each byte of a CRC (LONG + 1, 4, 256)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1)
    shifts = np.zeros((LONG + 1, 4, 256), np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(LONG):
        shifts[n + 1] = step[shifts[n] & 0xFF] ^ (shifts[n] >> 8)
    return step, shifts.reshape(-1)


WORD = _word_bytes()
CRC, SHIFTS = _crc_tables()


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The part of a CRC that is left after so many more bytes."""

    def few(c: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = n.astype(np.int32) * 1024
        out = SHIFTS[at + (c & 0xFF)] ^ SHIFTS[at + 256 + ((c >> 8) & 0xFF)]
        return out ^ SHIFTS[at + 512 + ((c >> 16) & 0xFF)] ^ SHIFTS[at + 768 + (c >> 24)]

    out = few(crc, np.minimum(zeros, LONG))
    far = np.flatnonzero(zeros > LONG)
    left = zeros[far] - LONG
    while len(far):
        out[far] = few(out[far], np.minimum(left, LONG))
        far, left = far[left > LONG], left[left > LONG] - LONG
    return out


@dataclass
class Words:
    """Words of several texts in order: lower-case bytes, where each begins, its length, its text and line."""

    lower: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    line: np.ndarray

    def crcs(self, chosen: np.ndarray) -> np.ndarray:
        """CRC-32 of the chosen words."""
        start, length = self.start[chosen], self.length[chosen]
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        long = int((length > LONG).sum())
        for p in range(min(int(length[0]), LONG) if len(length) else 0):
            m = int(np.searchsorted(-length, -p, "left"))  # those longer than p
            c = crc[:m]
            crc[:m] = CRC[(c ^ self.lower[start[:m] + p]) & 0xFF] ^ (c >> 8)
        crc = ~crc
        for n in range(long):
            crc[n] = zlib.crc32(self.lower[start[n] : start[n] + length[n]].tobytes())
        out = np.empty(len(order), np.uint32)
        out[order] = crc
        return out


def words_of(buffer: np.ndarray, ends: np.ndarray) -> Words:
    """Cut texts that lie one after the other (``ends``: where each ends) into words."""
    lower = WORD[buffer]
    on = lower != 0
    before = np.empty(len(on) + 1, bool)
    before[0], before[1:] = False, on
    before[ends] = False
    after = np.empty(len(on) + 1, bool)
    after[:-1], after[-1] = on, False
    after[ends] = False
    start = np.flatnonzero(on & ~before[:-1])
    length = np.flatnonzero(on & ~after[1:]) + 1 - start
    text = np.searchsorted(ends, start, "right")
    line = np.searchsorted(np.flatnonzero(buffer == 10), start)
    return Words(lower, start, length, text, line)


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    """First row, row after the last, and the words of as many texts as fit together; null is empty."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    row = 0
    while row < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[row] + AT_ONCE, "right")) - 1, row + 1)
        yield row, last, words_of(data[offsets[row] : offsets[last]], offsets[row + 1 : last + 1] - offsets[row])
        row = last


def _grams(crc: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of every two and three words that follow each other, joined by spaces."""
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
    two = shifted(crc[:-1], length[1:] + 1) ^ spaced[1:]
    three = shifted(two[:-1], length[2:] + 1) ^ spaced[2:]
    return two, three


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every run of one to three words."""
    if not len(words.start):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    crc = words.crcs(np.arange(len(words.start)))
    two, three = _grams(crc, words.length)
    text = words.text
    in_two, in_three = text[:-1] == text[1:], text[:-2] == text[2:]
    crcs = np.concatenate([crc, two[in_two], three[in_three]])
    return crcs % np.uint32(BUCKETS), np.concatenate([text, text[:-1][in_two], text[:-2][in_three]])


def crossing(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every run of two or three words that is not within one line, by text."""
    text, line = words.text, words.line
    in_two = (text[:-1] == text[1:]) & (line[:-1] != line[1:])
    in_three = (text[:-2] == text[2:]) & (line[:-2] != line[2:])
    need = np.zeros(len(text), bool)
    for n, runs in ((2, in_two), (3, in_three)):
        for i in range(n):
            need[i : len(text) - n + 1 + i] |= runs
    if not need.any():
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    crc = np.zeros(len(text), np.uint32)
    crc[need] = words.crcs(np.flatnonzero(need))
    two, three = _grams(crc, words.length)
    owner = np.concatenate([text[:-1][in_two], text[:-2][in_three]])
    order = np.argsort(owner, kind="stable")
    return (np.concatenate([two[in_two], three[in_three]]) % np.uint32(BUCKETS))[order], owner[order]


def _filled(total: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], names=["bucket", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features per bucket of texts (first column) that occur so often (second column)."""
    total = np.zeros(BUCKETS)
    for batch in batches:
        times = batch.column(1).to_numpy(zero_copy_only=False)
        for first, last, words in texts_of(batch, 0):
            bucket, text = features(words)
            total += np.bincount(bucket, weights=times[first:last][text], minlength=BUCKETS)
    yield _filled(total)


def _count_crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for buckets in batch.column(0):
            total += np.bincount(np.frombuffer(buckets.as_buffer(), np.uint16), minlength=BUCKETS)
    yield _filled(total)


def _cross_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, key, print`` as they are, the buckets of n-grams over line ends, and prints of the lines with their numbers."""
    for batch in batches:
        cross: list[bytes] = []
        for first, last, words in texts_of(batch, 3):
            bucket, owner = crossing(words)
            bounds = np.searchsorted(owner, np.arange(last - first + 1))
            short = bucket.astype(np.uint16)
            cross += [short[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lines = batch.column(4)
        flat = lines.flatten()
        pairs = np.empty(len(flat), [("a", np.int64), ("b", np.int64)])
        for side in ("a", "b"):
            pairs[side] = flat.field(side).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        kept = [np.unique(pairs[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        sizes = np.concatenate([[0], np.cumsum([len(k) for k, _ in kept])]).astype(np.int32)
        every = np.concatenate([k for k, _ in kept]) if kept else pairs
        times = np.concatenate([n for _, n in kept]) if kept else np.zeros(0, np.int64)
        columns = [pa.array(every["a"]), pa.array(every["b"]), pa.array(times, pa.int64())]
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(columns, names=["a", "b", "times"]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cross, pa.binary()), lists], names=["row", "key", "print", "cross", "lines"])


def _weigh_lines(gains: Broadcast):
    """Sum of gains and number of words of each line (first column); the other columns stay."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, last, words in texts_of(batch, 0):
                bucket, text = features(words)
                weight[first:last] = np.bincount(text, weights=gains.value[bucket], minlength=last - first)
                count[first:last] = np.bincount(words.text, minlength=last - first)
            columns = [*batch.columns[1:], pa.array(weight.astype(np.int64)), pa.array(count)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "weight", "words"])

    return weigh


def _weigh_crossing(gains: Broadcast):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gains.value[np.frombuffer(b.as_buffer(), np.uint16)].sum()) for b in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["row", "key", "print", "weight"])

    return weigh


def bucket_counts(counted: DataFrame) -> np.ndarray:
    """Sums of ``n`` by bucket; a table of ``BUCKETS`` rows at most."""
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS, np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return total


def gains_of(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket."""
    every, wanted = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = ((target + 1.0) * every) / ((source + 1.0) * wanted)
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.float64)


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the key's SHA-256; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def score_documents(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``key, n_features, weight, score, rank, print`` of every row of ``docs``; rank is null if it is not drawn.

    ``target`` needs the text column only.  A null text is empty: no feature,
    weight 0.  Of the documents with ``least_words`` words or more, ``percent`` in
    a hundred are drawn (rounded down), ties to the smaller key, null keys last;
    equal rows are drawn one by one.  ``print`` stands for the whole text.  An
    empty target gives every bucket a gain as if each had one feature.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = F.col(f"`{key}`").cast("bigint")
    once = docs.select(body.alias("line")).select(F.explode(F.split("line", "\n")).alias("line")).filter("line <> ''")
    lines = materialize(once.groupBy("line").agg(F.count(F.lit(1)).alias("n")), "lines").df
    rows = docs.select(own.alias("key"), body.alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "key", text_print(F.col("text")).alias("print"), "text",
        F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), text_print).alias("lines"),
    )
    pair = "STRUCT<a: BIGINT, b: BIGINT>"
    index_of = f"row BIGINT, key BIGINT, print {pair}, cross BINARY, lines ARRAY<STRUCT<a: BIGINT, b: BIGINT, times: BIGINT>>"
    index = materialize(rows.mapInArrow(_cross_lines, index_of), "index").df
    counted = lines.mapInArrow(_count, "bucket INT, n BIGINT").union(index.select("cross").mapInArrow(_count_crossing, "bucket INT, n BIGINT"))
    wanted = target.select(F.col(f"`{text}`").cast("string"), F.lit(1).cast("bigint")).mapInArrow(_count, "bucket INT, n BIGINT")
    gains = spark.sparkContext.broadcast(gains_of(bucket_counts(wanted), bucket_counts(counted)))
    # Each distinct line is weighed once; its occurrences take over weight and number of words.
    printed = lines.select("line", *[text_print(F.col("line"))[c].alias(c) for c in ("a", "b")], "n")
    weighed = materialize(printed.mapInArrow(_weigh_lines(gains), "a BIGINT, b BIGINT, n BIGINT, weight BIGINT, words BIGINT"), "weighed").df
    total = weighed.agg(F.sum("n")).first()[0] or 0
    met = join_counted(index.select("row", F.inline("lines")), weighed, ["a", "b"], total)
    own_lines = met.select("row", (F.col("weight") * F.col("times")).alias("weight"), (F.col("words") * F.col("times")).alias("words"))
    crossed = index.mapInArrow(_weigh_crossing(gains), f"row BIGINT, key BIGINT, print {pair}, weight BIGINT")
    sums = crossed.withColumn("words", F.lit(0).cast("bigint")).unionByName(own_lines, allowMissingColumns=True).groupBy("row")
    sums = sums.agg(F.max("key").alias("key"), F.max("print").alias("print"), F.sum("weight").alias("weight"), F.sum("words").alias("words"))
    count = F.when(F.col("words") < 2, F.col("words")).otherwise(3 * F.col("words") - 3)
    scored = materialize(sums.select("*", count.alias("n_features"), (F.col("weight") + noise(F.col("key"))).alias("score")), "scored").df
    enough = F.col("words") >= least_words
    drawn = percent * scored.filter(enough).count() // 100
    ranked = dense_index(scored.filter(enough), [F.desc("score"), F.asc_nulls_last("key"), "row"], name="rank")
    place = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("bigint").alias("rank")
    columns = ["key", "n_features", "weight", "score"]
    rest = scored.filter(~enough).select(*columns, F.lit(None).cast("bigint").alias("rank"), "print")
    return ranked.select(*columns, place, "print").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; a row that occurs again with its key stays with it."""
    drawn = score_documents(docs, target, key, text, percent).filter("rank IS NOT NULL")
    mine, theirs, same = (free_name(docs, c) for c in ("drawn_key", "drawn_print", "own_print"))
    drawn = drawn.select(F.col("key").alias(mine), F.col("print").alias(theirs)).distinct()
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = F.col(f"`{key}`").cast("bigint")
    marked = docs.withColumn(same, text_print(body))
    return marked.join(drawn, own.eqNullSafe(F.col(mine)) & (F.col(same) == F.col(theirs)), "left_semi").drop(same)
