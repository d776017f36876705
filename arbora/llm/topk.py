"""Exact top-k inner products over a bit-sliced index.

The index cuts the rows into blocks.  A block holds, for each attribute, the
bitmaps of a coarse version of its values (``BITS`` slices above the block's
minimum) and the exact whole numbers.  For a query the slices of all attributes
are added, each shifted by the bits of the query's weight, with carry-save
steps on whole bitmaps; negative weights take the complement of the slices.
The sum is again bit-sliced: walking from its most significant slice down gives
the k-th largest coarse score.  Rows that the coarse part could hide below it
are the boundary rows; their exact scores decide.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Slices per attribute, rows per block of the index, queries that meet a block together.
BITS = 6
BLOCK_ROWS = 16_384
QUERY_ROWS = 64
# Copies of a block that share its queries, so that few blocks keep many tasks busy.
COPIES = 4
SCALE = 256.0

BLOCKS = "part INT, block BIGINT, dim INT, ids ARRAY<BIGINT>, kind STRING, exact BINARY, slices BINARY, shift ARRAY<INT>"
BATCHES = "batch BIGINT, dim INT, ids ARRAY<BIGINT>, weights BINARY"
HITS = "query_id BIGINT, vec_id BIGINT, score BIGINT"


def quantised(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, v``: floor(256 * x) of each component; vectors with a gap are left out."""
    x = F.col(vector).cast("array<double>")
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e * SCALE).cast("bigint"))
    return df.select(F.col(vec_id).cast("bigint").alias("id"), F.when(usable, whole).alias("v")).filter("v IS NOT NULL")


def _by_dim(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, list, int]]:
    """Rows of equal length as one matrix, at most ``limit`` at once."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, vectors = batch.column(0).to_pylist(), batch.column(1)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
        for n, end in enumerate(ends.tolist()):
            start = int(ends[n - 1]) if n else 0
            rows = held.setdefault(end - start, [])
            rows.append((ids[n], flat[start:end]))
            if len(rows) == limit:
                yield np.array([r[1] for r in rows]).reshape(limit, end - start), [r[0] for r in rows], end - start
                held[end - start] = []
    for dim, rows in held.items():
        if rows:
            yield np.array([r[1] for r in rows]).reshape(len(rows), dim), [r[0] for r in rows], dim


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of 64-bit words from an array of 0 and 1 per row."""
    room = -bits.shape[-1] % 64
    full = np.pad(bits, [*[(0, 0)] * (bits.ndim - 1), (0, room)])
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


def _slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices (attribute, bit, word) of the coarse values above the minimum, and each attribute's shift."""
    low = values.min(axis=0)
    width = np.array([int(w).bit_length() for w in values.max(axis=0) - low])
    shift = np.maximum(width - BITS, 0)
    coarse = ((values - low) >> shift).T
    bits = (coarse[:, None, :] >> np.arange(BITS)[None, :, None]) & 1
    return _packed(bits.astype(np.uint8)), shift


def _make_blocks(limit: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for values, ids, dim in _by_dim(batches, limit):
            slices, shift = _slices(values) if dim else (np.zeros(0), np.zeros(0, int))
            kind = np.min_scalar_type(-int(np.abs(values).max(initial=0)) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([(part << 32) + n], pa.int64()),
                    pa.array([dim], pa.int32()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([kind.str]),
                    pa.array([values.astype(kind).tobytes()], pa.binary()),
                    pa.array([slices.tobytes()], pa.binary()),
                    pa.array([shift.tolist()], pa.list_(pa.int32())),
                ],
                names=["part", "block", "dim", "ids", "kind", "exact", "slices", "shift"],
            )
            n += 1

    return make


def _make_batches(limit: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for values, ids, dim in _by_dim(batches, limit):
            columns = [
                pa.array([base + n], pa.int64()),
                pa.array([dim], pa.int32()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([values.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "dim", "ids", "weights"])
            n += 1

    return make


def add_slices(slices: np.ndarray, shift: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices of the sum over attributes of ``|weight| * 2**shift * coarse``.

    ``coarse`` is complemented where the weight is negative.
    """
    flipped = np.where((weights < 0)[:, None, None], ~slices, slices)
    scaled = [abs(int(w)) << int(s) for w, s in zip(weights, shift, strict=True)]
    planes: dict[int, list[np.ndarray]] = {}
    for j in range(max((w.bit_length() for w in scaled), default=0)):
        using = [d for d, w in enumerate(scaled) if w >> j & 1]
        if using:
            for b in range(BITS):
                planes.setdefault(j + b, []).append(flipped[using, b])
    total, at = [], min(planes, default=0)
    low = at
    while at in planes:
        maps = np.concatenate(planes.pop(at))
        while len(maps) > 1:
            third = max(len(maps) // 3, 1)
            a, b = maps[:third], maps[third : 2 * third]
            c = maps[2 * third : 3 * third] if len(maps) > 2 else np.zeros_like(a)
            either = a ^ b
            planes.setdefault(at + 1, []).append((a & b) | (either & c))
            maps = np.concatenate([either ^ c, maps[3 * third :]])
        total.append(maps[0])
        at += 1
    return [np.zeros(slices.shape[-1], np.uint64)] * low + total


def top_and_boundary(total: list[np.ndarray], there: np.ndarray, k: int, hidden: int) -> np.ndarray:
    """Bitmap of the rows whose sum plus at most ``hidden`` can reach the k-th largest sum."""
    sure, open_, threshold = np.zeros_like(there), there, 0
    for bit in range(len(total) - 1, -1, -1):
        ones = open_ & total[bit]
        if int(np.bitwise_count(sure | ones).sum()) >= k:
            open_, threshold = ones, threshold | 1 << bit
        else:
            sure, open_ = sure | ones, open_ & ~total[bit]
    least = threshold - hidden
    if least <= 0:
        return there
    if least.bit_length() > len(total):
        return np.zeros_like(there)
    above, equal = np.zeros_like(there), there
    for bit in range(len(total) - 1, -1, -1):
        if least >> bit & 1:
            equal = equal & total[bit]
        else:
            above, equal = above | (equal & total[bit]), equal & ~total[bit]
    return above | equal


def block_top(block: dict, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows of a block, ties to the smaller id."""
    ids, exact, known = block["ids"], block["exact"], block["known"]
    there = block["there"] & ~_packed((known & (ids == query_id)).astype(np.uint8))
    count = int(np.bitwise_count(there).sum())
    if count > k and block["dim"]:
        total = add_slices(block["slices"], block["shift"], weights)
        hidden = sum(abs(int(w)) * ((1 << int(s)) - 1) for w, s in zip(weights, block["shift"], strict=True))
        there = top_and_boundary(total, there, k, hidden)
    rows = np.flatnonzero(np.unpackbits(there.view(np.uint8), bitorder="little")[: len(ids)])
    scores = exact[rows] @ weights
    order = np.lexsort((ids[rows], ~known[rows], -scores))[:k]
    return rows[order], scores[order]


def _fits(exact: np.ndarray, weights: np.ndarray) -> None:
    if exact.size and weights.size:
        most = np.abs(exact.astype(np.float64)).max(axis=0) * np.abs(weights.astype(np.float64)).max(axis=0)
        if most.sum() >= 2.0**62:
            raise OverflowError("inner products beyond 64 bits")


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"block": None}
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, r=row, b=batch: b.column(name)[r]
                dim, number = get("dim").as_py(), get("block").as_py()
                if held["block"] != number:
                    ids = get("ids").as_py()
                    values = np.frombuffer(get("exact").as_buffer(), get("kind").as_py()).reshape(len(ids), dim).astype(np.int64)
                    words = -(-len(ids) // 64)
                    held = {
                        "block": number,
                        "dim": dim,
                        "known": np.array([i is not None for i in ids]),
                        "ids": np.array([0 if i is None else i for i in ids], np.int64),
                        "exact": values,
                        "slices": np.frombuffer(get("slices").as_buffer(), np.uint64).reshape(dim, BITS, words) if dim else None,
                        "shift": np.array(get("shift").as_py(), np.int64),
                        "there": _packed(np.ones(len(ids), np.uint8)),
                    }
                queries = get("query_ids").as_py()
                weights = np.frombuffer(get("weights").as_buffer(), np.int64).reshape(len(queries), dim)
                _fits(held["exact"], weights)
                out: list[tuple] = []
                for query, weight in zip(queries, weights, strict=True):
                    best, scores = block_top(held, query, weight, k)
                    for r, s in zip(best.tolist(), scores.tolist(), strict=True):
                        out.append((query, int(held["ids"][r]) if held["known"][r] else None, s))
                columns = [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows of ``vectors``.

    Scores are inner products of the components as floor(256 * x).  A row with
    the query's own id is no candidate; equal scores go to the smaller id, null
    ids last.  Vectors that are null or hold a null or non-finite component take
    no part; rows of another length than the query's are no candidates for it.
    A query id that occurs again counts once (its smallest vector), a repeated
    candidate as often as it occurs.  Fewer candidates than k give fewer rows.
    Scores that might pass 64 bits raise ``OverflowError``.
    """
    rows = quantised(vectors, vec_id, vector)
    asked = quantised(queries, vec_id, vector).filter("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    parts = max(1, -(-rows.count() // block_rows))
    index = materialize(rows.repartition(parts).mapInArrow(_make_blocks(block_rows), BLOCKS), "index").df
    tasks = max(1, -(-asked.count() // (4 * QUERY_ROWS)))
    batches = materialize(asked.repartition(tasks).mapInArrow(_make_batches(QUERY_ROWS), BATCHES), "queries").df
    # Every batch of queries meets every block: it is sent to each part of the index by number.
    copies = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    sent = batches.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.pmod(F.xxhash64("batch"), F.lit(COPIES)).cast("int").alias("copy"),
        F.col("dim").alias("query_dim"),
        F.col("ids").alias("query_ids"),
        "weights",
    )
    cells = parts * COPIES
    met = copies.repartition(cells, "part", "copy").join(sent.repartition(cells, "part", "copy"), ["part", "copy"])
    met = met.filter("dim = query_dim").select("block", "dim", "ids", "kind", "exact", "slices", "shift", "query_ids", "weights")
    hits = met.mapInArrow(_search(k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
