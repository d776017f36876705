"""Approximate nearest neighbours by vantage-point trees, one per shard of the rows.

A node of a tree splits its rows at the median of their distances to a vantage
row and remembers the least and greatest distance on either side.  By the
triangle inequality, a side can hold nothing nearer to a query than the gap
between the query's distance to the vantage row and that range.  A side is left
out if the gap, multiplied by ``factor``, passes the query's k-th best distance
so far: factor one never loses a neighbour, larger ones leave out more.

Queries meet a tree in batches: each first goes down to the leaf on its side of
all splits, which gives it a k-th distance, then the batch visits the tree once,
and each node passes on the queries that it cannot leave out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import BATCH_ROWS, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a tree, rows of a leaf, queries that meet a tree together.
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 64, 1024
# Rows tried as a node's vantage row, and rows that they are judged by.
TRIED, JUDGES = 8, 64
FACTOR = 5.0
# Trees and batches of queries are rows of some megabytes.
ROWS_AT_ONCE = 8
# Room for rounding in sums of distances.
SLACK = 1e-9

NODE = np.dtype([("lo", "i4"), ("hi", "i4"), ("left", "i4"), ("right", "i4"), ("least", "f8", 2), ("most", "f8", 2)])
TREES = "shard BIGINT, dim INT, ids ARRAY<BIGINT>, kind STRING, points BINARY, nodes BINARY"
BATCHES = "batch BIGINT, dim INT, ids ARRAY<BIGINT>, kind STRING, points BINARY"
HITS = "query_id BIGINT, vec_id BIGINT, score DOUBLE"


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, v`` in double precision; null and zero vectors and those with a gap are left out."""
    x = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(x, lambda e: e != 0)
    return df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.when(whole, x).alias("v")).filter("v IS NOT NULL")


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances (points, to), summed in the order of the components."""
    out = np.zeros((len(points), len(to)))
    for x, y in zip(points.T, to.T, strict=True):
        out += np.square(x[:, None] - y[None, :])
    return np.sqrt(out)


def build(points: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and nodes of their tree; a node's vantage row is its first."""
    rng = np.random.default_rng(seed)
    order, nodes = np.arange(len(points)), []
    todo = [(0, len(points), -1, "")]
    while todo:
        lo, hi, parent, side = todo.pop()
        at = len(nodes)
        nodes.append(np.zeros((), NODE))
        nodes[at]["lo"], nodes[at]["hi"], nodes[at]["left"], nodes[at]["right"] = lo, hi, -1, -1
        if parent >= 0:
            nodes[parent][side] = at
        if hi - lo <= max(leaf_rows, 2):
            continue
        own = order[lo:hi]
        tried = rng.choice(hi - lo, min(TRIED, hi - lo), replace=False)
        judges = points[rng.choice(own, min(JUDGES, hi - lo), replace=False)]
        best = tried[np.argmax(distances(points[own[tried]], judges).std(axis=1))]
        own[[0, best]] = own[[best, 0]]
        away = distances(points[own[1:]], points[own[:1]])[:, 0]
        middle = len(away) // 2
        ranked = np.argsort(away, kind="stable")
        own[1:], away = own[1:][ranked], away[ranked]
        for n, part in enumerate((away[:middle], away[middle:])):
            nodes[at]["least"][n], nodes[at]["most"][n] = part[0], part[-1]
        todo += [(lo + 1 + middle, hi, at, "right"), (lo + 1, lo + 1 + middle, at, "left")]
    return order, np.array(nodes, NODE)


@dataclass
class Tree:
    """Rows in the order of the tree, ids with whether they are known, nodes."""

    points: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    nodes: np.ndarray


class Search:
    """The nearest rows of one tree to each query of a batch."""

    def __init__(self, tree: Tree, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        self.tree, self.queries, self.own, self.k, self.factor = tree, queries, own, k, factor
        self.place = np.empty(len(tree.ids), np.int64)  # by id, unknown ones last
        self.place[np.lexsort((tree.ids, ~tree.known))] = np.arange(len(tree.ids))
        self.best = np.full((len(queries), k), np.inf)
        self.row = np.full((len(queries), k), -1)
        self.first = np.full(len(queries), -1)
        if len(tree.ids) and len(queries):
            self._down(0, np.arange(len(queries)))
            self._visit(0, np.arange(len(queries)))

    def _meet(self, rows: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Take up rows that are nearer than what the queries have; returns the distances."""
        away = distances(self.queries[who], self.tree.points[rows])
        met = np.where(self.tree.known[rows] & (self.tree.ids[rows] == self.own[who][:, None]), np.inf, away)
        near = (met <= self.best[who, -1:]).any(axis=1)
        if near.any():
            some = who[near]
            cand = np.concatenate([self.best[some], met[near]], axis=1)
            row = np.concatenate([self.row[some], np.broadcast_to(rows, (len(some), len(rows)))], axis=1)
            order = np.lexsort((np.where(row < 0, len(self.place), self.place[row]), cand), axis=-1)[:, : self.k]
            self.best[some], self.row[some] = np.take_along_axis(cand, order, 1), np.take_along_axis(row, order, 1)
        return away

    def _to_vantage(self, node: np.void, who: np.ndarray) -> np.ndarray:
        return distances(self.queries[who], self.tree.points[node["lo"] : node["lo"] + 1])[:, 0]

    def _down(self, at: int, who: np.ndarray) -> None:
        node = self.tree.nodes[at]
        if node["left"] < 0:
            self._meet(np.arange(node["lo"], node["hi"]), who)
            self.first[who] = at
            return
        left = 2 * self._to_vantage(node, who) <= node["most"][0] + node["least"][1]
        for child, some in ((node["left"], who[left]), (node["right"], who[~left])):
            if len(some):
                self._down(int(child), some)

    def _visit(self, at: int, who: np.ndarray) -> None:
        node = self.tree.nodes[at]
        if node["left"] < 0:
            who = who[self.first[who] != at]
            if len(who):
                self._meet(np.arange(node["lo"], node["hi"]), who)
            return
        away = self._meet(np.arange(node["lo"], node["lo"] + 1), who)[:, 0]
        for n, child in enumerate((node["left"], node["right"])):
            gap = np.maximum(away - node["most"][n], node["least"][n] - away)
            some = who[gap * self.factor <= self.best[who, -1] * (1 + SLACK)]
            if len(some):
                self._visit(int(child), some)


def _by_dim(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, list]]:
    """Rows of equal length as one matrix with their ids, at most ``limit`` at once."""
    held: dict[int, list] = {}
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).tolist()
        for n, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
            rows = held.setdefault(end - start, [])
            rows.append((batch.column(0)[n].as_py(), flat[start:end]))
            if len(rows) == limit:
                yield np.array([r[1] for r in rows]), [r[0] for r in rows]
                held[end - start] = []
    for rows in held.values():
        if rows:
            yield np.array([r[1] for r in rows]), [r[0] for r in rows]


def _packed(number: int, points: np.ndarray, ids: list, names: list[str], *more: bytes) -> pa.RecordBatch:
    """A row with a matrix, in single precision if that loses nothing."""
    short = points.astype(np.float32)
    kind = short if np.array_equal(short, points) else points
    columns = [
        pa.array([number], pa.int64()),
        pa.array([points.shape[1]], pa.int32()),
        pa.array([ids], pa.list_(pa.int64())),
        pa.array([kind.dtype.str]),
        *[pa.array([b], pa.binary()) for b in (kind.tobytes(), *more)],
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _plant(limit: int, leaf_rows: int):
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for points, ids in _by_dim(batches, limit):
            order, nodes = build(points, leaf_rows, base + n)
            names = ["shard", "dim", "ids", "kind", "points", "nodes"]
            yield _packed(base + n, points[order], [ids[r] for r in order], names, nodes.tobytes())
            n += 1

    return plant


def _gather(limit: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for points, ids in _by_dim(batches, limit):
            yield _packed(base + n, points, ids, ["batch", "dim", "ids", "kind", "points"])
            n += 1

    return gather


def _matrix(batch: pa.RecordBatch, row: int) -> np.ndarray:
    flat = np.frombuffer(batch.column("points")[row].as_buffer(), batch.column("kind")[row].as_py())
    return flat.reshape(-1, batch.column("dim")[row].as_py()).astype(np.float64)


def _search(k: int, factor: float):
    """Rows of a task come by shard, its tree before the queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].as_py()
                if batch.column("nodes")[row].is_valid:
                    known = np.array([i is not None for i in ids], bool)
                    numbers = np.array([i if i is not None else 0 for i in ids], np.int64)
                    tree = Tree(_matrix(batch, row), numbers, known, np.frombuffer(batch.column("nodes")[row].as_buffer(), NODE))
                    continue
                queries = _matrix(batch, row)
                if queries.shape[1] != tree.points.shape[1]:
                    continue
                own = np.array(ids, np.int64)
                found = Search(tree, queries, own, k, factor)
                query, rank = np.nonzero(np.isfinite(found.best))
                at = found.row[query, rank]
                columns = [pa.array(own[query]), pa.array(tree.ids[at], mask=~tree.known[at]), pa.array(found.best[query, rank])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return search


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    factor: float = FACTOR,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: rows of ``vectors`` found nearest to each query, nearest first.

    Scores are Euclidean distances in double precision.  A row with the query's
    own id is no candidate; equal distances go to the smaller id, null ids last.
    Vectors that are null, zero or hold a null or non-finite component take no
    part; rows of another length than the query's are no candidates for it.  A
    query id that occurs again counts once (its smallest vector), a repeated
    candidate as often as it occurs.  Fewer candidates than k give fewer rows.
    Every row is in a tree; a ``factor`` of one finds the exact neighbours.
    """
    if factor < 1:
        raise ValueError("factor must be at least one")
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    asked = usable(queries, vec_id, vector).filter("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    shards = max(1, -(-rows.count() // shard_rows))
    trees = materialize(rows.repartition(shards).mapInArrow(_plant(shard_rows, leaf_rows), TREES), "trees")
    tasks = max(1, -(-asked.count() // QUERY_ROWS))
    batches = materialize(asked.repartition(tasks).mapInArrow(_gather(QUERY_ROWS), BATCHES), "queries")
    # Every batch of queries meets every tree.  The meetings lie in a row, tree by tree; each task takes
    # as many that follow each other, so that a tree moves about once and a batch once per tree.
    numbered = lambda df, by, to: df.withColumn(to, F.row_number().over(Window.orderBy(by)).cast("bigint") - 1)
    tree_at, batch_at = (numbered(t.df.select(c), c, "at").alias(c) for t, c in ((trees, "shard"), (batches, "batch")))
    n_trees, n_batches = tree_at.count(), batch_at.count()
    if not n_trees or not n_batches:
        return spark.createDataFrame([], f"query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    parts = min(n_trees * n_batches, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    task = lambda meeting: F.floor(meeting * parts / F.lit(n_trees * n_batches)).cast("int")
    first, last = task(F.col("at") * n_batches), task((F.col("at") + 1) * n_batches - 1)
    sent = trees.df.join(tree_at, "shard").withColumn("part", F.explode(F.sequence(first, last)))
    asking = batches.df.join(batch_at.withColumnRenamed("at", "batch_at"), "batch")
    asking = asking.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)).cast("array<bigint>")))
    asking = asking.withColumn("part", task(F.col("at") * n_batches + F.col("batch_at"))).withColumn("nodes", F.lit(None).cast("binary"))
    columns = ["part", "at", "dim", "ids", "kind", "points", "nodes"]
    met = sent.select(*columns).unionByName(asking.select(*columns)).repartitionById(parts, F.col("part"))
    met = met.sortWithinPartitions("at", F.col("nodes").isNull())
    small_batches(spark, ROWS_AT_ONCE)
    hits = materialize(met.mapInArrow(_search(k, factor), HITS), "hits").df
    small_batches(spark, BATCH_ROWS)
    best = Window.partitionBy("query_id").orderBy("score", F.asc_nulls_last("vec_id"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
