"""Breadth-first reachability over bucketed tables, for many roots in one loop.

Edges lie in buckets of their start, what a walk has reached in buckets of root
and vertex.  A level joins the frontier with the edges and leaves out what was
reached before; both tables are read bucket by bucket as they lie, and only the
frontier and its successors move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Bucketed, Stored, materialize

# A vertex with more out-edges than this is split over several join keys.
HUB_ROWS = 1_000_000
# Edges in a bucket, as a mean.
BUCKET_ROWS = 4_000_000
KEYS = ["root_id", "id"]


@dataclass(frozen=True)
class Edges:
    """Edge table ``v, w, ...`` plus the few vertices whose edges are split.

    ``hubs(v, slots)`` holds at most |edges| / hub size rows, or is None when
    no vertex is that large; edges then have no ``slot``.
    """

    df: DataFrame
    hubs: DataFrame | None
    buckets: int


def _buckets(spark: SparkSession, rows: int) -> int:
    """As many as shuffles have partitions, so that what meets a bucketed table moves once; more for large tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def prepare_edges(edges: DataFrame, name: str = "edges", hub_rows: int = HUB_ROWS) -> Edges:
    """Write the edges into buckets of their start; a hub's edges lie in several."""
    spark = edges.sparkSession
    rows = edges.count()
    hubs, keys = None, ["v"]
    if rows > hub_rows:
        degree = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub_rows)
        found = materialize(degree.select("v", F.ceil(F.col("n") / hub_rows).cast("int").alias("slots")), f"{name}-hubs")
        if found.rows:
            hubs, keys = found.df, ["v", "slot"]
            slots = F.coalesce("slots", F.lit(1))
            edges = edges.join(hubs, "v", "left").withColumn("slot", F.pmod(F.xxhash64("w"), slots).cast("int")).drop("slots")
    table = Bucketed(edges, name, keys, _buckets(spark, rows))
    table.add(edges.repartition(table.buckets, *keys))
    return Edges(table.df, hubs, table.buckets)


def follow(frontier: DataFrame, edges: Edges) -> DataFrame:
    """Join the frontier's ``id`` with the edges that start there."""
    starts = frontier.withColumnRenamed("id", "v")
    if edges.hubs is None:
        return starts.join(edges.df, "v")
    last = F.coalesce("slots", F.lit(1)) - 1
    spread = starts.join(edges.hubs, "v", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), last)))
    return spread.drop("slots").join(edges.df, ["v", "slot"]).drop("slot")


def next_level(frontier: DataFrame, edges: Edges, seen: DataFrame, admit: Column | None, carry: tuple[str, ...]) -> DataFrame:
    """What the frontier's edges reach and nothing reached before."""
    reached = follow(frontier, edges)
    if admit is not None:
        reached = reached.filter(admit)
    reached = reached.select("root_id", F.col("w").alias("id"), *carry).dropDuplicates(KEYS)
    return reached.join(seen.select(*KEYS), KEYS, "left_anti")


def frontier_closure(
    edges: Edges,
    seeds: DataFrame,
    max_depth: int | None = None,
    admit: Column | None = None,
    carry: tuple[str, ...] = (),
) -> Stored:
    """Shortest distance from each root: ``root_id, id, level`` plus ``carry``.

    ``seeds`` has ``root_id, id`` and the carried columns, which must depend on
    the root only.  ``admit`` filters edges by edge and carried columns.  Each
    level is one job; the loop ends when a level brings nothing new.
    """
    start = seeds.select(*KEYS, *carry).dropDuplicates(KEYS)
    seen = Bucketed(start, "reach", KEYS, edges.buckets, step="level")
    new = total = seen.add(start, 0)
    level = 0
    while new and (max_depth is None or level < max_depth):
        fresh = next_level(seen.at(level), edges, seen.df, admit, carry)
        level += 1
        new = seen.add(fresh, level)
        total += new
    return Stored(seen.df.select(*KEYS, *carry, "level"), total, seen.path)
