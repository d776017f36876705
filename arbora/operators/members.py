"""Rolling persons up into orgs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import collate
from ..graph import Graph
from .traverse import org_descendants


def primary_org(member: DataFrame, depth: DataFrame) -> DataFrame:
    """The deepest org of each person; the earlier membership wins a tie."""
    ranked = member.join(depth.select(F.col("id").alias("org_id"), "depth"), "org_id")
    return ranked.groupBy("person_id").agg(
        F.max_by("org_id", F.struct(F.col("depth"), -F.col("ord"))).alias("org_id"), F.max("depth").alias("depth")
    )


def cluster_memberships(graph: Graph, allowed: DataFrame, pos: DataFrame) -> DataFrame:
    """``root_id, person_id, org_id, ord, x, y``: one row per membership link and
    allowed org at or above the link's org; persons without a position are left out."""
    known = graph.index.filter("as_org").select(F.col("id").alias("root_id"))
    roots = allowed.select(F.col("org_id").alias("root_id")).distinct().join(known, "root_id", "left_semi")
    cover = org_descendants(graph, roots).select("root_id", F.col("id").alias("org_id"))
    placed = pos.filter("x IS NOT NULL AND y IS NOT NULL").select(F.col("id").alias("person_id"), "x", "y")
    # fan out to the orgs above last, when the rows carry all they need
    return graph.person_org.join(placed, "person_id").join(cover, "org_id").select(
        "root_id", "person_id", "org_id", "ord", "x", "y"
    )


def cluster_order(members: DataFrame, depth: DataFrame) -> DataFrame:
    """Orgs with members, outermost first."""
    orgs = members.select(F.col("root_id").alias("id")).distinct().join(depth, "id")
    return orgs.select(F.col("id").alias("org_id"), "depth").orderBy("depth", collate(F.col("org_id")), "org_id")
