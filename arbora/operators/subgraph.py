"""The visible part of the graph around one or more roots, and its changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import materialize, read_stored
from .traverse import attach_level, legend_orgs, levels_from_roots, org_ancestors, typed_bfs
from .visibility import Hidden, hidden_ids


@dataclass(frozen=True)
class Subgraph:
    """Tables keyed by ``root_id``; merged subgraphs have no ``root_id``."""

    nodes: DataFrame
    links: DataFrame
    legend: DataFrame
    hidden_count: DataFrame | None = None


def filter_hidden(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the ids of ``hidden_ids``."""
    return nodes.join(gone, "id", "left_anti")


def count_hidden(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """How many of a root's nodes the filter drops; roots that lose none count 0."""
    marks = gone.withColumn("hidden", F.lit(1))
    dropped = F.coalesce(F.sum("hidden"), F.lit(0)).alias("hidden_count")
    return nodes.join(marks, "id", "left").groupBy("root_id").agg(dropped)


def management_filter(
    graph: Graph, nodes: DataFrame, reach: DataFrame, mode: str, gone: DataFrame | None = None
) -> DataFrame:
    """Drop basis persons, then bring back the visible managers of those kept.

    Links are looked at once, in order, while the kept set grows.  A manager
    therefore joins at the first of its links that comes after its report
    joined.  ``pos`` is that position, -1 for nodes kept from the start; each
    round only follows nodes whose position became smaller.
    """
    keys = ["root_id", "id"]
    kept = materialize(nodes.filter("NOT coalesce(is_basis, false)"), "kept").df
    reports = graph.links.filter("kind = 'pp'").select(
        F.col("target").alias("report"), F.col("source").alias("manager"), "ord"
    )
    taken = kept.select(*keys)
    frontier = materialize(taken.withColumn("pos", F.lit(-1).cast("bigint")), "pos")
    paths: list[str] = []
    while frontier.rows:
        later = (
            frontier.df.withColumnRenamed("id", "report")
            .join(reports, "report")
            .filter("ord > pos")
            .groupBy("root_id", F.col("manager").alias("id"))
            .agg(F.min("ord").alias("pos"))
            .join(taken, keys, "left_anti")
        )
        if gone is not None:
            later = later.join(gone, "id", "left_anti")
        if mode == "down":
            later = later.join(reach.select(*keys), keys, "left_semi")
        if paths:
            added = read_stored(graph.spark, frontier, paths)
            known = added.groupBy(*keys).agg(F.min("pos").alias("known"))
            later = later.join(known, keys, "left").filter("known IS NULL OR pos < known").drop("known")
        frontier = materialize(later.select(*keys, "pos"), "pos")
        paths.append(frontier.path)
    if not paths:
        return kept
    added = read_stored(graph.spark, frontier, paths)
    levels = added.select(*keys).distinct().join(reach.select(*keys, "level"), keys, "left")
    returned = levels.withColumn("level", F.coalesce("level", F.lit(0).cast("bigint")))
    return kept.unionByName(attach_level(graph, returned).select(*kept.columns))


def induced_links(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Links of any kind with both ends among a root's nodes."""
    ids = nodes.select("root_id", "id")
    links = graph.links.select("source", "target", "ord", "kind")
    half = links.join(ids.withColumnRenamed("id", "source"), "source")
    return half.join(ids.withColumnRenamed("id", "target"), ["root_id", "target"], "left_semi").select(
        "root_id", "source", "target", "ord", "kind"
    )


def compute_subgraph(
    graph: Graph,
    roots: DataFrame,
    depth: int,
    mode: str,
    management: bool = False,
    hidden: Hidden | None = None,
) -> Subgraph:
    """Walk, legend, hidden filter, management filter and links, per root."""
    reach = typed_bfs(graph, roots, depth, mode)
    legend = legend_orgs(graph, reach)
    nodes = attach_level(graph, reach)
    dropped = gone = None
    if hidden is not None:
        gone = materialize(hidden_ids(hidden), "gone").df
        dropped = count_hidden(nodes, gone)
        nodes = filter_hidden(nodes, gone)
    if management:
        nodes = management_filter(graph, nodes, reach, mode, gone)
    nodes = materialize(nodes, "subgraph").df
    return Subgraph(nodes, induced_links(graph, nodes), legend, dropped)


def merge_roots(graph: Graph, sub: Subgraph, roots: DataFrame) -> Subgraph:
    """Union over the roots; a node keeps the level of the last root that has it."""
    order = roots.select("root_id", "root_ord")
    level = (
        sub.nodes.select("root_id", "id", "level")
        .join(order, "root_id")
        .groupBy("id")
        .agg(F.max_by("level", "root_ord").alias("level"))
    )
    links = sub.links.select("source", "target", "ord", "kind").distinct()
    nodes = materialize(attach_level(graph, level), "merged_nodes").df
    return Subgraph(nodes, materialize(links, "merged_links").df, sub.legend.select("org_id").distinct())


def scope_allowed_orgs(graph: Graph, merged: Subgraph) -> DataFrame:
    """Legend orgs and everything above them."""
    return org_ancestors(graph, merged.legend)


def subgraph_diff(old: Subgraph, new: Subgraph, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps from one merged subgraph to the next.

    Nodes: ``id, change, level, from_step, to_step``.  Removed nodes leave in
    batches from the outermost level of the old graph inwards, then added ones
    come from the innermost level of the new graph outwards.  ``from_step`` and
    ``to_step`` are the first and last step at which a node is shown (null:
    open).  Links are shown while both ends are.
    """
    before, after = old.nodes.select("id").distinct(), new.nodes.select("id").distinct()
    gone = levels_from_roots(old.nodes, roots, old.links).join(after, "id", "left_anti")
    come = levels_from_roots(new.nodes, roots, new.links).join(before, "id", "left_anti")
    changes = materialize(
        gone.withColumn("change", F.lit("removed")).unionByName(come.withColumn("change", F.lit("added"))), "changes"
    ).df
    # one row per level: a handful
    batches = changes.select("change", "level").distinct()
    turn = F.when(F.col("change") == "removed", -F.col("level")).otherwise(F.col("level"))
    batches = batches.withColumn(
        "step", F.row_number().over(Window.orderBy(F.desc("change"), turn)).cast("bigint")
    )
    placed = changes.join(batches, ["change", "level"])
    opened = F.when(F.col("change") == "added", F.col("step")).otherwise(0).cast("bigint").alias("from_step")
    closed = F.when(F.col("change") == "removed", F.col("step") - 1).cast("bigint").alias("to_step")
    kept = before.join(after, "id", "left_semi").select(
        "id",
        F.lit("kept").alias("change"),
        F.lit(None).cast("bigint").alias("level"),
        F.lit(0).cast("bigint").alias("from_step"),
        F.lit(None).cast("bigint").alias("to_step"),
    )
    nodes = materialize(placed.select("id", "change", "level", opened, closed).unionByName(kept), "steps").df
    span = nodes.select("id", "from_step", "to_step")
    links = old.links.select("source", "target").union(new.links.select("source", "target")).distinct()
    ends = links.join(span.toDF("source", "from_s", "to_s"), "source").join(
        span.toDF("target", "from_t", "to_t"), "target"
    )
    shown = ends.select(
        "source",
        "target",
        F.greatest("from_s", "from_t").alias("from_step"),
        F.least("to_s", "to_t").alias("to_step"),
    )
    return nodes, shown.filter("to_step IS NULL OR from_step <= to_step")
