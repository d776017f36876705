"""Org tree, hull switches, hidden branches and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import label_or_id, trimmed
from ..graph import Graph
from ..session import empty_like, materialize, read_stored
from .subgraph import Subgraph
from .traverse import org_descendants
from .visibility import Hidden

PATH_SEPARATOR = "\u0001"


def org_legend(
    graph: Graph, allowed: DataFrame, hull_visible: DataFrame, labels: DataFrame | None = None
) -> DataFrame:
    """The tree of allowed orgs: ``org_id, label, depth, path, has_children, visible``.

    Orgs without an allowed parent are roots.  An org with several allowed
    parents shows up under each of them, so a row is a path; a path never
    enters the same org twice.
    """
    spark = graph.spark
    ids = materialize(allowed.select("org_id").distinct(), "allowed").df
    child = graph.org_child.join(ids.withColumnRenamed("org_id", "child"), "child", "left_semi")
    child = materialize(child.join(ids.withColumnRenamed("org_id", "parent"), "parent", "left_semi"), "tree").df
    parent = graph.org_parent.join(ids.withColumnRenamed("org_id", "parent"), "parent", "left_semi")
    roots = ids.join(parent.select(F.col("child").alias("org_id")), "org_id", "left_anti")
    level = materialize(
        roots.select("org_id", F.array("org_id").alias("path"), F.lit(0).cast("bigint").alias("depth")), "legend"
    )
    paths = [level.path]
    while level.rows:
        below = level.df.withColumnRenamed("org_id", "parent").join(child, "parent")
        fresh = below.filter(~F.array_contains("path", F.col("child")))
        level = materialize(
            fresh.select(
                F.col("child").alias("org_id"),
                F.concat("path", F.array("child")).alias("path"),
                (F.col("depth") + 1).alias("depth"),
            ),
            "legend",
        )
        paths.append(level.path)
    rows = read_stored(spark, level, paths)
    names = graph.index.select(F.col("id").alias("org_id"), label_or_id(F.col("label"), F.col("id")).alias("label"))
    if labels is not None:
        names = labels.select(F.col("id").alias("org_id"), F.col("display").alias("label"))
    inner = child.select(F.col("parent").alias("org_id")).distinct().withColumn("has_children", F.lit(True))
    shown = hull_visible.select("org_id").distinct().withColumn("visible", F.lit(True))
    return (
        rows.join(names, "org_id", "left")
        .join(inner, "org_id", "left")
        .join(shown, "org_id", "left")
        .select(
            "org_id",
            "label",
            "depth",
            F.array_join("path", PATH_SEPARATOR).alias("path"),
            F.coalesce("has_children", F.lit(False)).alias("has_children"),
            F.coalesce("visible", F.lit(False)).alias("visible"),
        )
        .orderBy("path")
    )


def org_legend_filter(legend: DataFrame, term: str) -> DataFrame:
    """Rows whose label contains the term, and the rows above them; all rows if the term is empty."""
    wanted = trimmed(F.lower(F.lit(term)))
    hits = legend.filter(F.lower("label").contains(wanted))
    parts = F.split("path", PATH_SEPARATOR)
    lengths = F.sequence(F.lit(1), F.size(parts))
    prefixes = F.transform(lengths, lambda n: F.array_join(F.slice(parts, 1, n), PATH_SEPARATOR))
    return legend.join(hits.select(F.explode(prefixes).alias("path")).distinct(), "path", "left_semi")


def toggle_all_hulls(hull_visible: DataFrame, allowed: DataFrame) -> DataFrame:
    """None if any is shown, else all allowed ones."""
    ids = allowed.select("org_id").distinct()
    return ids if hull_visible.isEmpty() else empty_like(ids)


def toggle_hull(hull_visible: DataFrame, orgs: DataFrame) -> DataFrame:
    on = hull_visible.join(orgs, "org_id", "left_anti").select("org_id")
    return on.unionByName(orgs.select("org_id").join(hull_visible, "org_id", "left_anti")).distinct()


def restore_hulls(saved: DataFrame | None, allowed: DataFrame) -> DataFrame:
    """Switch hulls back on: the saved set, or all allowed ones if nothing was saved."""
    if saved is None or saved.isEmpty():
        return allowed.select("org_id").distinct()
    return saved.select("org_id").distinct()


def _subtree(graph: Graph, roots: DataFrame) -> DataFrame:
    reach = org_descendants(graph, roots.select(F.col("org_id").alias("root_id")))
    return reach.select(F.col("id").alias("org_id")).distinct()


def show_hull_subtree(graph: Graph, hull_visible: DataFrame, roots: DataFrame) -> DataFrame:
    return hull_visible.select("org_id").union(_subtree(graph, roots)).distinct()


def hide_hull_subtree(graph: Graph, hull_visible: DataFrame, roots: DataFrame) -> DataFrame:
    return hull_visible.select("org_id").join(_subtree(graph, roots), "org_id", "left_anti")


def only_direct_children(graph: Graph, hull_visible: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the subtrees only the roots and their direct children stay shown."""
    ids = roots.select("org_id")
    direct = graph.org_child.join(ids.withColumnRenamed("org_id", "parent"), "parent", "left_semi")
    kept = hide_hull_subtree(graph, hull_visible, roots)
    return kept.union(ids).union(direct.select("child")).distinct()


def hidden_legend(graph: Graph, hidden: Hidden, labels: DataFrame | None = None) -> DataFrame:
    """``root_id, label, size, visible`` per hiding root; overlaps count in each."""
    size = hidden.by_root.groupBy("root_id").agg(F.count(F.lit(1)).alias("size"))
    names = graph.index.select(F.col("id").alias("root_id"), label_or_id(F.col("label"), F.col("id")).alias("label"))
    if labels is not None:
        names = labels.select(F.col("id").alias("root_id"), F.col("display").alias("label"))
    shown = hidden.shown_roots.select("root_id").distinct().withColumn("shown", F.lit(True))
    visible = F.coalesce("shown", F.lit(False)) | F.lit(hidden.show_all)
    return (
        size.join(names, "root_id", "left")
        .join(shown, "root_id", "left")
        .select("root_id", F.coalesce("label", F.lit("")).alias("label"), "size", visible.alias("visible"))
    )


def hidden_totals(hidden: Hidden, hidden_count: DataFrame) -> DataFrame:
    """One row: nodes dropped at present and the sum of all hidden sets."""
    current = hidden_count.agg(F.coalesce(F.sum("hidden_count"), F.lit(0)).alias("current"))
    return _one_row([current, hidden.by_root.agg(F.count(F.lit(1)).alias("total"))])


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Single rows with different columns side by side, without a join."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(name).alias(name) for name in rows.columns])


def graph_stats(graph: Graph, merged: Subgraph, types: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row of key figures.  Node totals count repeated records; visible counts
    come with orgs and, as ``drawn``, for persons only."""
    each = F.count(F.lit(1))
    return _one_row(
        [
            graph.nodes.agg(each.alias("nodes_total")),
            graph.links.agg(each.alias("links_total")),
            merged.nodes.agg(
                each.alias("nodes_visible"), F.count_if(F.col("type") == "person").alias("persons_drawn")
            ),
            merged.links.agg(each.alias("links_visible"), F.count_if(F.col("kind") == "pp").alias("links_drawn")),
            types.agg(F.count_if("active").alias("attributes_active"), each.alias("attributes_total")),
            allowed.agg(each.alias("allowed_orgs")),
        ]
    )
