"""Hidden branches: who hid what, and what is hidden at the moment."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import empty_like
from .traverse import report_subtree


@dataclass(frozen=True)
class Hidden:
    """``by_root(root_id, node_id)``, roots shown for now, and the global switch."""

    by_root: DataFrame
    shown_roots: DataFrame
    show_all: bool = False


def hide_subtree(graph: Graph, by_root: DataFrame, roots: DataFrame) -> DataFrame:
    """Hide everyone below the roots; the roots stay visible, empty branches are not recorded."""
    fresh = roots.select("root_id").join(by_root.select("root_id"), "root_id", "left_anti")
    below = report_subtree(graph, fresh).filter("id <> root_id")
    return by_root.unionByName(below.select("root_id", F.col("id").alias("node_id")))


def unhide_subtree(by_root: DataFrame, roots: DataFrame) -> DataFrame:
    return by_root.join(roots.select("root_id"), "root_id", "left_anti")


def toggle_temp_visible(shown_roots: DataFrame, by_root: DataFrame, roots: DataFrame) -> DataFrame:
    """Flip the given roots; only roots that hide something can be shown."""
    asked = roots.select("root_id").distinct().join(by_root.select("root_id"), "root_id", "left_semi")
    kept = shown_roots.join(asked, "root_id", "left_anti")
    return kept.unionByName(asked.join(shown_roots, "root_id", "left_anti"))


def toggle_hidden(graph: Graph, hidden: Hidden, roots: DataFrame) -> Hidden:
    """Hide the branches of the given roots, or bring back those that are hidden.

    A root that is brought back is no longer shown for now either.
    """
    back = roots.select("root_id").distinct().join(hidden.by_root, "root_id", "left_semi")
    away = roots.select("root_id").distinct().join(hidden.by_root, "root_id", "left_anti")
    kept = unhide_subtree(hidden.by_root, back)
    shown = hidden.shown_roots.join(back, "root_id", "left_anti")
    return replace(hidden, by_root=hide_subtree(graph, kept, away), shown_roots=shown)


def toggle_show_all(hidden: Hidden) -> Hidden:
    """Flip the global switch; switching it on forgets the roots shown one by one."""
    shown = hidden.shown_roots if hidden.show_all else empty_like(hidden.shown_roots)
    return replace(hidden, shown_roots=shown, show_all=not hidden.show_all)


def hidden_ids(hidden: Hidden) -> DataFrame:
    """Ids hidden by some root while no root that hides them is shown for now."""
    shown = hidden.shown_roots.select("root_id").distinct().withColumn("shown", F.lit(True))
    flagged = hidden.by_root.join(shown, "root_id", "left")
    any_shown = F.bool_or(F.coalesce("shown", F.lit(False))).alias("shown")
    ids = flagged.groupBy(F.col("node_id").alias("id")).agg(any_shown).filter("NOT shown").select("id")
    return ids.filter(F.lit(not hidden.show_all))


def is_hidden(nodes: DataFrame, hidden: Hidden) -> DataFrame:
    marks = hidden_ids(hidden).withColumn("hidden", F.lit(True))
    flag = F.coalesce("hidden", F.lit(False)).alias("hidden")
    return nodes.select("id").distinct().join(marks, "id", "left").select("id", flag)
