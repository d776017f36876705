"""Finding nodes by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TRIMMED, collate, label_or_id, trimmed
from ..graph import Graph
from ..schema import MAX_ROOTS, SEARCH_LIMIT, SEARCH_MIN_CHARS


def search_nodes(graph: Graph, term: str, labels: DataFrame | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first ``limit`` nodes whose shown label or id contains the term, by label.

    ``truncated`` tells that the limit was reached.  Terms below two characters
    find nothing.
    """
    wanted = term.lower().strip(TRIMMED)
    label = label_or_id(F.col("label"), F.col("id"))
    nodes = graph.index.select("id", "type", label.alias("label"), "ord")
    if labels is not None:
        shown = labels.select("id", "display")
        nodes = nodes.join(shown, "id", "left").withColumn("label", F.coalesce("display", "label")).drop("display")
    if len(wanted) < SEARCH_MIN_CHARS:
        nodes = nodes.filter(F.lit(False))
    hit = F.lower("label").contains(wanted) | F.lower("id").contains(wanted)
    first = nodes.filter(hit).orderBy("ord").limit(limit)
    # the window sees at most `limit` rows
    found = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return first.withColumn("truncated", found >= limit).orderBy(collate(F.col("label")), "ord")


def resolve_node(graph: Graph, texts: DataFrame) -> DataFrame:
    """``text, id``: by e-mail, else by id, else the first node with that label; id is null if none."""
    asked = texts.select("text").distinct().withColumn("term", F.lower(trimmed(F.lower("text"))))
    by_mail = graph.email_index.select(F.col("email").alias("term"), F.col("person_id").alias("mail_hit"))
    by_id = graph.index.select(F.col("id").alias("term"), F.col("id").alias("id_hit"))
    labelled = graph.index.select("id", "ord", F.lower(F.coalesce("label", F.lit(""))).alias("term"))
    wanted = labelled.join(asked.select("term").distinct(), "term", "left_semi")
    by_label = wanted.groupBy("term").agg(F.min_by("id", "ord").alias("label_hit"))
    found = asked.join(by_mail, "term", "left").join(by_id, "term", "left").join(by_label, "term", "left")
    hit = F.coalesce("mail_hit", "id_hit", "label_hit")
    return found.select("text", F.when(F.col("text") != "", hit).alias("id"))


def add_root(roots: list[str], node_id: str, limit: int = MAX_ROOTS) -> list[str]:
    """One more root for the next view, unless it is there or the list is full."""
    return roots if node_id in roots or len(roots) >= limit else [*roots, node_id]
