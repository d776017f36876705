"""Stable stand-ins for names.

Numbers follow the order of first use, which is fixed to node order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import label_or_id, trimmed
from ..graph import Graph
from .numbering import dense_index
from .traverse import org_depth


def _folded(label: Column) -> Column:
    return trimmed(F.lower(label))


def pseudonymize_names(labels: DataFrame, names: DataFrame, variant: str = "live") -> DataFrame:
    """``label, pseudonym`` for ``labels(label, ord)``: names are dealt out in turn.

    The older variant treats labels that differ in case or outer blanks as one.
    """
    key = F.col("label") if variant == "live" else _folded(F.col("label"))
    keyed = labels.withColumn("key", key)
    first = keyed.groupBy("key").agg(F.min("ord").alias("ord"))
    dealt = dense_index(first, ["ord", "key"], name="k")
    # one aggregated row as a scalar: the size of the dictionary
    size = names.agg(F.count(F.lit(1)).alias("n")).scalar()
    slot = dealt.withColumn("idx", F.try_mod("k", size))
    mapped = slot.join(names, "idx", "left").select("key", "name")
    distinct = keyed.select("label", "key").distinct()
    return distinct.join(mapped, "key").select("label", F.coalesce("name", "label").alias("pseudonym"))


def pseudonymize_orgs(labels: DataFrame, orgs: DataFrame, variant: str = "live") -> DataFrame:
    """``label, pseudonym`` for ``labels(label, depth, ord)``; the first depth of a label counts.

    Each level deals out its own list; a level without a list uses that of
    level 0 but keeps its own count.  The older variant tells depths apart and
    returns ``label, depth, pseudonym``.
    """
    live = variant == "live"
    key = F.col("label") if live else _folded(F.col("label"))
    keyed = labels.withColumn("key", key)
    shown = ["label"] if live else ["label", "depth"]
    if live:
        first = keyed.groupBy("key").agg(F.min_by("depth", "ord").alias("depth"), F.min("ord").alias("ord"))
    else:
        first = keyed.groupBy("key", "depth").agg(F.min("ord").alias("ord"))
    dealt = dense_index(first, ["ord", "key"], ("depth",), "k")
    sizes = orgs.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.filter("level = 0").select("n").scalar()
    own = dealt.join(sizes, dealt["depth"] == sizes["level"], "left")
    listed = own.select(
        "key",
        "depth",
        F.coalesce("level", F.lit(0)).alias("level"),
        F.try_mod("k", F.coalesce(F.col("n"), base)).alias("idx"),
    )
    mapped = listed.join(orgs, ["level", "idx"], "left").select("key", "depth", "name")
    on = ["key"] if live else ["key", "depth"]
    distinct = keyed.select(*shown, "key").distinct()
    mapped = mapped if not live else mapped.drop("depth")
    return distinct.join(mapped, on).select(*shown, F.coalesce("name", "label").alias("pseudonym"))


def display_label(
    graph: Graph,
    depth: DataFrame | None,
    dictionary: tuple[DataFrame, DataFrame] | None,
    enabled: bool = True,
    variant: str = "live",
) -> DataFrame:
    """``id, display``: the label or id, or its pseudonym when switched on.

    ``depth(id, depth)`` is the level of the orgs, computed if not given; orgs it
    does not list count as level 0.
    """
    nodes = graph.index.select("id", "type", label_or_id(F.col("label"), F.col("id")).alias("label"), "ord")
    if not enabled or dictionary is None:
        return nodes.select("id", F.col("label").alias("display"))
    names, units = dictionary
    depth = org_depth(graph) if depth is None else depth
    people, orgs = nodes.filter("type = 'person'"), nodes.filter("type = 'org'")
    levels = orgs.join(depth, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    per_name = pseudonymize_names(people, names, variant)
    per_unit = pseudonymize_orgs(levels, units, variant)
    on = ["label"] if variant == "live" else ["label", "depth"]
    shown = people.join(per_name, "label").unionByName(levels.join(per_unit, on).drop("depth"))
    return shown.select("id", F.col("pseudonym").alias("display"))
