"""Adjacency, hierarchy and typed walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import collate, label_or_id
from ..graph import Graph
from ..schema import UNREACHABLE_LEVEL
from ..session import materialize
from .closure import frontier_closure, prepare_edges
from .doubling import ancestor_pairs, ancestor_set, walk_lengths, walks


def out_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("source").alias("v"), F.col("target").alias("w")).distinct()


def in_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("target").alias("v"), F.col("source").alias("w")).distinct()


def undirected_edges(links: DataFrame) -> DataFrame:
    """Both directions of every link, without asking whether the ends exist."""
    there, back = F.struct(F.col("source").alias("v"), F.col("target").alias("w")), F.struct(
        F.col("target").alias("v"), F.col("source").alias("w")
    )
    return links.select(F.inline(F.array(there, back))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def manager_of(links: DataFrame) -> DataFrame:
    """The manager of a person; the last link wins."""
    return (
        links.filter("kind = 'pp'")
        .groupBy(F.col("target").alias("person_id"))
        .agg(F.max_by("source", "ord").alias("manager_id"))
    )


def org_depth(graph: Graph) -> DataFrame:
    """Steps on the parent walk of each org; a cycle counts each of its members once."""
    orgs = graph.index.filter("as_org").select("id")
    steps = walk_lengths(graph.org_parent)
    return orgs.join(steps, "id", "left").select("id", F.coalesce("steps", F.lit(0).cast("bigint")).alias("depth"))


def report_subtree(graph: Graph, roots: DataFrame) -> DataFrame:
    """``root_id, id, level`` of everyone below each root, the root included."""
    seeds = roots.select("root_id", F.col("root_id").alias("id"))
    return frontier_closure(graph.edges("reports"), seeds).df


def org_descendants(graph: Graph, roots: DataFrame, include_root: bool = True) -> DataFrame:
    seeds = roots.select("root_id", F.col("root_id").alias("id"))
    reach = frontier_closure(graph.edges("org_down"), seeds).df
    return reach if include_root else reach.filter("root_id <> id")


def org_ancestors(graph: Graph, orgs: DataFrame) -> DataFrame:
    """The given orgs (``org_id``) and all orgs on their parent walks, as one set."""
    return ancestor_set(graph.org_parent, orgs.select(F.col("org_id").alias("id"))).select(F.col("id").alias("org_id"))


def org_ancestor_pairs(graph: Graph, orgs: DataFrame) -> DataFrame:
    """``org_id, ancestor_id, step`` with the org itself at step 0."""
    pairs = ancestor_pairs(graph.org_parent, orgs.select(F.col("org_id").alias("id")))
    return pairs.select(F.col("id").alias("org_id"), F.col("ancestor").alias("ancestor_id"), "step")


def person_all_orgs(
    graph: Graph,
    depth: DataFrame,
    persons: DataFrame | None = None,
    labels: DataFrame | None = None,
    ordered: bool = True,
) -> DataFrame:
    """All orgs of a person, direct and above, deepest first.

    Orgs with the same label count once; the one met first stays.  ``labels``
    (``id, display``) replaces the shown label.  Without ``ordered`` the rows
    come unsorted, which saves a shuffle when another step follows.
    """
    member = graph.person_org
    if persons is not None:
        member = member.join(persons.select("person_id"), "person_id", "left_semi")
    chain = org_ancestor_pairs(graph, member.select("org_id").distinct())
    units = graph.index.filter("type = 'org'").select(
        F.col("id").alias("ancestor_id"), label_or_id(F.col("label"), F.col("id")).alias("label")
    )
    # the joins on orgs stay small; only the last one meets the membership rows
    named = chain.join(units, "ancestor_id")
    found = member.join(named, "org_id")
    first = found.groupBy("person_id", "label").agg(
        F.min_by("ancestor_id", F.struct(F.col("ord"), F.col("step"))).alias("org_id")
    )
    result = first.join(depth.select(F.col("id").alias("org_id"), "depth"), "org_id")
    if labels is not None:
        shown = labels.select(F.col("id").alias("org_id"), "display")
        result = result.join(shown, "org_id").withColumn("label", F.col("display")).drop("display")
    result = result.select("person_id", "org_id", "depth", "label")
    if not ordered:
        return result
    return result.orderBy("person_id", F.desc("depth"), collate(F.col("org_id")), "org_id")


def typed_bfs(graph: Graph, roots: DataFrame, depth: int, mode: str) -> DataFrame:
    """``root_id, id, level`` of the nodes within ``depth`` steps of each known root."""
    known = roots.select(F.col("root_id").alias("id")).distinct().join(graph.types, "id")
    seeds = known.select(F.col("id").alias("root_id"), "id", (F.col("type") == "org").alias("org_start"))
    admit = ~F.col("from_org") | F.col("org_start")
    reach = frontier_closure(graph.edges(mode), seeds, depth, admit, ("org_start",))
    return reach.df.drop("org_start")


def legend_orgs(graph: Graph, reach: DataFrame) -> DataFrame:
    """``root_id, org_id, level``: orgs of the reached persons that are not the
    direct parent of another org of the same person, with the nearest level.

    Every membership also marks the parent org for that person; an org with a
    mark is not the lowest.  That needs one grouping and no self join.
    """
    people = graph.types.filter("type = 'person'").select("id")
    reached = reach.join(people, "id", "left_semi").withColumnRenamed("id", "person_id")
    member = graph.person_org.select("person_id", "org_id")
    found = reached.join(member, "person_id").join(graph.org_parent.withColumnRenamed("child", "org_id"), "org_id", "left")
    own = F.struct(F.col("org_id").alias("org_id"), F.lit(False).alias("above"))
    over = F.struct(F.col("parent").alias("org_id"), F.lit(True).alias("above"))
    marks = F.inline(F.array_compact(F.array(own, F.when(F.col("parent") != F.col("org_id"), over))))
    return (
        found.select("root_id", "person_id", "level", marks)
        .groupBy("root_id", "person_id", "org_id")
        .agg(F.min("level").alias("level"), F.bool_or("above").alias("above"))
        .filter("NOT above")
        .groupBy("root_id", "org_id")
        .agg(F.min("level").alias("level"))
    )


def attach_level(graph: Graph, reach: DataFrame) -> DataFrame:
    return reach.join(graph.index.drop("as_person", "as_org"), "id")


def levels_from_roots(nodes: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Undirected distance from the nearest root inside the node set; 999 if none."""
    ids = nodes.select("id").distinct()
    inside = undirected_edges(links)
    inside = inside.join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    inside = inside.join(ids.withColumnRenamed("id", "w"), "w", "left_semi")
    seeds = roots.select(F.col("root_id").alias("id")).join(ids, "id", "left_semi")
    reach = frontier_closure(prepare_edges(inside, "inside"), seeds.select(F.lit("").alias("root_id"), "id"))
    level = F.coalesce("level", F.lit(UNREACHABLE_LEVEL).cast("bigint")).alias("level")
    return ids.join(reach.df.select("id", "level"), "id", "left").select("id", level)


def hierarchy_levels(graph: Graph, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Management level of persons, -1 for orgs; persons in a manager cycle get none."""
    ids = nodes.select("id").distinct()
    inside = links.filter("kind = 'pp'")
    inside = inside.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    inside = inside.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    managers = materialize(manager_of(inside), "managers").df
    typed = ids.join(graph.types, "id")
    people = typed.filter("type = 'person'").select("id")
    tops = people.join(managers.withColumnRenamed("person_id", "id"), "id", "left_anti")
    below = walks(managers.select(F.col("person_id").alias("child"), F.col("manager_id").alias("parent"))).rooted
    levels = tops.select("id", F.lit(0).cast("bigint").alias("level")).unionByName(below.select("id", F.col("steps").alias("level")))
    orgs = typed.filter("type = 'org'").select("id", F.lit(-1).cast("bigint").alias("level"))
    return levels.unionByName(orgs)
