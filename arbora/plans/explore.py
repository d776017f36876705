"""The two things a session does again and again: look at a part of the graph, load attribute files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.attributes import (
    REGISTRY_FIELDS,
    TYPE_FIELDS,
    AttributeStore,
    match_attributes,
    register_loads,
)
from ..operators.numbering import dense_index
from ..operators.subgraph import Subgraph, compute_subgraph, merge_roots, scope_allowed_orgs
from ..operators.visibility import Hidden
from ..schema import ATTR_FIELDS
from ..session import materialize, rows_of
from ..sources.attributes import (
    attribute_names,
    category_of_file,
    category_registry,
    ignored_files,
    parse_attribute_lines,
    read_attribute_files,
)
from ..sources.slots import Slots, slot_of


@dataclass(frozen=True)
class View:
    """What a set of roots shows: the merged subgraph, its org scope and, if
    branches are hidden, how many nodes of each root that leaves out."""

    merged: Subgraph
    allowed: DataFrame
    hidden_count: DataFrame | None


def explore(
    graph: Graph,
    root_ids: list[str],
    depth: int = 2,
    mode: str = "both",
    management: bool = False,
    hidden: Hidden | None = None,
) -> View:
    roots = rows_of(graph.spark, [(i, n) for n, i in enumerate(root_ids)], "root_id STRING, root_ord BIGINT")
    sub = compute_subgraph(graph, roots, depth, mode, management, hidden)
    merged = merge_roots(graph, sub, roots)
    return View(merged, scope_allowed_orgs(graph, merged), sub.hidden_count)


def new_attribute_store(spark: SparkSession) -> AttributeStore:
    tables = (rows_of(spark, [], fields) for fields in (ATTR_FIELDS, TYPE_FIELDS, REGISTRY_FIELDS))
    return AttributeStore(*tables, Slots(spark, ATTR_FIELDS, {}))


@dataclass(frozen=True)
class Loaded:
    """The store after a load, per file the identifiers that matched or did not,
    and the files that no scan reads because of their names."""

    store: AttributeStore
    counts: DataFrame
    ignored: list[str]


def load_attribute_files(
    graph: Graph, store: AttributeStore, paths: str | list[str], batch: int, parts: str | None = None
) -> Loaded:
    """Read, match and merge attribute files in the order of the list, then of their names.

    Each file is a load of its own, and later ones win; ``batch`` must grow from
    call to call by at least the number of files.  Files whose names match
    ``parts`` are pieces of the folder they lie in.
    """
    lines, files = read_attribute_files(graph.spark, paths, parts)
    numbered = dense_index(files, ["place", "file"], name="at").select("file", (F.col("at") + F.lit(batch)).alias("batch"))
    named = materialize(numbered.withColumn("name", category_of_file(F.col("file"))), "files").df
    # the file is part of the category while files are matched, so they do not mix
    load = F.struct("name", "batch").alias("category")
    keyed = lines.join(named, "file").select(load, F.col("file").alias("url"), "ord", "line")
    entries = materialize(parse_attribute_lines(keyed), "entries").df
    matched = match_attributes(graph, entries, F.col("category.batch"))
    fresh = matched.person_attr.withColumn("category", F.col("category.name"))
    placed = dense_index(attribute_names(entries), ["ord", "attr"], ("category",), "place")
    placed = placed.select(F.col("category.name").alias("category"), "attr", F.col("category.batch").alias("load"), "place")
    listed = named.select(F.col("name").alias("category"), F.col("file").alias("url"), "batch")
    sources = category_registry(keyed.withColumn("category", F.col("category.name")), listed)
    kept = store.registry.join(sources.select("category"), "category", "left_anti")
    touched = [r.slot for r in named.select(slot_of(F.col("name")).alias("slot")).distinct().collect()]
    slots = store.merged(fresh, touched)
    merged = AttributeStore(
        slots.df,
        materialize(register_loads(store.types, placed), "types").df,
        materialize(kept.unionByName(sources), "registry").df,
        slots,
    )
    counts = matched.counts.select("category.*", "matched", "unmatched").withColumnRenamed("name", "category")
    return Loaded(merged, counts, ignored_files(graph.spark, paths))
