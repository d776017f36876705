"""Every operator as a query over the warehouse graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..graph import build_graph
from ..operators import attributes, legend, members, normalize, pseudonym, search, spatial, subgraph, traverse, visibility
from ..schema import CLUSTER_PAD
from ..session import empty_like, rows_of, scratch_path
from ..sources import attributes as files
from ..sources.graph import read_graph_tables, write_graph_tables
from ..sources.slots import slots_of
from ..streaming.drops import ingest_attribute_drops, read_attribute_store, read_attribute_types, read_category_registry
from .explore import explore, load_attribute_files, new_attribute_store
from .reload import Session, reload, save_session
from .warehouse import HIDDEN_ROOTS, ROOT, Warehouse, ask, warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Second load of the orders category: the status is the value.
SECOND_LOAD = """
SELECT 'orders' AS category, o_orderkey AS ord,
       concat('c', o_custkey, ',', o_orderpriority, ',', o_orderstatus) AS line FROM {orders}
"""
# Texts to look up: mails, labels and ids in various spellings, and names nobody has.
TEXTS = """
SELECT concat(' ', upper(c_name), '@EXAMPLE.COM') AS text FROM {customer}
UNION ALL SELECT lower(s_name) FROM {supplier}
UNION ALL SELECT concat('N', n_nationkey) FROM {nation}
UNION ALL SELECT n_name FROM {nation}
UNION ALL SELECT p_name FROM {part}
"""
# Attributes a category had before its file is loaded.
EARLIER_TYPES = """
SELECT 'orders' AS category, o_orderstatus AS attr, min(o_orderkey) AS ord FROM {orders} GROUP BY o_orderstatus
UNION ALL SELECT 'orders', max(o_orderpriority), max(o_orderkey) FROM {orders}
"""


def query(fn: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(warehouse(spark, sf_dir))
    return fn


# --- sources and cleaning


@query
def read_graph(w: Warehouse) -> DataFrame:
    base = scratch_path(w.spark, "graph-json")
    write_graph_tables(*w.raw, base, "json")
    loaded = read_graph_tables(w.spark, f"{base}/persons", f"{base}/orgs", f"{base}/links", "json")
    graph = build_graph(*loaded)
    return graph.links.select("source", "target", "ord", "kind")


@query
def normalize_nodes(w: Warehouse) -> DataFrame:
    persons, orgs, _ = w.raw
    return normalize.normalize_nodes(persons, orgs)


@query
def node_index(w: Warehouse) -> DataFrame:
    persons, orgs, _ = w.raw
    return normalize.node_index(normalize.normalize_nodes(persons, orgs))


@query
def normalize_links(w: Warehouse) -> DataFrame:
    return normalize.normalize_links(w.raw[2], w.graph.index).select("source", "target", "ord", "kind")


@query
def email_index(w: Warehouse) -> DataFrame:
    return w.graph.email_index


@query
def org_parent(w: Warehouse) -> DataFrame:
    return normalize.org_parent(w.graph.links)


@query
def org_children(w: Warehouse) -> DataFrame:
    return w.graph.org_child


@query
def org_roots(w: Warehouse) -> DataFrame:
    return normalize.org_roots(w.graph.index, w.graph.links)


@query
def person_orgs(w: Warehouse) -> DataFrame:
    return w.graph.person_org


@query
def attributes_still_valid(w: Warehouse) -> DataFrame:
    kept = normalize.attributes_still_valid(w.person_attr, w.graph.index)
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def person_projection(w: Warehouse) -> DataFrame:
    _, links = normalize.person_projection(w.graph.index, w.graph.links)
    return links.select("source", "target")


def _reloaded(w: Warehouse, prefix: str) -> DataFrame:
    """Save the session, reload it with all person ids behind a prefix, count the rows of its tables."""
    base = scratch_path(w.spark, "session")
    store = attributes.AttributeStore(w.person_attr, w.types, w.registry)
    save_session(Session(w.graph, store, w.hidden, w.all_orgs), base)
    persons, orgs, links = w.raw
    renamed = persons.withColumn("id", F.when(F.col("id") == "", "").otherwise(F.concat(F.lit(prefix), "id")))
    tables = reload(w.spark, base, renamed, orgs, links).tables
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def reload_kept(w: Warehouse) -> DataFrame:
    """The same data again: attributes stay, what is hidden and the scope start empty."""
    return _reloaded(w, "")


@query
def reload_cleared(w: Warehouse) -> DataFrame:
    """Other persons: attributes, their names and the registry are cleared, and links to persons fall away."""
    return _reloaded(w, "other-")


# --- adjacency and hierarchy


@query
def adjacency_out(w: Warehouse) -> DataFrame:
    return traverse.out_edges(w.graph.links)


@query
def adjacency_in_degree(w: Warehouse) -> DataFrame:
    return traverse.degree(traverse.in_edges(w.graph.links))


@query
def manager_of(w: Warehouse) -> DataFrame:
    return traverse.manager_of(w.graph.links)


@query
def undirected_degree(w: Warehouse) -> DataFrame:
    return traverse.degree(traverse.undirected_edges(w.raw[2]))


@query
def org_depth(w: Warehouse) -> DataFrame:
    return traverse.org_depth(w.graph)


@query
def report_subtree(w: Warehouse) -> DataFrame:
    managers = w.graph.links.filter("kind = 'pp'").selectExpr("source AS root_id").distinct()
    return traverse.report_subtree(w.graph, managers).select("root_id", "id")


@query
def org_descendants(w: Warehouse) -> DataFrame:
    roots = w.all_orgs.withColumnRenamed("org_id", "root_id")
    return traverse.org_descendants(w.graph, roots).select("root_id", "id")


@query
def org_descendants_below(w: Warehouse) -> DataFrame:
    roots = w.all_orgs.withColumnRenamed("org_id", "root_id")
    return traverse.org_descendants(w.graph, roots, include_root=False).select("root_id", "id")


@query
def org_ancestors(w: Warehouse) -> DataFrame:
    return traverse.org_ancestor_pairs(w.graph, w.all_orgs)


@query
def person_all_orgs(w: Warehouse) -> DataFrame:
    return traverse.person_all_orgs(w.graph, w.depth)


def _bfs(mode: str, *roots: str):
    def run(w: Warehouse) -> DataFrame:
        return traverse.typed_bfs(w.graph, w.roots(*roots), 3, mode)

    return run


for _name, _mode, _roots in (
    ("typed_bfs_down", "down", (ROOT, "c0")),
    ("typed_bfs_up", "up", (ROOT, "c100")),
    ("typed_bfs_both", "both", (ROOT, "c100")),
    ("typed_bfs_org_start", "both", ("r1", "n3", "nobody")),
):
    _run = _bfs(_mode, *_roots)
    _run.__name__ = _name
    query(_run)


SUB_ROOTS = (ROOT, "c20", "n3")


@query
def legend_orgs(w: Warehouse) -> DataFrame:
    return traverse.legend_orgs(w.graph, traverse.typed_bfs(w.graph, w.roots(*SUB_ROOTS), 2, "both"))


def _subgraph(w: Warehouse, mode: str = "both", **options) -> subgraph.Subgraph:
    return subgraph.compute_subgraph(w.graph, w.roots(*SUB_ROOTS), 2, mode, **options)


NODE_COLUMNS = ("root_id", "id", "type", "label", "level")


@query
def subgraph_nodes(w: Warehouse) -> DataFrame:
    return _subgraph(w).nodes.select(*NODE_COLUMNS)


@query
def subgraph_links(w: Warehouse) -> DataFrame:
    return _subgraph(w).links.select("root_id", "source", "target")


@query
def subgraph_management(w: Warehouse) -> DataFrame:
    return _subgraph(w, management=True).nodes.select(*NODE_COLUMNS)


@query
def subgraph_management_down(w: Warehouse) -> DataFrame:
    return _subgraph(w, "down", management=True).nodes.select(*NODE_COLUMNS)


@query
def subgraph_hidden(w: Warehouse) -> DataFrame:
    return _subgraph(w, management=True, hidden=w.hidden).nodes.select(*NODE_COLUMNS)


@query
def hidden_count(w: Warehouse) -> DataFrame:
    return _subgraph(w, hidden=w.hidden).hidden_count


def _merged(w: Warehouse, depth: int, *roots: str) -> subgraph.Subgraph:
    table = w.roots(*roots)
    return subgraph.merge_roots(w.graph, subgraph.compute_subgraph(w.graph, table, depth, "both"), table)


@query
def multi_root_merge(w: Warehouse) -> DataFrame:
    return _merged(w, 2, *SUB_ROOTS).nodes.select("id", "type", "label", "level")


@query
def allowed_orgs(w: Warehouse) -> DataFrame:
    return explore(w.graph, list(SUB_ROOTS)).allowed


@query
def levels_from_roots(w: Warehouse) -> DataFrame:
    return traverse.levels_from_roots(w.graph.index, w.roots(ROOT, "w"), w.graph.links)


@query
def hierarchy_levels(w: Warehouse) -> DataFrame:
    return traverse.hierarchy_levels(w.graph, w.graph.index, w.graph.links)


def _diff(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    return subgraph.subgraph_diff(_merged(w, 2, ROOT), _merged(w, 3, "c20"), w.roots(ROOT, "c20"))


@query
def subgraph_diff(w: Warehouse) -> DataFrame:
    return _diff(w)[0]


@query
def subgraph_diff_links(w: Warehouse) -> DataFrame:
    return _diff(w)[1]


@query
def primary_org(w: Warehouse) -> DataFrame:
    return members.primary_org(w.graph.person_org, w.depth)


@query
def hide_subtree(w: Warehouse) -> DataFrame:
    none = rows_of(w.spark, [], "root_id STRING, node_id STRING")
    return visibility.hide_subtree(w.graph, none, w.roots(*HIDDEN_ROOTS))


@query
def unhide_subtree(w: Warehouse) -> DataFrame:
    return visibility.unhide_subtree(w.hidden.by_root, w.roots(ROOT))


@query
def toggle_temp_visible(w: Warehouse) -> DataFrame:
    hidden = w.hidden
    return visibility.toggle_temp_visible(hidden.shown_roots, hidden.by_root, w.roots("c1", "c2", "c3"))


@query
def is_hidden(w: Warehouse) -> DataFrame:
    return visibility.is_hidden(w.graph.index, w.hidden)


# --- clusters and hulls


@query
def cluster_memberships(w: Warehouse) -> DataFrame:
    rows = members.cluster_memberships(w.graph, w.all_orgs, w.positions)
    return rows.select("root_id", "person_id", "org_id", "x", "y")


@query
def cluster_order(w: Warehouse) -> DataFrame:
    return members.cluster_order(members.cluster_memberships(w.graph, w.all_orgs, w.positions), w.depth)


def _vertices(w: Warehouse) -> DataFrame:
    rows = lambda: spatial.hull_vertices(members.cluster_memberships(w.graph, w.all_orgs, w.positions))
    return w.stored("vertices", rows)


@query
def group_hull(w: Warehouse) -> DataFrame:
    corners = spatial.hull_vertices(members.cluster_memberships(w.graph, w.all_orgs, w.positions))
    return corners.select("root_id", "n", F.inline("points"))


@query
def group_hull_padded(w: Warehouse) -> DataFrame:
    polygon = spatial.padded_polygon(F.col("n"), F.col("points"), 12.0)
    flat = _vertices(w).select("root_id", F.inline(polygon))
    return flat.select("root_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _at_point(w: Warehouse, ordered: bool = False) -> DataFrame:
    polygon = spatial.padded_polygon(F.col("n"), F.col("points"), CLUSTER_PAD)
    hulls = _vertices(w).select("root_id", polygon.alias("polygon"))
    units = w.graph.index.selectExpr("id AS org_id", "label").join(
        w.depth.withColumnRenamed("id", "org_id"), "org_id"
    )
    return spatial.hulls_at_point(w.positions, hulls, w.all_orgs, units, ordered)


@query
def hulls_at_point(w: Warehouse) -> DataFrame:
    return _at_point(w, ordered=True)


# --- attributes


@query
def parse_attributes(w: Warehouse) -> DataFrame:
    return files.parse_attribute_lines(w.lines)


@query
def parse_attributes_strict(w: Warehouse) -> DataFrame:
    return files.parse_attribute_lines(w.lines, "strict")


@query
def line_counts(w: Warehouse) -> DataFrame:
    return files.line_counts(w.lines, w.files)


def _drop(w: Warehouse, lines: DataFrame, folder: str, name: str) -> None:
    """Write lines as ordered part files of one attribute file."""
    placed = lines.repartitionByRange("ord").sortWithinPartitions("ord")
    placed.select("line").write.text(f"{folder}/{name}")


CATEGORIES = {"segment": "segment.txt", "activity": "activity.tsv", "orders": "orders.csv", "planned": "planned.txt"}


@query
def load_attributes(w: Warehouse) -> DataFrame:
    """Load all files, a second orders file after them, then one attribute by hand for all persons with a segment."""
    folder = scratch_path(w.spark, "attrs")
    for category, name in CATEGORIES.items():
        _drop(w, w.lines.filter(F.col("category") == category), f"{folder}/first", name)
    _drop(w, w.ask(SECOND_LOAD), f"{folder}/second", "orders.csv")
    listed = [f"{folder}/first", f"{folder}/second"]
    loaded = load_attribute_files(w.graph, new_attribute_store(w.spark), listed, 0, files.SPARK_PARTS).store
    persons = loaded.person_attr.filter("category = 'segment'").select("person_id").distinct()
    return attributes.add_attribute(loaded, persons, "mark", "by hand", 1000).person_attr.select("person_id", "category", "attr", "value")


@query
def display_label_own_depth(w: Warehouse) -> DataFrame:
    return pseudonym.display_label(w.graph, None, w.dictionary)


@query
def read_attribute_files(w: Warehouse) -> DataFrame:
    folder = scratch_path(w.spark, "attrs")
    for category, name in CATEGORIES.items():
        _drop(w, w.lines.filter(F.col("category") == category), folder, name)
    lines, _ = files.read_attribute_files(w.spark, folder, files.SPARK_PARTS)
    named = lines.withColumn("category", files.category_from_path(F.col("file")))
    return files.parse_attribute_lines(named).select("category", "identifier", "attr", "value")


@query
def category_from_path(w: Warehouse) -> DataFrame:
    pages = ask(w.spark, w.dir, "SELECT page_id, url FROM {pages}")
    return pages.select(
        "page_id",
        files.category_from_path(F.col("url")).alias("category"),
        files.category_from_file_name(F.col("url")).alias("upload_category"),
    )


@query
def category_registry(w: Warehouse) -> DataFrame:
    return files.category_registry(w.lines, w.files)


@query
def empty_categories(w: Warehouse) -> DataFrame:
    return files.empty_categories(w.registry)


@query
def resolve_identifiers(w: Warehouse) -> DataFrame:
    return attributes.resolve_identifiers(w.graph, w.entries)


@query
def match_attributes(w: Warehouse) -> DataFrame:
    found = attributes.match_attributes(w.graph, w.entries).person_attr
    return found.select("person_id", "category", "attr", "value", "first_ord", "ord")


@query
def unmatched_identifiers(w: Warehouse) -> DataFrame:
    return attributes.match_attributes(w.graph, w.entries).unmatched.select("category", "identifier", "attr", "value")


@query
def match_counts(w: Warehouse) -> DataFrame:
    return attributes.match_attributes(w.graph, w.entries).counts


def _second_load(w: Warehouse) -> DataFrame:
    return files.parse_attribute_lines(w.ask(SECOND_LOAD))


@query
def merge_attributes(w: Warehouse) -> DataFrame:
    new = attributes.match_attributes(w.graph, _second_load(w), F.lit(1).cast("bigint")).person_attr
    store = attributes.AttributeStore(w.person_attr, w.types, w.registry, w.attr_slots)
    merged = store.merged(new, slots_of(w.spark, ["orders"]))
    return merged.df.select("person_id", "category", "attr", "value")


def _earlier_types(w: Warehouse) -> DataFrame:
    none = rows_of(w.spark, [], "category STRING, attr STRING, ordinal BIGINT, active BOOLEAN")
    return attributes.register_attribute_types(none, w.ask(EARLIER_TYPES))


@query
def attribute_types(w: Warehouse) -> DataFrame:
    return attributes.register_attribute_types(_earlier_types(w), files.attribute_names(w.entries))


@query
def add_attribute(w: Warehouse) -> DataFrame:
    """Persons without any activity get the attribute review::pending."""
    idle = w.graph.index.filter("type = 'person'").selectExpr("id AS person_id").join(
        w.person_attr.filter("category = 'activity'"), "person_id", "left_anti"
    )
    store = attributes.AttributeStore(w.person_attr, w.types, w.registry)
    done = attributes.add_attribute(store, idle, "review", "pending", 9)
    return done.person_attr.select("person_id", "category", "attr", "value")


@query
def add_attribute_registry(w: Warehouse) -> DataFrame:
    people = w.graph.index.filter("type = 'person'").selectExpr("id AS person_id")
    store = attributes.AttributeStore(w.person_attr, w.types, w.registry)
    store = attributes.add_attribute(store, people, "review", "pending", 9)
    store = attributes.add_attribute(store, people, "orders", "5-LOW", 10)
    return store.registry.select("category", "filename", "format", "is_empty", "modified")


def _some_types(w: Warehouse) -> DataFrame:
    return attributes.toggle_attribute(w.types, "activity", "error")


@query
def toggle_all_attributes(w: Warehouse) -> DataFrame:
    """All off, as some are on; then one on again."""
    return attributes.toggle_attribute(attributes.toggle_all_attributes(_some_types(w)), "activity", "error").select("category", "attr", "active")


@query
def toggle_category(w: Warehouse) -> DataFrame:
    """A partly active category goes fully on, a fully active one goes off."""
    types = attributes.toggle_category(attributes.toggle_category(_some_types(w), "activity"), "orders")
    return types.select("category", "attr", "active")


def _hidden_categories(w: Warehouse) -> DataFrame:
    return rows_of(w.spark, [("orders",)], "category STRING")


@query
def active_attributes_per_person(w: Warehouse) -> DataFrame:
    return attributes.active_attributes_per_person(w.graph, w.person_attr, _some_types(w), _hidden_categories(w))


@query
def active_attributes_all_categories(w: Warehouse) -> DataFrame:
    return attributes.active_attributes_per_person(w.graph, w.person_attr, _some_types(w))


@query
def active_attribute_list(w: Warehouse) -> DataFrame:
    return attributes.active_attribute_list(w.person_attr, _some_types(w), _hidden_categories(w))


@query
def attribute_legend(w: Warehouse) -> DataFrame:
    return attributes.attribute_legend(_some_types(w), w.registry)


@query
def person_category_flag(w: Warehouse) -> DataFrame:
    return attributes.person_category_flag(w.graph, w.person_attr, w.types)


def _detail(w: Warehouse, variant: str) -> DataFrame:
    all_orgs = traverse.person_all_orgs(w.graph, w.depth, ordered=False)
    here = _at_point(w).withColumnRenamed("id", "person_id")
    lines = attributes.person_detail(w.graph, w.person_attr, _some_types(w), all_orgs, here, variant=variant)
    return lines.select("person_id", "section", "rank", "text")


@query
def person_detail(w: Warehouse) -> DataFrame:
    return _detail(w, "live")


@query
def person_detail_old(w: Warehouse) -> DataFrame:
    return _detail(w, "old")


@query
def similarity(w: Warehouse) -> DataFrame:
    parts = w.ask("SELECT p_partkey, p_name, lower(p_type) AS kind FROM {part}")
    a, b = F.col("p_name"), F.col("kind")
    return parts.select(
        "p_partkey",
        scalars.edit_distance(a, b).cast("bigint").alias("distance"),
        scalars.similarity(a, b).alias("similarity"),
    )


@query
def label_visible(w: Warehouse) -> DataFrame:
    counts = attributes.active_attributes_per_person(w.graph, w.person_attr, _some_types(w), _hidden_categories(w))
    return attributes.label_visible(w.graph, "attributes", counts)


# --- search


@query
def search_nodes(w: Warehouse) -> DataFrame:
    return search.search_nodes(w.graph, " ER#000 ").select("id", "label", "truncated")


@query
def search_nodes_pseudonyms(w: Warehouse) -> DataFrame:
    labels = pseudonym.display_label(w.graph, w.depth, w.dictionary)
    return search.search_nodes(w.graph, "brand#1", labels).select("id", "label", "truncated")


@query
def resolve_node(w: Warehouse) -> DataFrame:
    return search.resolve_node(w.graph, w.ask(TEXTS))


# --- legends and key figures


def _regions(w: Warehouse) -> DataFrame:
    return w.ask("SELECT concat('r', r_regionkey) AS org_id FROM {region}")


def _legend(w: Warehouse) -> DataFrame:
    tree = legend.org_legend(w.graph, w.all_orgs, _regions(w))
    return tree


@query
def org_legend(w: Warehouse) -> DataFrame:
    return _legend(w).withColumn("path", F.translate("path", legend.PATH_SEPARATOR, ">"))


@query
def org_legend_filter(w: Warehouse) -> DataFrame:
    found = legend.org_legend_filter(_legend(w), " Nation_1")
    return found.select("org_id", "depth", F.translate("path", legend.PATH_SEPARATOR, ">").alias("path"))


@query
def hull_toggle_all(w: Warehouse) -> DataFrame:
    return legend.toggle_all_hulls(empty_like(_regions(w)), w.all_orgs)


@query
def hull_show_subtree(w: Warehouse) -> DataFrame:
    return legend.show_hull_subtree(w.graph, _regions(w), w.orgs("r1"))


@query
def hull_hide_subtree(w: Warehouse) -> DataFrame:
    return legend.hide_hull_subtree(w.graph, w.all_orgs, w.orgs("r1"))


@query
def hull_direct_children(w: Warehouse) -> DataFrame:
    return legend.only_direct_children(w.graph, w.all_orgs, w.orgs("r1"))


@query
def hidden_legend(w: Warehouse) -> DataFrame:
    return legend.hidden_legend(w.graph, w.hidden)


@query
def hidden_totals(w: Warehouse) -> DataFrame:
    return legend.hidden_totals(w.hidden, _subgraph(w, hidden=w.hidden).hidden_count)


@query
def graph_stats(w: Warehouse) -> DataFrame:
    view = explore(w.graph, list(SUB_ROOTS))
    return legend.graph_stats(w.graph, view.merged, _some_types(w), view.allowed)


# --- export


@query
def export_category(w: Warehouse) -> DataFrame:
    path = scratch_path(w.spark, "export")
    files.export_category(w.person_attr, w.graph.index, w.registry, "segment", path)
    return w.spark.read.text(path).withColumnRenamed("value", "line")


@query
def export_lines(w: Warehouse) -> DataFrame:
    return files.export_lines(w.person_attr, w.graph.index, w.registry)


@query
def export_category_tsv(w: Warehouse) -> DataFrame:
    path = files.export_category_tsv(w.person_attr, w.graph.index, "orders", scratch_path(w.spark, "tsv"))
    return w.spark.read.text(path).withColumnRenamed("value", "line")


# --- pseudonyms


def _labels(w: Warehouse, kind: str) -> DataFrame:
    return w.graph.index.filter(F.col("type") == kind).select("id", "label", "ord")


@query
def pseudonym_names(w: Warehouse) -> DataFrame:
    return pseudonym.pseudonymize_names(_labels(w, "person"), w.dictionary[0])


@query
def pseudonym_names_folded(w: Warehouse) -> DataFrame:
    return pseudonym.pseudonymize_names(_labels(w, "person"), w.dictionary[0], "old")


@query
def pseudonym_orgs(w: Warehouse) -> DataFrame:
    return pseudonym.pseudonymize_orgs(_labels(w, "org").join(w.depth, "id"), w.dictionary[1])


@query
def pseudonym_orgs_folded(w: Warehouse) -> DataFrame:
    return pseudonym.pseudonymize_orgs(_labels(w, "org").join(w.depth, "id"), w.dictionary[1], "old")


@query
def display_label(w: Warehouse) -> DataFrame:
    return pseudonym.display_label(w.graph, w.depth, w.dictionary)


# --- column functions


@query
def hash32(w: Warehouse) -> DataFrame:
    pages = ask(w.spark, w.dir, "SELECT page_id, url, html FROM {pages}")
    return pages.select(
        "page_id", scalars.hash32(F.col("url")).alias("url_hash"), scalars.hash32(F.col("html")).alias("html_hash")
    )


@query
def category_hue(w: Warehouse) -> DataFrame:
    label = F.col("label")
    return w.graph.index.select(
        "id", scalars.category_hue(label).alias("category_hue"), scalars.attribute_hue(label).alias("attribute_hue")
    )


@query
def org_colour_numbers(w: Warehouse) -> DataFrame:
    colour = scalars.org_colour(F.col("id"), F.col("depth"))
    return w.depth.select("id", F.inline(F.array(colour)), scalars.cluster_hue(F.col("id")).alias("cluster_hue"))


@query
def palette_slot(w: Warehouse) -> DataFrame:
    """Every palette, and the fallback, for every attribute type."""
    names = (*scalars.PALETTES, "gray", "none")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("palette"), scalars.palette_colour(F.col("ordinal"), name, F.col("category")).alias("c")
            )
            for name in names
        ]
    )
    return w.types.select("category", "attr", F.inline(rows)).select("category", "attr", "palette", "c.*")


@query
def level_band(w: Warehouse) -> DataFrame:
    levels = traverse.hierarchy_levels(w.graph, w.graph.index, w.graph.links)
    return levels.select("id", scalars.level_band(F.col("level")).alias("band"))


# --- stream


def _drops(w: Warehouse) -> str:
    """Drop all files, ingest, drop a second orders file, ingest again; the store."""
    folder, store = scratch_path(w.spark, "drops"), scratch_path(w.spark, "store")
    for category, name in (CATEGORIES | {"void": "void.txt"}).items():  # no line is in the last one
        _drop(w, w.lines.filter(F.col("category") == category), f"{folder}/first", name)
    ingest_attribute_drops(w.graph, folder, store, parts=files.SPARK_PARTS).awaitTermination()
    _drop(w, w.ask(SECOND_LOAD), f"{folder}/second", "orders.csv")
    ingest_attribute_drops(w.graph, folder, store, parts=files.SPARK_PARTS).awaitTermination()
    return store


@query
def attribute_stream(w: Warehouse) -> DataFrame:
    """All drops merged."""
    store = w._once("drops", lambda: _drops(w))
    return read_attribute_store(w.spark, store).select("person_id", "category", "attr", "value")


@query
def attribute_stream_types(w: Warehouse) -> DataFrame:
    """Attribute names as the drops register them."""
    return read_attribute_types(w.spark, w._once("drops", lambda: _drops(w)))


@query
def attribute_stream_registry(w: Warehouse) -> DataFrame:
    """Categories of the drops; the file without content has no line and is there."""
    registry = read_category_registry(w.spark, w._once("drops", lambda: _drops(w)))
    return registry.select("category", "filename", "format", "is_empty", "modified")
