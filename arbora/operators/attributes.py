"""Attributes: matching identifiers, merging files, roll-ups per person and category."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..functions.scalars import attribute_key, collate, key_category, label_or_id
from ..graph import Graph
from ..schema import ATTRIBUTE_RING_GAP, NODE_RADIUS, NODE_STROKE_WIDTH
from ..session import materialize, rows_of, scratch_path
from ..sources.attributes import as_keyed
from ..sources.slots import Slots, slots_of
from .numbering import dense_index

ATTR_KEY = ["person_id", "category", "attr"]


def resolve_identifiers(graph: Graph, identifiers: DataFrame) -> DataFrame:
    """``identifier, person_id``: the person with that e-mail and the person with that id.

    The identifier is lower-cased and node ids are not, so ids with capitals
    only match through the e-mail.
    """
    asked = identifiers.select("identifier").distinct().withColumn("lowered", F.lower("identifier"))
    people = graph.index.filter("type = 'person'").select(F.col("id").alias("lowered"), F.col("id").alias("person_id"))
    mails = graph.email_index.withColumnRenamed("email", "lowered")
    return asked.join(people.unionByName(mails), "lowered").select("identifier", "person_id").distinct()


@dataclass(frozen=True)
class Matched:
    """``person_attr`` of one load, the entries nobody matched, and counts per category."""

    person_attr: DataFrame
    unmatched: DataFrame
    counts: DataFrame


def match_attributes(graph: Graph, entries: DataFrame, batch: Column | None = None) -> Matched:
    """Attach parsed entries to persons.

    If several identifiers of a file mean the same person, the one that came
    up last in the file wins, whatever the order of their lines.
    """
    known = resolve_identifiers(graph, entries)
    first = entries.groupBy("category", "identifier").agg(F.min("ord").alias("first_ord"))
    # every output below starts from the resolved identifiers
    owners = materialize(first.join(known, "identifier", "left"), "owners").df
    hits = owners.filter("person_id IS NOT NULL")
    place = F.struct("first_ord", "ord")
    person_attr = (
        entries.join(hits, ["identifier", "category"])
        .groupBy(*ATTR_KEY)
        .agg(F.max_by("value", "first_ord").alias("value"), F.min(place).alias("place"))
        .select(*ATTR_KEY, "value", (batch if batch is not None else F.lit(0).cast("bigint")).alias("batch"), "place.*")
    )
    missing = owners.filter("person_id IS NULL").select("category", "identifier")
    unmatched = entries.join(missing, ["category", "identifier"], "left_semi")
    per_identifier = owners.groupBy("category", "identifier").agg(F.count("person_id").alias("hits"))
    counts = per_identifier.groupBy("category").agg(
        F.count_if(F.col("hits") > 0).alias("matched"), F.count_if(F.col("hits") == 0).alias("unmatched")
    )
    return Matched(person_attr, unmatched, counts)


def merge_attributes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert per person, category and attribute: newest value, oldest position."""
    rank = F.struct("batch", "first_ord", "ord")
    return (
        old.unionByName(new)
        .groupBy(*ATTR_KEY)
        .agg(F.max_by("value", rank).alias("value"), F.min(rank).alias("rank"))
        .select(*ATTR_KEY, "value", "rank.*")
    )


def register_attribute_types(old: DataFrame, names: DataFrame) -> DataFrame:
    """``category, attr, ordinal, active``: new attributes are numbered after those the
    category had, by their place in the file; known ones keep their number and
    still take up a place."""
    placed = dense_index(names, ["ord", "attr"], ("category",), "place")
    before = old.groupBy("category").agg(F.count(F.lit(1)).alias("existing"))
    fresh = placed.join(old.select("category", "attr"), ["category", "attr"], "left_anti").join(
        before, "category", "left"
    )
    ordinal = (F.coalesce("existing", F.lit(0)) + F.col("place")).cast("bigint").alias("ordinal")
    return old.unionByName(fresh.select("category", "attr", ordinal, F.lit(True).alias("active")))


def register_loads(old: DataFrame, placed: DataFrame) -> DataFrame:
    """``register_attribute_types`` for several files at once.

    ``placed`` has ``category, attr, load, place``: the place of an attribute in
    each file that has it.  The result is that of registering the files one by
    one in ``load`` order.
    """
    fresh = placed.join(old.select("category", "attr"), ["category", "attr"], "left_anti")
    first = fresh.groupBy("category", "attr").agg(F.min(F.struct("load", "place")).alias("first"))
    first = first.select("category", "attr", "first.*")
    # one row per category and file
    brought = first.groupBy("category", "load").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("category").orderBy("load").rowsBetween(Window.unboundedPreceding, -1)
    before = brought.select("category", "load", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    existing = old.groupBy("category").agg(F.count(F.lit(1)).alias("existing"))
    ordinal = F.coalesce("existing", F.lit(0)) + F.col("before") + F.col("place")
    new = first.join(before, ["category", "load"]).join(existing, "category", "left")
    return old.unionByName(
        new.select("category", "attr", ordinal.cast("bigint").alias("ordinal"), F.lit(True).alias("active"))
    )


REGISTRY_FIELDS = (
    "category STRING, filename STRING, url STRING, format STRING, is_empty BOOLEAN, modified BOOLEAN"
)
TYPE_FIELDS = "category STRING, attr STRING, ordinal BIGINT, active BOOLEAN"


@dataclass(frozen=True)
class AttributeStore:
    """The tables of all loads; with ``slots``, ``person_attr`` lies in them and a load reads what it touches only."""

    person_attr: DataFrame
    types: DataFrame
    registry: DataFrame
    slots: Slots | None = None

    def merged(self, new: DataFrame, touched: list[int]) -> Slots:
        """``person_attr`` after a load whose categories lie in the slots ``touched``."""
        spark = new.sparkSession
        old = self.slots
        if old is None:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.person_attr.schema.fields)
            old = Slots(spark, schema, {}).append(self.person_attr, scratch_path(spark, "person_attr"))
        return old.upsert(new, merge_attributes, scratch_path(spark, "person_attr"), touched)


def _first_of(kind: DataType, value=None) -> Column:
    """``value``, or the smallest one that is not null, in a column type; in a struct it is the first field."""
    if isinstance(kind, StructType):
        first = [_first_of(f.dataType, value if n == 0 else None).alias(f.name) for n, f in enumerate(kind.fields)]
        return F.struct(*first).cast(kind)
    if value is None:
        value = {"string": "", "timestamp": datetime(1970, 1, 1, tzinfo=UTC)}.get(kind.typeName(), 0)
    return F.lit(value).cast(kind)


def add_attribute(
    store: AttributeStore, persons: DataFrame, category: str, attr: str, batch, value: str = "1"
) -> AttributeStore:
    """Give the persons an attribute by hand.

    The rows take the types of the store, whichever way it was filled: ``batch``
    is the load's number, and the position is the first one.  Registers an unknown attribute (without an ordinal), marks the category as
    modified and gives a new category a comma-separated source file.
    """
    new = persons.select(
        "person_id",
        F.lit(category).alias("category"),
        F.lit(attr).alias("attr"),
        F.lit(value).alias("value"),
        *[_first_of(store.person_attr.schema[c].dataType, v).alias(c) for c, v in (("batch", batch), ("first_ord", None), ("ord", None))],
    ).distinct()
    spark = persons.sparkSession
    typed = rows_of(spark, [(category, attr, None, True)], TYPE_FIELDS)
    source = rows_of(
        spark,
        [(category, f"{category}.txt", None, "comma", False, True)],
        REGISTRY_FIELDS,
    )
    types = store.types.unionByName(typed.join(store.types, ["category", "attr"], "left_anti"))
    marked = store.registry.withColumn("modified", F.col("modified") | (F.col("category") == category))
    registry = marked.unionByName(source.join(store.registry, "category", "left_anti"))
    if store.slots is None:
        return AttributeStore(merge_attributes(store.person_attr, new), types, registry)
    slots = store.merged(new, slots_of(spark, [category]))
    return AttributeStore(slots.df, types, registry, slots)


def toggle_attribute(types: DataFrame, category: str, attr: str) -> DataFrame:
    chosen = (F.col("category") == category) & (F.col("attr") == attr)
    return types.withColumn("active", F.col("active") != chosen)


def toggle_all_attributes(types: DataFrame) -> DataFrame:
    """All off if any is on, else all on."""
    any_on = not types.filter("active").isEmpty()
    return types.withColumn("active", F.lit(not any_on))


def toggle_category(types: DataFrame, category: str) -> DataFrame:
    """Off only if the whole category was on."""
    mine = F.col("category") == category
    all_on = types.filter(mine & ~F.col("active")).isEmpty()
    return types.withColumn("active", F.when(mine, F.lit(not all_on)).otherwise(F.col("active")))


def active_attributes(person_attr: DataFrame, types: DataFrame, hidden_categories: DataFrame | None = None) -> DataFrame:
    """Rows of ``person_attr`` that are switched on and not in a hidden category."""
    shown = person_attr.join(types.filter("active").select("category", "attr"), ["category", "attr"], "left_semi")
    if hidden_categories is not None:
        shown = shown.withColumn("shown_in", key_category(attribute_key(F.col("category"), F.col("attr"))))
        hidden = hidden_categories.select(F.col("category").alias("shown_in"))
        shown = shown.join(hidden, "shown_in", "left_anti").drop("shown_in")
    return shown


def outer_radius(count: Column, radius: float, stroke: float, gap: float) -> Column:
    rings = F.greatest(F.lit(0), count - 1)
    return F.lit(radius + stroke / 2) + rings * F.lit(gap + stroke)


def active_attributes_per_person(
    graph: Graph,
    person_attr: DataFrame,
    types: DataFrame,
    hidden_categories: DataFrame | None = None,
    radius: float = NODE_RADIUS,
    stroke: float = NODE_STROKE_WIDTH,
    gap: float = ATTRIBUTE_RING_GAP,
) -> DataFrame:
    """Number of shown attributes and ring size of every person.

    Without ``hidden_categories`` this is the older count.
    """
    counts = (
        active_attributes(person_attr, types, hidden_categories)
        .groupBy(F.col("person_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    people = graph.index.filter("type = 'person'").select("id")
    n = F.coalesce("n", F.lit(0))
    return people.join(counts, "id", "left").select(
        F.col("id").alias("person_id"),
        n.alias("active_count"),
        (n > 0).alias("has_attributes"),
        F.greatest(F.lit(0), n - 1).cast("bigint").alias("extra_rings"),
        outer_radius(n, radius, stroke, gap).alias("outer_radius"),
    )


def active_attribute_list(person_attr: DataFrame, types: DataFrame, hidden_categories: DataFrame | None = None) -> DataFrame:
    """The shown attributes, sorted by key within each person."""
    rows = active_attributes(person_attr, types, hidden_categories)
    key = attribute_key(F.col("category"), F.col("attr"))
    return rows.select("person_id", key.alias("key"), "value").orderBy("person_id", collate(F.col("key")), "key")


def attribute_legend(types: DataFrame, registry: DataFrame) -> DataFrame:
    """Legend rows by category and attribute; empty categories have a row without attribute."""
    named = as_keyed(types).select("category", "attr", "active")
    whole = named.groupBy("category").agg(F.bool_and("active").alias("all_active"))
    rows = named.join(whole, "category")
    empty = registry.filter("is_empty").select("category")
    return (
        rows.join(empty, "category", "full_outer")
        .select("category", "attr", "active", "all_active")
        .orderBy("category", collate(F.col("attr")), "attr")
    )


def person_category_flag(graph: Graph, person_attr: DataFrame, types: DataFrame) -> DataFrame:
    """The first attribute each person has in a category, for categories in use.

    Only pairs with an attribute are listed; a missing pair means "none".
    """
    used = as_keyed(types).select("category").distinct()
    mine = as_keyed(person_attr).join(used, "category", "left_semi")
    people = graph.index.filter("type = 'person'").select(F.col("id").alias("person_id"))
    mine = mine.join(people, "person_id", "left_semi")
    first = F.min_by("attr", F.struct("batch", "first_ord", "ord")).alias("first_attr")
    return mine.groupBy("person_id", "category").agg(first)


def label_visible(graph: Graph, mode: str, per_person: DataFrame) -> DataFrame:
    """Whether a node's label is drawn: all, only nodes with attributes, or none."""
    marked = per_person.filter("has_attributes").select(F.col("person_id").alias("id"), F.lit(True).alias("marked"))
    visible = {"all": F.lit(True), "attributes": F.coalesce("marked", F.lit(False)), "none": F.lit(False)}[mode]
    return graph.index.select("id").join(marked, "id", "left").select("id", visible.alias("label_visible"))


def person_detail(
    graph: Graph,
    person_attr: DataFrame,
    types: DataFrame,
    all_orgs: DataFrame,
    orgs_at_point: DataFrame,
    labels: DataFrame | None = None,
    variant: str = "live",
) -> DataFrame:
    """Lines of the detail view: ``person_id, section, rank, place, tie, text``.

    Sections are name, attribute, org_at_point and org; within a section lines
    go by ``rank``, ``place`` (attributes in the order they were set) and
    ``tie``.  The older variant shows e-mail and id, and attribute names
    without their category.
    """
    people = graph.index.filter("type = 'person'")
    own = people.select(F.col("id").alias("person_id"), label_or_id(F.col("label"), F.col("id")).alias("own"), "email")
    if labels is not None:
        own = own.join(labels.select(F.col("id").alias("person_id"), "display"), "person_id", "left")
        own = own.withColumn("own", F.coalesce("display", "own")).drop("display")

    def section(rows: DataFrame, name: str, rank: Column, tie: Column, text: Column, *more: Column) -> DataFrame:
        return rows.select(
            "person_id",
            F.lit(name).alias("section"),
            rank.cast("bigint").alias("rank"),
            tie.alias("tie"),
            text.alias("text"),
            *more,
        )

    zero, none = F.lit(0), F.lit("")
    suffix = F.when(F.col("value") != "1", F.concat(F.lit(": "), "value")).otherwise("")
    shown = active_attributes(person_attr, types).join(own.select("person_id"), "person_id", "left_semi")
    place = F.struct("batch", "first_ord", "ord").alias("place")
    parts = [section(own, "name", zero, none, F.col("own"))]
    if variant == "live":
        label = F.concat("category", F.lit(": "), "attr", suffix)
        parts.append(section(shown, "attribute", zero, none, label, place))
        parts.append(section(orgs_at_point, "org_at_point", -F.col("depth"), F.col("label"), F.col("label")))
        mine = all_orgs.join(own.select("person_id"), "person_id", "left_semi")
        parts.append(section(mine, "org", -F.col("depth"), F.col("org_id"), F.col("label")))
    else:
        mails = own.filter(F.coalesce(F.col("email"), F.lit("")) != "")
        parts.append(section(mails, "email", zero, none, F.col("email")))
        parts.append(section(own, "id", zero, none, F.col("person_id")))
        parts.append(section(shown, "attribute", zero, none, F.concat("attr", suffix), place))
        parts.append(section(orgs_at_point, "org", -F.col("depth"), F.col("label"), F.col("label")))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part, allowMissingColumns=True)
    return lines
