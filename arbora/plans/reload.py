"""A session's tables in one folder, replaced by new data in one step.

Every save writes new folders and then one state of the manifest that names the
folder of each table.  A reader sees the tables of one state; what a reload
keeps is named again, not written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph, build_graph
from ..operators.attributes import AttributeStore
from ..operators.normalize import attributes_survive
from ..operators.visibility import Hidden
from ..session import empty_like
from ..sources.slots import Manifest

GRAPH = ("nodes", "index", "links", "org_parent", "email_index")
ATTRIBUTES = ("person_attr", "types", "registry")
SWITCHES = ("hidden_by_root", "shown_roots", "allowed")


@dataclass(frozen=True)
class Session:
    """The graph, what is attached to its persons, what is hidden, and the orgs in scope (``org_id``)."""

    graph: Graph
    attributes: AttributeStore
    hidden: Hidden
    allowed: DataFrame

    @property
    def tables(self) -> dict[str, DataFrame]:
        graph = {name: getattr(self.graph, name) for name in GRAPH}
        attached = {name: getattr(self.attributes, name) for name in ATTRIBUTES}
        return graph | attached | dict(zip(SWITCHES, (self.hidden.by_root, self.hidden.shown_roots, self.allowed), strict=True))


def _write(manifest: Manifest, base: str, number: int, new: dict[str, DataFrame], kept: dict, show_all: bool) -> None:
    tables = dict(kept)
    for name, df in new.items():
        folder = f"v{number}/{name}"
        df.write.mode("overwrite").parquet(f"{base}/{folder}")
        tables[name] = [folder, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)]
    manifest.write(f"{number:012d}", {"number": number, "tables": tables, "show_all": show_all})


def save_session(session: Session, base: str) -> None:
    """Write all tables as the next state."""
    manifest = Manifest(session.graph.spark, base)
    number = manifest.read().get("number", -1) + 1
    _write(manifest, base, number, session.tables, {}, session.hidden.show_all)


def open_session(spark: SparkSession, base: str) -> Session:
    """The tables of the last state."""
    state = Manifest(spark, base).read()
    read = {name: spark.read.schema(schema).parquet(f"{base}/{folder}") for name, (folder, schema) in state["tables"].items()}
    graph = Graph(*(read[name] for name in GRAPH))
    by_root, shown, allowed = (read[name] for name in SWITCHES)
    return Session(graph, AttributeStore(*(read[name] for name in ATTRIBUTES)), Hidden(by_root, shown, state["show_all"]), allowed)


def reload(spark: SparkSession, base: str, persons: DataFrame, orgs: DataFrame, links: DataFrame) -> Session:
    """Replace the data of a saved session.

    The scope and what is hidden start empty; which roots are shown for now and
    the global switch stay.  Attributes, their names and switches and the category
    registry stay if one of the persons with attributes is still there, and are
    cleared together if none is.
    """
    manifest = Manifest(spark, base)
    state, before = manifest.read(), open_session(spark, base)
    graph = build_graph(persons, orgs, links)
    new = {name: getattr(graph, name) for name in GRAPH}
    new |= {"hidden_by_root": empty_like(before.hidden.by_root), "allowed": empty_like(before.allowed)}
    old = before.attributes
    if not attributes_survive(old.person_attr, graph.index):
        new |= {name: empty_like(getattr(old, name)) for name in ATTRIBUTES}
    kept = {name: place for name, place in state["tables"].items() if name not in new}
    _write(manifest, base, state["number"] + 1, new, kept, before.hidden.show_all)
    return open_session(spark, base)
