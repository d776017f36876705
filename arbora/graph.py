"""The normalised graph that every traversal starts from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.closure import Edges, prepare_edges
from .operators.normalize import (
    email_index,
    node_index,
    normalize_links,
    normalize_nodes,
    org_child,
    org_parent,
    person_orgs,
)
from .session import materialize


@dataclass
class Graph:
    nodes: DataFrame
    index: DataFrame
    links: DataFrame
    org_parent: DataFrame
    email_index: DataFrame
    _edges: dict[str, Edges] = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def org_child(self) -> DataFrame:
        return org_child(self.links)

    @property
    def person_org(self) -> DataFrame:
        return person_orgs(self.links)

    @property
    def types(self) -> DataFrame:
        return self.index.select("id", "type")

    def edges(self, name: str) -> Edges:
        """Edge tables of the loops, written once per graph and reused."""
        if name not in self._edges:
            self._edges[name] = prepare_edges(self._edge_plan(name), name)
        return self._edges[name]

    def _edge_plan(self, name: str) -> DataFrame:
        if name == "reports":
            return self.links.filter("kind = 'pp'").selectExpr("source AS v", "target AS w")
        if name == "org_down":
            return self.org_child.selectExpr("parent AS v", "child AS w")
        if name in ("down", "up", "both"):
            return typed_edges(self.links, name)
        raise KeyError(name)


def typed_edges(links: DataFrame, mode: str) -> DataFrame:
    """Steps a walk may take: ``v, w, from_org``, where ``from_org`` marks steps
    that are only open to walks that began at an org.

    One pass over the links yields all steps of a link.
    """
    from_person, to_org = F.col("s_type") == "person", F.col("t_type") == "org"
    forward, backward = ("source", "target"), ("target", "source")
    down = [(forward, ~(from_person & to_org), False), (backward, from_person & to_org, True)]
    up = [(backward, ~to_org | (F.col("s_type") == "org"), False), (forward, from_person & to_org, False)]
    steps = {"down": down, "up": up, "both": down + up}[mode]
    options = F.array(
        *[
            F.when(allowed, F.struct(F.col(a).alias("v"), F.col(b).alias("w"), F.lit(org_only).alias("from_org")))
            for (a, b), allowed, org_only in steps
        ]
    )
    return links.select(F.inline(F.array_compact(options)))


def build_graph(persons: DataFrame, orgs: DataFrame, links: DataFrame) -> Graph:
    """Normalise the three collections and write the tables that queries reuse."""
    nodes = materialize(normalize_nodes(persons, orgs), "nodes").df
    index = materialize(node_index(nodes), "index").df
    clean = materialize(normalize_links(links, index), "links").df
    parents = materialize(org_parent(clean), "org_parent").df
    mails = materialize(email_index(nodes), "email_index").df
    return Graph(nodes, index, clean, parents, mails)
