"""Cleaning of the raw collections and the lookup tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_text
from ..schema import ORG_ORD_BASE
from ..session import empty_like


def normalize_nodes(persons: DataFrame, orgs: DataFrame) -> DataFrame:
    """Tagged person and org records; records without an id are dropped."""
    people = persons.filter(has_text(F.col("id"))).withColumn("type", F.lit("person"))
    units = (
        orgs.filter(has_text(F.col("id")))
        .withColumn("type", F.lit("org"))
        .withColumn("ord", F.col("ord") + F.lit(ORG_ORD_BASE))
    )
    return people.unionByName(units, allowMissingColumns=True)


def node_index(nodes: DataFrame) -> DataFrame:
    """One row per id: the last record, at the position of the first."""
    record = [c for c in nodes.columns if c not in ("id", "ord")]
    return (
        nodes.groupBy("id")
        .agg(
            F.max_by(F.struct(*record), "ord").alias("record"),
            F.min("ord").alias("ord"),
            F.bool_or(F.col("type") == "person").alias("as_person"),
            F.bool_or(F.col("type") == "org").alias("as_org"),
        )
        .select("id", "record.*", "ord", "as_person", "as_org")
    )


def email_index(nodes: DataFrame) -> DataFrame:
    """Lower-cased e-mail to the last person that has it."""
    people = nodes.filter((F.col("type") == "person") & has_text(F.col("email")))
    return people.groupBy(F.lower("email").alias("email")).agg(F.max_by("id", "ord").alias("person_id"))


def normalize_links(links: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct links between known, different nodes, with the end types.

    Copies collapse before the joins, so a link repeated very often costs no
    more than a single one.
    """
    ends = links.select(
        F.coalesce("source", F.lit("null")).alias("source"), F.coalesce("target", F.lit("null")).alias("target"), "ord"
    )
    distinct = ends.filter("source <> target").groupBy("source", "target").agg(F.min("ord").alias("ord"))

    def end(prefix: str, column: str) -> DataFrame:
        return index.select(
            F.col("id").alias(column),
            F.col("type").alias(f"{prefix}_type"),
            F.col("as_person").alias(f"{prefix}_person"),
            F.col("as_org").alias(f"{prefix}_org"),
        )

    kind = F.concat(F.substring("s_type", 1, 1), F.substring("t_type", 1, 1))
    return distinct.join(end("s", "source"), "source").join(end("t", "target"), "target").withColumn("kind", kind)


def org_links(links: DataFrame) -> DataFrame:
    return links.filter("s_org AND t_org")


def org_parent(links: DataFrame) -> DataFrame:
    """The parent of an org; the last link wins."""
    return (
        org_links(links)
        .groupBy(F.col("target").alias("child"))
        .agg(F.max_by("source", "ord").alias("parent"))
    )


def org_child(links: DataFrame) -> DataFrame:
    """Every parent-child pair, also those that lost in ``org_parent``."""
    return org_links(links).select(F.col("source").alias("parent"), F.col("target").alias("child"))


def org_roots(index: DataFrame, links: DataFrame) -> DataFrame:
    below = org_links(links).select(F.col("target").alias("id"))
    return index.filter("as_org").select("id").join(below, "id", "left_anti")


def person_orgs(links: DataFrame) -> DataFrame:
    """Direct memberships, one row per person and org."""
    return links.filter("s_person AND t_org").select(
        F.col("source").alias("person_id"), F.col("target").alias("org_id"), "ord"
    )


def attributes_survive(person_attr: DataFrame, index: DataFrame) -> bool:
    """Whether new data leaves the attributes: there are none, or one of their persons still exists."""
    people = index.filter("as_person").select(F.col("id").alias("person_id"))
    return not person_attr.join(people, "person_id", "left_semi").isEmpty() or person_attr.isEmpty()


def attributes_still_valid(person_attr: DataFrame, index: DataFrame) -> DataFrame:
    """After new data: all attributes stay if any of their persons still exists, else none."""
    return person_attr if attributes_survive(person_attr, index) else empty_like(person_attr)


def person_projection(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is drawn: person nodes and the links between them."""
    people = nodes.filter(F.col("type") == "person")
    ids = people.select("id")
    drawn = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    return people, drawn
