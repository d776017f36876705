"""Reading the three collections of an organisation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import id_of
from ..schema import LINK_FIELDS, ORG_FIELDS, PERSON_FIELDS

DOCUMENT = "persons ARRAY<VARIANT>, orgs ARRAY<VARIANT>, links ARRAY<VARIANT>"


def _field(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "string")


def _record_id(record: Column) -> Column:
    """Id as text; null for values a browser treats as empty (0, false, "")."""
    value = F.try_variant_get(record, "$.id", "variant")
    kind, text = F.schema_of_variant(value), value.cast("string")
    empty = ((kind == "BOOLEAN") & (text == "false")) | (
        (kind != "STRING") & F.coalesce(F.expr("try_cast(id_text AS DOUBLE)") == 0, F.lit(False))
    )
    return F.when(~empty & (text != ""), text)


def _records(document: DataFrame, name: str) -> DataFrame:
    items = F.coalesce(F.col(name), F.array().cast("array<variant>"))
    exploded = document.select(F.posexplode(items).alias("ord", "record"))
    return exploded.withColumn("ord", F.col("ord").cast("bigint")).withColumn(
        "id_text", F.try_variant_get("record", "$.id", "string")
    )


def read_graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One JSON object with ``persons``, ``orgs`` and ``links``; a missing array is empty.

    A single JSON object is parsed by a single task, so this form suits files
    of the size people edit.  Large graphs belong in ``read_graph_tables``.
    Unknown fields of a record stay available in ``props``.
    """
    document = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    record = F.col("record")
    flag = F.coalesce(F.try_variant_get(record, "$.isBasis", "boolean"), F.lit(False))
    persons = _records(document, "persons").select(
        _record_id(record).alias("id"),
        _field(record, "label").alias("label"),
        _field(record, "email").alias("email"),
        flag.alias("is_basis"),
        "ord",
        record.alias("props"),
    )
    orgs = _records(document, "orgs").select(
        _record_id(record).alias("id"), _field(record, "label").alias("label"), "ord", record.alias("props")
    )
    links = _records(document, "links").select(
        id_of(_field(record, "source")).alias("source"), id_of(_field(record, "target")).alias("target"), "ord"
    )
    return persons, orgs, links


def read_graph_tables(
    spark: SparkSession, persons: str, orgs: str, links: str, format: str = "parquet"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three splittable tables (parquet or JSON lines) that carry ``ord`` themselves."""

    def read(path: str, fields: str) -> DataFrame:
        return spark.read.format(format).schema(fields).load(path)

    raw = read(links, LINK_FIELDS)
    ends = raw.select(id_of(F.col("source")).alias("source"), id_of(F.col("target")).alias("target"), "ord")
    return read(persons, PERSON_FIELDS), read(orgs, ORG_FIELDS), ends


def write_graph_tables(persons: DataFrame, orgs: DataFrame, links: DataFrame, base: str, format: str = "parquet"):
    """Write the collections in the layout ``read_graph_tables`` reads."""
    for name, table in (("persons", persons), ("orgs", orgs), ("links", links)):
        table.write.format(format).save(f"{base}/{name}")
