"""Pseudonym dictionary: person names and org names per level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL_KEY = r"^organizationalUnits(?:Level)?(\d+)$"


def read_pseudo_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``idx, name`` and ``level, idx, name`` from one JSON dictionary.

    Org entries are objects with a ``name``; plain strings work as well.
    """
    document = spark.read.schema("names ARRAY<STRING>").option("multiLine", True).json(path)
    names = document.select(F.posexplode("names").alias("idx", "name")).select(F.col("idx").cast("bigint"), "name")
    whole = spark.read.option("multiLine", True).option("singleVariantColumn", "doc").json(path)
    lists = whole.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select("key", "value")
    level = F.regexp_extract("key", LEVEL_KEY, 1)
    entries = lists.filter(level != "").select(level.cast("bigint").alias("level"), F.col("value").alias("list"))
    items = entries.lateralJoin(spark.tvf.variant_explode(F.col("list").outer()))
    name = F.coalesce(F.try_variant_get("value", "$.name", "string"), F.try_variant_get("value", "$", "string"))
    orgs = items.select("level", F.col("pos").cast("bigint").alias("idx"), name.alias("name"))
    return names, orgs
