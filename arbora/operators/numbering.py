"""Dense positions without pulling a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def dense_index(df: DataFrame, order: list[str | Column], group: tuple[str, ...] = (), name: str = "idx") -> DataFrame:
    """Add the zero-based position of each row within its group.

    Rows are range-partitioned by group and order, so a large group spans many
    partitions.  Each partition counts on its own and adds the number of rows
    its group has in earlier partitions; that table of sizes has one row per
    partition and group only.
    """
    placed = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    stored = materialize(placed, "placed").df
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    sizes = stored.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(group or (F.lit(0),))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        stored.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, ["_part", *group])
        .withColumn(name, (F.col("_at") + F.col("_before")).cast("bigint"))
        .drop("_part", "_at", "_before")
    )
