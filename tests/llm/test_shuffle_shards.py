"""Exact sizes, gapless slots, and the law of the drawn matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm.shuffle_shards import communication_matrix, hypergeometric, uniform_shards


def _check(df, n, shards):
    rows = df.collect()
    assert len(rows) == n
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("rows_per_run", [5, 1_000_000])
def test_sizes_and_slots(spark, rows_per_run):
    df = spark.range(503).repartition(7).select("id", F.lit("x").alias("Shard"), F.lit(None).cast("string").alias("shuffle_at"))
    placed = uniform_shards(df, 24, rows_per_run=rows_per_run)
    assert placed.columns == ["id", "shuffle_at", "shard", "slot"]
    _check(placed, 503, 24)
    assert placed.select("id").distinct().count() == 503


def test_equal_rows_nulls_and_no_rows(spark):
    _check(uniform_shards(spark.createDataFrame([(None,)] * 50, "a INT"), 4), 50, 4)
    _check(uniform_shards(spark.createDataFrame([(1,)], "a INT"), 24), 1, 24)
    assert uniform_shards(spark.createDataFrame([], "a INT"), 24).count() == 0


def test_same_seed_same_result(spark):
    df = spark.range(100).repartition(3, "id")
    a, b, c = (sorted(map(tuple, uniform_shards(df, 5, seed=s).collect())) for s in (1, 1, 2))
    assert a == b and a != c


def test_matrix_margins_and_law(spark):
    counts = spark.createDataFrame([(0, 7), (1, 3), (4, 5), (6, 0)], "part BIGINT, n BIGINT")
    for seed in range(4):
        got = communication_matrix(counts, F.lit([6.0, 5.0, 4.0]), 4, seed).orderBy("part").collect()
        matrix = np.array([r.row_counts for r in got])
        assert matrix.sum(axis=0).tolist() == [6, 5, 4] and matrix.sum(axis=1).tolist() == [7, 3, 5, 0]


def test_draws_follow_the_hypergeometric_law(spark):
    from math import comb

    n = 4000
    us = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"))
    k = hypergeometric(F.col("u"), F.lit(9.0), F.lit(6.0), F.lit(7.0))
    seen = {int(r.k): r["count"] for r in us.select(k.alias("k")).groupBy("k").count().collect()}
    for k in range(1, 8):
        assert abs(seen.get(k, 0) / n - comb(9, k) * comb(6, 7 - k) / comb(15, 7)) < 0.001
    wide = us.select(hypergeometric(F.col("u"), F.lit(4e5), F.lit(9.6e6), F.lit(1e5)).alias("k"))
    mean, sd = wide.agg(F.avg("k"), F.stddev("k")).first()
    assert abs(mean - 4000) < 1 and abs(sd - (1e5 * 0.04 * 0.96 * 9.9e6 / 1e7) ** 0.5) < 0.5
