"""Uniform shuffle into shards of exact size.

Each task permutes its rows at random.  How many rows a task sends to each
shard is drawn beforehand: the matrix of these counts follows the multivariate
hypergeometric law that a uniform permutation of all rows would give, with the
tasks' row counts and the shards' sizes as margins.  A row's shard then follows
from its position within its task alone.  After the exchange each shard permutes
what it received, so every arrangement is equally likely and every shard has
exactly its size.

Only narrow data decide: the matrix has one row per task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name

# Rows that one task permutes after the exchange; larger shards are cut into runs of slots.
ROWS_PER_RUN = 1_000_000
# Columns of the matrix at most, unless there are more shards; runs grow beyond that.
MOST_RUNS = 4096


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / F.lit(float(1 << 53))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _up(p: Column, k: Column, weight: Column) -> Column:
    """Weight of ``k + 1`` from the weight of ``k``; 0 past the largest possible count."""
    ways = F.greatest((p["good"] - k) * (p["n"] - k), F.lit(0.0))
    return weight * ways / ((k + 1) * F.greatest(p["bad"] - p["n"] + k + 1, F.lit(1.0)))


def _down(p: Column, k: Column, weight: Column) -> Column:
    ways = F.greatest(k * (p["bad"] - p["n"] + k), F.lit(0.0))
    return weight * ways / ((p["n"] - k + 1) * F.greatest(p["good"] - k + 1, F.lit(1.0)))


def _invert(p: Column) -> Column:
    """Sum the weights outwards from the mode, then stop where ``u`` of the sum is reached."""
    one = F.lit(1.0)
    spread = F.sqrt(p["n"] * p["good"] * p["bad"]) / F.greatest(p["good"] + p["bad"], one)
    # What lies beyond 12 deviations is below the resolution of u.
    steps = F.sequence(F.lit(1), F.least(p["n"], p["good"], F.ceil(spread * 12 + 60).cast("double")).cast("int") + 1)

    def add(acc: Column, i: Column) -> Column:
        pair = F.struct(_up(p, p["mode"] + i - 1, acc["r"]).alias("r"), _down(p, p["mode"] - i + 1, acc["l"]).alias("l"))
        return _let(pair, lambda w: F.struct(w["r"].alias("r"), w["l"].alias("l"), (acc["rest"] + w["r"] + w["l"]).alias("rest")))

    total = F.aggregate(steps, F.struct(one.alias("r"), one.alias("l"), one.alias("rest")), add)["rest"]

    def find(acc: Column, i: Column) -> Column:
        pair = F.struct(_up(p, p["mode"] + i - 1, acc["r"]).alias("r"), _down(p, p["mode"] - i + 1, acc["l"]).alias("l"))

        def stop(w: Column) -> Column:
            right = acc["rest"] - w["r"]
            k = F.when(acc["rest"] < 0, acc["k"]).when(right < 0, p["mode"] + i).when(right - w["l"] < 0, p["mode"] - i)
            rest = F.when(acc["rest"] < 0, acc["rest"]).when(right < 0, right).otherwise(right - w["l"])
            return F.struct(w["r"].alias("r"), w["l"].alias("l"), rest.alias("rest"), k.otherwise(acc["k"]).alias("k"))

        return _let(pair, stop)

    start = F.struct(one.alias("r"), one.alias("l"), (p["u"] * total - 1.0).alias("rest"), p["mode"].alias("k"))
    return F.aggregate(steps, start, find)["k"]


def hypergeometric(u: Column, good: Column, bad: Column, n: Column) -> Column:
    """How many of ``n`` rows drawn from ``good + bad`` are good, by inverting at ``u``.

    All arguments are doubles that hold whole numbers, ``n <= good + bad``.
    """
    given = F.struct(u.alias("u"), good.alias("good"), bad.alias("bad"), n.alias("n"))

    def with_mode(p: Column) -> Column:
        peak = F.floor((p["n"] + 1) * (p["good"] + 1) / (p["good"] + p["bad"] + 2)).cast("double")
        mode = F.greatest(F.lit(0.0), p["n"] - p["bad"], F.least(peak, p["n"], p["good"]))
        return _let(F.struct(*[p[c].alias(c) for c in ("u", "good", "bad", "n")], mode.alias("mode")), _invert)

    return _let(given, with_mode)


def multivariate(seed: int, node: Column, room: Column, n: Column) -> Column:
    """Draw ``n`` rows without replacement from groups of sizes ``room``: array of counts."""
    zero = F.struct(
        n.alias("n"),
        F.aggregate(room, F.lit(0.0), lambda a, x: a + x).alias("left"),
        F.array().cast("array<double>").alias("drawn"),
    )

    def one(acc: Column, size: Column) -> Column:
        u = _uniform(seed, node, F.size(acc["drawn"]))
        return _let(
            hypergeometric(u, size, acc["left"] - size, acc["n"]),
            lambda k: F.struct(
                (acc["n"] - k).alias("n"),
                (acc["left"] - size).alias("left"),
                F.concat(acc["drawn"], F.array(k)).alias("drawn"),
            ),
        )

    return F.aggregate(room, zero, one)["drawn"]


def communication_matrix(counts: DataFrame, sizes: Column, tasks: int, seed: int) -> DataFrame:
    """``part, row_counts``: for each task how many rows go to each run of slots.

    ``counts`` has ``part, n``; ``sizes`` is the array of run sizes, which add up
    to all rows.  The tasks are halved again and again: a half's share of every
    run is drawn given what its parent has, so rows and columns add up exactly.
    The list of task sizes is metadata, one number per task.
    """
    listed = F.array_sort(F.collect_list(F.struct("part", F.col("n").cast("double").alias("n"))))
    node = counts.agg(listed.alias("tasks")).select(F.lit(1).cast("bigint").alias("node"), "tasks", sizes.alias("room"))
    for level in range(math.ceil(math.log2(max(tasks, 2)))):
        half = F.ceil(F.size("tasks") / 2).cast("int")
        left = F.slice("tasks", F.lit(1), half)
        n = F.aggregate(left, F.lit(0.0), lambda a, x: a + x["n"])
        single = F.size("tasks") <= 1
        drawn = F.when(single, F.col("room")).otherwise(multivariate(seed, F.col("node"), F.col("room"), n))
        node = node.withColumn("drawn", drawn)
        first = F.struct((F.col("node") * 2).alias("node"), F.when(single, F.col("tasks")).otherwise(left).alias("tasks"), F.col("drawn").alias("room"))
        second = F.struct(
            (F.col("node") * 2 + 1).alias("node"),
            F.slice("tasks", half + 1, F.greatest(F.size("tasks") - half, F.lit(0))).alias("tasks"),
            F.zip_with("room", "drawn", lambda a, b: a - b).alias("room"),
        )
        node = node.select(F.inline(F.when(single, F.array(first)).otherwise(F.array(first, second))))
        if level % 6 == 5:
            node = node.repartition(min(tasks, 2 ** (level + 1)), "node")
    return node.filter(F.size("tasks") == 1).select(F.col("tasks")[0]["part"].alias("part"), F.col("room").alias("row_counts"))


def _run_at(ends: str, position: Column, runs: int) -> Column:
    """Number of runs that end at or before the position, by halving."""
    zero = F.struct(F.lit(0).alias("lo"), F.lit(runs).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        ended = F.get(F.col(ends), middle) <= position
        lo = F.when((acc["lo"] < acc["hi"]) & ended, middle + 1).otherwise(acc["lo"])
        hi = F.when((acc["lo"] < acc["hi"]) & ~ended, middle).otherwise(acc["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(runs.bit_length() + 1)), zero, halve)["lo"]


def uniform_shards(df: DataFrame, shards: int, seed: int = 0, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """All columns of ``df`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Shard sizes differ by at most one row; the first shards are the larger ones.
    Columns of ``df`` named shard or slot are replaced.  Equal rows, nulls and
    ties are rows like any other; copies are spread, not kept together.  No rows
    in, no rows out.  The assignment is drawn once and stored below
    ``spark.checkpoint.dir``, so a repeated task finds the same numbers.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("shard", "slot")
    own = [c for c in df.columns]
    at, after = free_name(df, "shuffle_at"), free_name(df, "shuffle_after")
    draw = F.rand(seed)
    local = df.withColumn(at, draw).withColumn(after, F.rand(seed + 1)).sortWithinPartitions(at)
    stored = materialize(local.withColumn(at, F.monotonically_increasing_id()), "shuffled")
    counts = stored.df.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "task-rows")
    total = counts.df.agg(F.sum("n")).first()[0] or 0
    base, larger = divmod(total, shards)
    runs = max(1, min(math.ceil((base + 1) / rows_per_run), MOST_RUNS // shards))
    # First slots of a shard's runs; sizes follow from the shard count alone.
    cuts = [[(base + (s < larger)) * r // runs for r in range(runs + 1)] for s in range(shards)]
    sizes = F.lit([float(b - a) for cut in cuts for a, b in itertools.pairwise(cut)]).cast("array<double>")
    matrix = communication_matrix(counts.df, sizes, counts.rows, seed + 2)
    # Position in the task below which all rows belong to earlier runs.
    ends = F.aggregate(
        "row_counts",
        F.array().cast("array<double>"),
        lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))),
    )
    matrix = materialize(matrix.select("part", ends.alias("ends")), "matrix").df
    part, ends_ = free_name(df, "shuffle_part"), free_name(df, "shuffle_ends")
    run_, slot0 = free_name(df, "shuffle_run"), free_name(df, "shuffle_first")
    matrix = matrix.select(F.col("part").alias(part), F.col("ends").alias(ends_))
    placed = stored.df.withColumn(part, F.shiftright(at, 33)).join(matrix, part)
    position = F.col(at).bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn(run_, _run_at(ends_, position, shards * runs))
    placed = placed.withColumn("shard", F.floor(F.col(run_) / runs).cast("int"))
    first = F.expr(f"(CASE WHEN shard < {larger} THEN {base + 1} ELSE {base} END * (`{run_}` % {runs})) DIV {runs}")
    placed = placed.withColumn(slot0, first.cast("bigint"))
    order = Window.partitionBy(run_).orderBy(after, at)
    return placed.select(*own, "shard", (F.col(slot0) + F.row_number().over(order) - 1).cast("bigint").alias("slot"))
