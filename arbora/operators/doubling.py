"""Walks along single parents by pointer doubling.

Every row jumps to its jump's own jump, so a round doubles the steps it looks
ahead, and the number of jobs grows with the logarithm of the depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


@dataclass(frozen=True)
class Walks:
    """Where walks end.

    ``rooted`` has ``id, root, steps`` of every row with a parent whose walk ends,
    ``endless`` has ``id, at`` of those whose walk runs into a cycle, no more than
    ``endless_rows``: ``at`` is the place after ``jump`` steps.  ``rounds`` is the
    number of jobs.
    """

    rooted: DataFrame
    endless: DataFrame
    endless_rows: int
    jump: int
    rounds: int


def walks(parents: DataFrame) -> Walks:
    """Follow ``child, parent`` (one parent per child) up to ids without a parent.

    A round in which no walk ends is the last: as long as some walk that ends is
    still open, one of the walks through it ends in the next round.
    """
    up = parents.select(F.col("child").alias("at"), F.lit(1).alias("above"))
    first = parents.select(F.col("child").alias("id"), F.col("parent").alias("at")).join(up, "at", "left")
    first = first.select("id", "at", F.lit(1).cast("bigint").alias("steps"), F.col("above").isNull().alias("done"))
    state = materialize(first, "walk", F.col("done"))
    done, jump, rounds = state.df.filter("done"), 1, 1
    while 0 < state.marked < state.rows:
        latest = state.df.filter("NOT done")
        ahead = latest.unionByName(done).toDF("at", "next", "more", "ends")
        further = latest.select("id", "at", "steps").join(ahead, "at")
        further = further.select("id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
        state = materialize(further, "walk", F.col("done"))
        done, jump, rounds = done.unionByName(state.df.filter("done")), 2 * jump, rounds + 1
    left = state.rows if state.marked < state.rows else 0
    return Walks(done.select("id", F.col("at").alias("root"), "steps"), state.df.filter("NOT done").select("id", "at"), left, jump, rounds)


def cycles(endless: Walks) -> DataFrame:
    """``id`` of the rows on cycles."""
    state, jump = materialize(endless.endless, "jump"), endless.jump
    while jump < endless.endless_rows:
        ahead = state.df.select(F.col("id").alias("at"), F.col("at").alias("next"))
        state = materialize(state.df.join(ahead, "at").select("id", F.col("next").alias("at")), "jump")
        jump *= 2
    # After as many steps as there are rows every walk is on its cycle, and each place on a cycle is met.
    return state.df.select(F.col("at").alias("id")).distinct()


def cycle_sizes(on_cycle: DataFrame, parents: DataFrame) -> DataFrame:
    """``id, size`` of the rows on cycles."""
    step = parents.select(F.col("child").alias("id"), F.col("parent").alias("at")).join(on_cycle, "id", "left_semi")
    state = materialize(step.select("id", "at", F.least("id", "at").alias("least")), "ring")
    jump = 1
    while jump < state.rows:
        ahead = state.df.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"))
        joined = state.df.join(ahead, "at")
        state = materialize(joined.select("id", F.col("next").alias("at"), F.least("least", "other").alias("least")), "ring")
        jump *= 2
    sizes = state.df.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
    return state.df.join(sizes, "least").select("id", "size")


def walk_lengths(parents: DataFrame) -> DataFrame:
    """``id, steps``: how many distinct rows with a parent each walk passes, its start included.

    A walk that ends passes as many as it has steps; one that runs into a cycle
    passes its way there and the whole cycle once.
    """
    found = walks(parents)
    lengths = found.rooted.select("id", "steps")
    if not found.endless_rows:
        return lengths
    on_cycle = materialize(cycles(found), "on_cycle").df
    sizes = materialize(cycle_sizes(on_cycle, parents), "sizes").df
    tails = parents.join(found.endless.select(F.col("id").alias("child")), "child", "left_semi")
    tails = materialize(tails.join(on_cycle.withColumnRenamed("id", "child"), "child", "left_anti"), "tails").df
    ways = walks(tails).rooted.join(sizes.withColumnRenamed("id", "root"), "root")
    looped = ways.select("id", (F.col("steps") + F.col("size")).alias("steps"))
    return lengths.unionByName(looped).unionByName(sizes.select("id", F.col("size").alias("steps")))


def ancestor_pairs(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """``id, ancestor, step`` for each of the distinct ``id``s, itself at step 0; on a cycle the first visit counts.

    After k rounds the pairs within 2^k - 1 steps are there; when a round adds
    none, nothing is missing.
    """
    jump = materialize(parents.select(F.col("child").alias("ancestor"), F.col("parent").alias("next")), "jump").df
    first = starts.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("step")).distinct()
    pairs = materialize(first, "pairs").df
    ahead = 1
    while True:
        far = pairs.join(jump, "ancestor").groupBy("id", F.col("next").alias("ancestor")).agg((F.min("step") + ahead).alias("step"))
        new = materialize(far.join(pairs.select("id", "ancestor"), ["id", "ancestor"], "left_anti"), "pairs")
        if not new.rows:
            return pairs
        pairs = pairs.unionByName(new.df)
        over = jump.select(F.col("ancestor").alias("next"), F.col("next").alias("last"))
        jump = materialize(jump.join(over, "next").select("ancestor", F.col("last").alias("next")), "jump").df
        ahead *= 2


def ancestor_set(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """The given ids and all that lie on their walks, as one set ``id``."""
    jump = materialize(parents.select(F.col("child").alias("id"), F.col("parent").alias("next")), "jump").df
    found = materialize(starts.select("id").distinct(), "set").df
    while True:
        far = found.join(jump, "id").select(F.col("next").alias("id")).distinct()
        new = materialize(far.join(found, "id", "left_anti"), "set")
        if not new.rows:
            return found
        found = found.unionByName(new.df)
        over = jump.select(F.col("id").alias("next"), F.col("next").alias("last"))
        jump = materialize(jump.join(over, "next").select("id", F.col("last").alias("next")), "jump").df
