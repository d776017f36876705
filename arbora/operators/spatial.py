"""Hulls around groups of points and the hulls at a point."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import collate
from ..schema import CLUSTER_PAD, NODE_RADIUS
from ..session import materialize

POINTS = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
PARTIAL = "root_id STRING, x DOUBLE, y DOUBLE, ord BIGINT, n BIGINT"
# A hot group is merged over this many tasks before its last step.
MERGE_BUCKETS = 64
# Tasks reduce this many rows at a time; groups below the second number stay as they are.
HELD_ROWS, SMALL_GROUP = 200_000, 32
# Cells along the longer side of a hull, and how often the grid may be halved.
GRID, FINEST_GRID = 16, 20

# The task functions travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _without_inner(points: np.ndarray) -> np.ndarray:
    """Leave out points clearly inside the polygon of the extremes in eight directions."""
    turns = np.arange(8) * np.pi / 4
    rim = points[np.argmax(points @ np.vstack([np.cos(turns), np.sin(turns)]), axis=0)]
    following = np.roll(rim, -1, axis=0)
    step = following - rim
    crosses = step[:, 0] * (points[:, 1:] - rim[:, 1]) - step[:, 1] * (points[:, :1] - rim[:, 0])
    # sides of no length say nothing; the margin keeps points that may lie on a side
    margin = 1e-9 * float(np.square(np.ptp(rim, axis=0)).sum())
    inside = ((crosses > margin) | (step == 0).all(axis=1)).all(axis=1)
    return points[~inside] if margin > 0 else points


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corner points, from the rightmost one over the lower side and back over the
    upper side; fewer than three rows if all points are on one line."""
    if len(points) > 2 * SMALL_GROUP:
        points = _without_inner(points)
    pts = np.unique(points, axis=0).tolist()
    if len(pts) < 3:
        return np.array(pts)

    def side(ordered: list) -> list:
        chain: list = []
        for p in ordered:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain

    return np.array(side(pts)[::-1] + side(pts[::-1])[::-1][1:-1])


def _reduced(rows: pd.DataFrame) -> pd.DataFrame:
    """Fewer rows with the same hull per group.

    ``n`` adds up to the number of entries of a group.  Small groups stay as
    they are: one or two entries are drawn differently, and the rest is cheap.
    """
    codes, roots = pd.factorize(rows["root_id"])
    sizes = np.bincount(codes, minlength=len(roots))
    large = sizes[codes] > SMALL_GROUP
    if not large.any():
        return rows
    parts = [rows[~large]]
    rows, codes = rows[large], codes[large]
    order = np.argsort(codes, kind="stable")
    points, entries = rows[["x", "y"]].to_numpy()[order], rows["n"].to_numpy()[order]
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(order)]):
        corners = convex_hull(points[start:end])
        n = np.zeros(len(corners), dtype="int64")
        n[0] = entries[start:end].sum()
        root = roots[codes[order[start]]]
        parts.append(pd.DataFrame({"root_id": root, "x": corners[:, 0], "y": corners[:, 1], "ord": 0, "n": n}))
    return pd.concat(parts, ignore_index=True)


def _shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows of a task, reduced; what does not get smaller is passed on."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= HELD_ROWS:
            held = [_reduced(pd.concat(held, ignore_index=True))]
            if len(held[0]) > HELD_ROWS // 2:
                yield held.pop()
    if held:
        yield _reduced(pd.concat(held, ignore_index=True))


def _closed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per group of rows sorted by group and position."""
    names, points, entries = rows["root_id"].to_numpy(), rows[["x", "y"]].to_numpy(), rows["n"].to_numpy()
    starts = np.flatnonzero(names != np.roll(names, 1)) if len(set(names[[0, -1]])) > 1 else np.array([0])
    counts = np.add.reduceat(entries, starts)
    outlines = []
    for start, end, n in zip(starts, [*starts[1:], len(names)], counts):
        corners = points[start:end] if n <= 2 else convex_hull(points[start:end])
        closed = n <= 2 or len(corners) > 2
        outlines.append([{"x": x, "y": y} for x, y in corners] if closed else [])
    return pd.DataFrame({"root_id": names[starts], "n": counts, "points": outlines})


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Close every group once all of its rows were read."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if rows.empty:
            continue
        unfinished = (rows["root_id"] == rows["root_id"].iloc[-1]).to_numpy()
        rest = rows[unfinished]
        if len(rest) > HELD_ROWS:
            rest = _reduced(rest)
        if not unfinished.all():
            yield _closed(rows[~unfinished])
    if rest is not None:
        yield _closed(rest)


def hull_vertices(members: DataFrame) -> DataFrame:
    """``root_id, n, points``: one or two entries as they are, else the hull's corners.

    Entries on one line give no points.  The hull of partial hulls is the hull:
    every task first shrinks what it reads, groups that many tasks share are
    shrunk again over several buckets, and only corner points and small groups
    reach the last step.
    """
    rows = members.select("root_id", "x", "y", "ord", F.lit(1).cast("bigint").alias("n"))
    bucket = F.pmod(F.xxhash64("x", "y"), F.lit(MERGE_BUCKETS))
    spread = rows.mapInPandas(_shrink, PARTIAL).repartition("root_id", bucket)
    whole = spread.mapInPandas(_shrink, PARTIAL).repartition("root_id").sortWithinPartitions("root_id", "ord")
    return whole.mapInPandas(_outlines, f"root_id STRING, n BIGINT, points {POINTS}")


def padded_polygon(n: Column, points: Column, pad: float, radius: float = NODE_RADIUS) -> Column:
    """Twelve-cornered circle, rectangle, or hull moved outwards from its mean corner."""
    reach = radius + pad

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    first = F.get(points, F.lit(0))
    turns = F.array(*[F.struct(F.lit(math.cos(math.pi * i / 6)).alias("c"), F.lit(math.sin(math.pi * i / 6)).alias("s")) for i in range(12)])
    circle = F.transform(turns, lambda t: point(first["x"] + t["c"] * reach, first["y"] + t["s"] * reach))

    second = F.get(points, F.lit(1))
    dx, dy = second["x"] - first["x"], second["y"] - first["y"]
    span = F.sqrt(dx * dx + dy * dy)
    span = F.when(span == 0, F.lit(1.0)).otherwise(span)
    side_x, side_y = -dy / span * reach, dx / span * reach
    box = F.array(
        point(first["x"] + side_x, first["y"] + side_y),
        point(second["x"] + side_x, second["y"] + side_y),
        point(second["x"] - side_x, second["y"] - side_y),
        point(first["x"] - side_x, first["y"] - side_y),
    )

    def mean(axis: str) -> Column:
        total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[axis])
        return F.try_divide(total, F.size(points))

    def pushed(p: Column) -> Column:
        vx, vy = p["x"] - mean("x"), p["y"] - mean("y")
        length = F.sqrt(vx * vx + vy * vy)
        length = F.when(length == 0, F.lit(1.0)).otherwise(length)
        scale = (length + pad) / length
        return point(mean("x") + vx * scale, mean("y") + vy * scale)

    outward = F.transform(points, pushed)
    return F.when(n == 1, circle).when(n == 2, box).otherwise(outward).cast(POINTS)


def group_hull(members: DataFrame, pad: float = CLUSTER_PAD, radius: float = NODE_RADIUS) -> DataFrame:
    """``root_id, n, polygon`` for every org with members."""
    polygon = padded_polygon(F.col("n"), F.col("points"), pad, radius).alias("polygon")
    return hull_vertices(members).select("root_id", "n", polygon)


def _sides(polygon: Column) -> Column:
    following = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    return F.arrays_zip(polygon.alias("a"), following.alias("b"))


def _inside(sides: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: how many sides lie to the right of the point."""

    def crossed(side: Column) -> Column:
        a, b = side["a"], side["b"]
        at = F.try_divide((a["x"] - b["x"]) * (y - b["y"]), a["y"] - b["y"]) + b["x"]
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.size(F.filter(sides, crossed)) % 2 == 1


def _touches(side: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """False only if the side certainly stays out of the box."""
    a, b = side["a"], side["b"]
    apart = (
        (F.greatest(a["x"], b["x"]) < x0)
        | (F.least(a["x"], b["x"]) > x1)
        | (F.greatest(a["y"], b["y"]) < y0)
        | (F.least(a["y"], b["y"]) > y1)
    )

    def turn(x: Column, y: Column) -> Column:
        return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])

    turns = [turn(x, y) for x in (x0, x1) for y in (y0, y1)]
    return ~(apart | (F.least(*turns) > 0) | (F.greatest(*turns) < 0))


def hulls_at_point(
    points: DataFrame, hulls: DataFrame, allowed: DataFrame, orgs: DataFrame, ordered: bool = True
) -> DataFrame:
    """``id, org_id, depth, label`` of the allowed hulls that contain each point.

    ``orgs`` has ``org_id, depth, label``.  Each hull is laid over a grid that
    suits its size, so it covers at most (GRID + 1)^2 cells, and points are
    looked up once per grid in use.  A cell no side touches lies wholly inside
    or outside its hull, so its points need no test; in the other cells the
    sides are counted.
    """
    shapes = hulls.filter(F.size("polygon") >= 3).withColumnRenamed("root_id", "org_id")
    shapes = shapes.join(allowed.select("org_id").distinct(), "org_id", "left_semi").join(orgs, "org_id")
    xs, ys = F.col("polygon")["x"], F.col("polygon")["y"]
    outlined = shapes.select(
        "org_id",
        "depth",
        "label",
        _sides(F.col("polygon")).alias("sides"),
        F.array_min(xs).alias("x0"),
        F.array_max(xs).alias("x1"),
        F.array_min(ys).alias("y0"),
        F.array_max(ys).alias("y1"),
    )
    boxed = materialize(outlined, "boxed").df
    west, east, south, north = boxed.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    if west is None:
        west, east, south, north = 0.0, 1.0, 0.0, 1.0
    extent = max(east - west, north - south) or 1.0

    grid = F.col("grid")
    width = F.element_at(F.array(*[F.lit(extent / GRID / 2**k) for k in range(FINEST_GRID + 1)]), grid + 1)
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    halvings = F.floor(F.log2(F.lit(extent) / F.when(span > 0, span)))
    fitting = F.least(F.lit(FINEST_GRID), F.greatest(F.lit(0), F.coalesce(halvings, F.lit(FINEST_GRID)))).cast("int")

    def cell(value: Column, low: float) -> Column:
        return F.floor((value - low) / width)

    def covered(first: str, last: str, low: float) -> Column:
        return F.explode(F.sequence(cell(F.col(first), low), cell(F.col(last), low)))

    cx, cy = F.col("cx"), F.col("cy")
    margin = 1e-6
    box = (
        west + (cx - margin) * width,
        west + (cx + 1 + margin) * width,
        south + (cy - margin) * width,
        south + (cy + 1 + margin) * width,
    )
    middle = _inside(F.col("sides"), west + (cx + 0.5) * width, south + (cy + 0.5) * width)
    laid = (
        boxed.withColumn("grid", fitting)
        .withColumn("cx", covered("x0", "x1", west))
        .withColumn("cy", covered("y0", "y1", south))
        .withColumn("cut", F.exists("sides", lambda side: _touches(side, *box)))
        .filter(F.col("cut") | middle)
        .select("org_id", "depth", "label", "grid", "cx", "cy", F.when(F.col("cut"), F.col("sides")).alias("sides"))
    )
    cells = materialize(laid, "cells").df
    # at most FINEST_GRID + 1 values
    grids = [row.grid for row in cells.select("grid").distinct().collect()]
    located = (
        points.filter("x IS NOT NULL AND y IS NOT NULL")
        .select("id", "x", "y", F.explode(F.array(*map(F.lit, grids)).cast("array<int>")).alias("grid"))
        .withColumns({"cx": cell(F.col("x"), west), "cy": cell(F.col("y"), south)})
    )
    # a point meets many hulls, so few scan tasks do not hold the work of all points
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    located = located.repartition(spread, "id", "x", "y")
    hit = F.col("sides").isNull() | _inside(F.col("sides"), F.col("x"), F.col("y"))
    found = located.join(cells, ["grid", "cx", "cy"]).filter(hit).select("id", "org_id", "depth", "label")
    if not ordered:
        return found
    # written once: a sort by ranges reads its input twice
    stored = materialize(found, "hulls-at-point").df
    return stored.orderBy("id", F.desc("depth"), collate(F.col("label")), "org_id")
