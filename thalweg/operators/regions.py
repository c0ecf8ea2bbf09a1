"""Outlets to regions: containing or nearest region, and lines within a box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.geometry import box_distance, is_nested, segment_distance
from thalweg.operators.proximity import MAX_LEVEL, ROOT_DEGREES, containing_regions, in_use
from thalweg.session import materialise


def edges_of(df: DataFrame, key: str, xs: str, ys: str, *more: str) -> DataFrame:
    """(key, x1, y1, x2, y2, *more): the edges of rings or lines given as coordinate arrays, one list per row or a list
    for each ring; one row per edge."""
    if is_nested(df, xs):
        ring = F.explode(F.arrays_zip(F.col(xs).alias("a"), F.col(ys).alias("b"))).alias("r")
        df = df.select(key, *more, ring).select(key, *more, F.col("r.a").alias("_xs"), F.col("r.b").alias("_ys"))
        xs, ys = "_xs", "_ys"
    after = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    rows = df.where((F.size(xs) == F.size(ys)) & (F.size(xs) > 1))
    e = F.explode(F.arrays_zip(F.col(xs).alias("a"), F.col(ys).alias("b"), after(xs).alias("c"), after(ys).alias("d")))
    e = rows.select(key, *more, e.alias("e")).select(key, F.col("e.a").alias("x1"), F.col("e.b").alias("y1"), F.col("e.c").alias("x2"), F.col("e.d").alias("y2"), *more)
    return e.where(F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull())


def edges_near(points: DataFrame, point_key: str, x: str, y: str, edges: DataFrame, reach: float, distance, within: str | None = None) -> DataFrame:
    """Points with the edges whose `distance` (an expression builder) to them is at most `reach`, as column `d`.

    Edges hang in an implicit hierarchy of boxes: at the deepest level whose boxes are at least as large as the edge
    and its surroundings; a point looks into one box per level in use. within: see containing_regions.
    """
    extent = F.greatest(F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))) + 2 * reach
    level = F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), F.floor(F.log2(F.lit(ROOT_DEGREES) / F.greatest(extent, F.lit(1e-9)))))).cast("int")
    edge_of = lambda lv: F.lit(ROOT_DEGREES) / F.pow(F.lit(2.0), lv)
    usable = F.lit(True)
    for c in ("x1", "y1", "x2", "y2"):
        usable = usable & (F.abs(c) < math.inf)
    hung = edges.where(usable).withColumn("level", level)
    levels = in_use(hung.select("level"))
    box = edge_of(F.col("level"))
    in_root = lambda v: F.greatest(F.lit(-ROOT_DEGREES), F.least(F.lit(ROOT_DEGREES), v))
    span = lambda a, b: F.explode(F.sequence(F.floor(in_root(F.least(a, b) - reach) / box), F.floor(in_root(F.greatest(a, b) + reach) / box)))
    hung = hung.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    at = points.where(F.col(point_key).isNotNull() & px.between(-ROOT_DEGREES, ROOT_DEGREES) & py.between(-ROOT_DEGREES, ROOT_DEGREES))
    at = at.select(F.col(point_key).alias("_p"), px.alias("_px"), py.alias("_py"), *([within] if within else [])).distinct()
    at = at.withColumn("level", F.explode(levels))
    at = at.withColumns({"cx": F.floor(F.col("_px") / box), "cy": F.floor(F.col("_py") / box)})
    d: Column = distance(F.col("_px"), F.col("_py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    hit = at.join(hung, ["level", "cx", "cy", *([within] if within else [])]).withColumn("d", d).where(F.col("d") <= reach)
    return hit.withColumnRenamed("_p", point_key).drop("level", "cx", "cy", "_px", "_py", "x1", "y1", "x2", "y2")


def locate(
    points: DataFrame, point_key: str, x: str, y: str, regions: DataFrame, key: str, xs: str, ys: str, reach: float = 0.0, within: str | None = None
) -> DataFrame:
    """(point_key, key, distance): the region that holds each point, or else the nearest one within `reach` degrees.

    Points with neither have no row. Of regions alike (a shared border, equal distances) the smallest key is taken.
    within: see containing_regions.
    """
    inside = containing_regions(points, point_key, x, y, regions, key, xs, ys, within)
    inside = inside.groupBy(point_key).agg(F.min(key).alias(key)).withColumn("distance", F.lit(0.0))
    if reach <= 0:
        return inside
    inside = materialise(inside, "inside")  # used twice
    outside = points.join(inside.select(point_key), point_key, "left_anti")
    edges = edges_of(regions, key, xs, ys, *([within] if within else []))
    near = edges_near(outside, point_key, x, y, edges, reach, segment_distance, within)
    best = near.groupBy(point_key).agg(F.min(F.struct("d", key)).alias("m"))
    return inside.unionByName(best.select(point_key, F.col("m")[key].alias(key), F.col("m.d").alias("distance")))


def lines_in_box(points: DataFrame, point_key: str, x: str, y: str, lines: DataFrame, key: str, xs: str, ys: str, reach: float) -> DataFrame:
    """(point_key, key, half_width): lines that meet the square of half-width `reach` around a point, and the
    half-width of the smallest square that they meet."""
    hits = edges_near(points, point_key, x, y, edges_of(lines, key, xs, ys), reach, box_distance)
    return hits.groupBy(point_key, key).agg(F.min("d").alias("half_width"))
