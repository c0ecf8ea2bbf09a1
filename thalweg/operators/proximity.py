"""Points in regions and points near points, as equi-joins on the nodes of implicit hierarchies.

Regions: polygons are cut into triangles by ear clipping, and the triangles of a region hang in a bounding-volume
hierarchy of boxes, at the level that fits the region's size and number of corners. A node is (level, column, row):
nodes are computed, not stored, so nothing is built on or sent from the driver, and a point looks up one node per
level in use. A region sends each of its nodes the triangles that meet it, as one row. Hits are tested exactly and one
region is kept where a point lies on a border that several share.

Near points: distinct positions of a group are bucketed by latitude band and by a longitude step that fits the band,
so a position looks into a few cells at any latitude, across the date line and at the poles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.geometry import flat_list, is_nested
from thalweg.functions.triangles import clean_ring, triangulate_many

#: Edge of the root node in degrees, and the deepest level (edge 512 / 2**26, about a metre).
ROOT_DEGREES = 512.0
MAX_LEVEL = 26
#: Corners of a region for each node that it is spread over.
CORNERS_PER_NODE = 16
EARTH_KM = 6371.0088

_NODES = "level int, cx long, cy long, region {kind}, x0 double, y0 double, x1 double, y1 double, t array<double>, b array<tinyint>"


def node_level(xs: Column, ys: Column, nested: bool) -> Column:
    """The level of a region's nodes: boxes twice its size, or so many times smaller as it has many corners."""
    xs, ys = flat_list(xs, nested), flat_list(ys, nested)
    usable = lambda c: F.filter(c, lambda v: F.abs(v) < math.inf)
    wide = lambda c: F.array_max(usable(c)) - F.array_min(usable(c))
    extent = F.greatest(wide(xs), wide(ys), F.lit(ROOT_DEGREES / 2**MAX_LEVEL)) / F.sqrt(F.greatest(F.lit(1.0), F.size(xs) / CORNERS_PER_NODE))
    return F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), F.floor(F.log2(F.lit(ROOT_DEGREES) / extent)) - 1)).cast("int")


def _loops(xs, ys) -> list[np.ndarray]:
    """Loops of corners of a region, whether its coordinates are one list or a list for each ring."""
    if xs is None or ys is None or len(xs) != len(ys) or not len(xs):
        return []
    many = any(isinstance(v, list) for v in xs)
    rings = [(a, b) for a, b in zip(xs, ys) if a is not None and b is not None and len(a) == len(b)] if many else [(xs, ys)]
    return [clean_ring(np.array(a, float), np.array(b, float)) for a, b in rings]


def _node_batches(batches):
    for batch in batches:
        level = np.array(batch.column(3).to_pylist(), float)
        owner, tri, sides = triangulate_many([_loops(x, y) if k else [] for x, y, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), np.isfinite(level))])
        edge = ROOT_DEGREES / 2.0 ** level[owner]
        low, high = np.minimum(np.minimum(tri[:, :2], tri[:, 2:4]), tri[:, 4:]), np.maximum(np.maximum(tri[:, :2], tri[:, 2:4]), tri[:, 4:])
        last = (ROOT_DEGREES / edge)[:, None]  # no point lies beyond
        a, z = (np.clip(np.floor(v / edge[:, None]), -last, last).astype(np.int64) for v in (low, high))
        wide = z - a + 1
        reps = wide[:, 0] * wide[:, 1]
        t = np.repeat(np.arange(len(tri)), reps)
        k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        cx, cy = a[t, 0] + k % wide[t, 0], a[t, 1] + k // wide[t, 0]
        order = np.lexsort((cy, cx, owner[t]))
        t, cx, cy = t[order], cx[order], cy[order]
        new = np.ones(len(t), bool)
        new[1:] = (owner[t][1:] != owner[t][:-1]) | (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])
        at = np.flatnonzero(new)
        who = owner[t[at]]
        box = [f.reduceat(c[t], at) if len(at) else np.zeros(0) for f, c in ((np.minimum, low[:, 0]), (np.minimum, low[:, 1]), (np.maximum, high[:, 0]), (np.maximum, high[:, 1]))]
        offsets = np.append(at, len(t)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets * 6), pa.array(tri[t].ravel())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sides[t], pa.int8()))]
        data = [pa.array(level[who].astype(np.int32)), pa.array(cx[at]), pa.array(cy[at]), batch.column(0).take(pa.array(who)), *map(pa.array, box), *lists]
        yield pa.RecordBatch.from_arrays(data, ["level", "cx", "cy", "region", "x0", "y0", "x1", "y1", "t", "b"])


def triangle_nodes(regions: DataFrame, key: str, xs: str, ys: str) -> DataFrame:
    """(level, cx, cy, region, box, t, b): per region and node the triangles that meet it, six numbers each, and bits
    of their sides that are the region's border.

    Coordinates are one list per region or, for holes and several parts, a list for each ring; a point is inside by
    the even-odd rule. Rings that are null, empty, of unequal coordinate counts or without area give no rows, nor does
    a null key.
    """
    level = node_level(F.col(xs), F.col(ys), is_nested(regions, xs))
    rows = regions.where(F.col(key).isNotNull()).select(F.col(key).alias("region"), xs, ys, level.alias("level"))
    return rows.mapInArrow(_node_batches, _NODES.format(kind=dict(regions.dtypes)[key]))


def in_use(levels: DataFrame) -> Column:
    """The levels at which anything hangs, as an array: at most MAX_LEVEL + 1 numbers."""
    found = sorted(r["level"] for r in levels.distinct().collect() if r["level"] is not None)
    return F.array(*[F.lit(v) for v in found]).cast("array<int>")


def _side(ax: str, ay: str, bx: str, by: str) -> Column:
    c = F.col
    return (c(bx) - c(ax)) * (c("_py") - c(ay)) - (c(by) - c(ay)) * (c("_px") - c(ax))


def containing_regions(
    points: DataFrame, point_key: str, x: str, y: str, regions: DataFrame, key: str, xs: str, ys: str, within: str | None = None
) -> DataFrame:
    """(point_key, region key): regions that hold the point, borders included.

    A point strictly inside several overlapping regions gives all of them; a point on borders only, shared or not,
    gives the smallest region key. Repeated regions (same key and rings) and repeated points count once. Points with
    a null key or coordinate, or no finite one, are left out. Other columns are ignored, whatever their names.
    within: a column of both tables (such as a basin) in which point and region must agree; it is part of the join
    key, so that regions stored by it are read only where points are.
    """
    levels = in_use(regions.select(node_level(F.col(xs), F.col(ys), is_nested(regions, xs)).alias("level")))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    finite = px.between(-ROOT_DEGREES, ROOT_DEGREES) & py.between(-ROOT_DEGREES, ROOT_DEGREES)
    at = points.where(F.col(point_key).isNotNull() & finite).select(F.col(point_key).alias("_p"), px.alias("_px"), py.alias("_py"), *([F.col(within).alias("_w")] if within else []))
    at = at.withColumn("level", F.explode(levels))
    edge = F.lit(ROOT_DEGREES) / F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumns({"cx": F.floor(F.col("_px") / edge), "cy": F.floor(F.col("_py") / edge)})
    if within:
        both = F.struct(F.col(key).alias("k"), F.col(within).alias("w"))
        regions = regions.where(F.col(key).isNotNull()).select(both.alias("_both"), F.col(xs).alias("_xs"), F.col(ys).alias("_ys"))
        hung = triangle_nodes(regions, "_both", "_xs", "_ys").select("*", F.col("region.w").alias("_w")).withColumn("region", F.col("region.k"))
    else:
        hung = triangle_nodes(regions, key, xs, ys)
    near = at.join(hung, ["level", "cx", "cy", *(["_w"] if within else [])])
    near = near.where(F.col("_px").between(F.col("x0"), F.col("x1")) & F.col("_py").between(F.col("y0"), F.col("y1")))
    each = near.select("_p", "_px", "_py", "region", "t", F.posexplode("b").alias("_i", "border"))
    corner = lambda n: F.get("t", F.col("_i") * 6 + n)
    each = each.select("_p", "_px", "_py", "region", "border", *[corner(2 * i + j).alias(f"{c}{i + 1}") for i in range(3) for j, c in enumerate("xy")])
    sides = [_side("x1", "y1", "x2", "y2"), _side("x2", "y2", "x3", "y3"), _side("x3", "y3", "x1", "y1")]
    hits = each.where((F.least(*sides) >= 0) | (F.greatest(*sides) <= 0))
    # strictly inside, or on one side only and that side is no part of the ring
    zero = [F.when(side == 0, F.lit(1)).otherwise(F.lit(0)) for side in sides]
    inner = [z * (F.col("border").bitwiseAND(F.lit(1 << i)) == 0).cast("int") for i, z in enumerate(zero)]
    n_zero = zero[0] + zero[1] + zero[2]
    strict = (n_zero == 0) | ((n_zero == 1) & (inner[0] + inner[1] + inner[2] == 1))
    best = hits.groupBy("_p").agg(F.collect_set(F.when(strict, F.col("region"))).alias("inner"), F.min("region").alias("first"))
    chosen = F.when(F.size("inner") > 0, F.col("inner")).otherwise(F.array("first"))
    return best.select(F.col("_p").alias(point_key), F.explode(chosen).alias(key))


def _band_step(band: Column, width: float, radius_deg: float) -> Column:
    """Number of longitude cells of a latitude band: each at least as wide as the radius at the band's far edge."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(band * width), F.abs((band + 1) * width)) + radius_deg)
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(radius_deg))) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9)))))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / (reach * 1.000001))).cast("long")


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance (haversine)."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def near_pairs(points: DataFrame, key: str, group: str, lat: str, lng: str, radius_km: float) -> DataFrame:
    """(key1, key2), key1 < key2: rows of different `group` closer than the radius, null groups counting as one group.

    Spots (a position and a group) are compared, and only pairs of spots of different groups are then carried to the
    rows that stand there; rows of one group on one spot never meet. Rows without a key or coordinate are left out;
    repeated rows give their pair once.
    """
    radius_deg = math.degrees(radius_km / EARTH_KM)
    width = radius_deg * 1.000001
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null is a group of its own
    rows = points.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), g.alias("g"), F.col(lat).cast("double").alias("la"), F.col(lng).cast("double").alias("lo"))
    rows = rows.where(F.col("la").between(-90, 90) & F.col("lo").between(-180, 180))
    spots = rows.groupBy("g", "la", "lo").agg(F.lit(0)).withColumn("band", F.floor(F.col("la") / width))
    cell = lambda band, n: F.pmod(F.floor((F.col("lo") + 180.0) / 360.0 * n), n)
    n = _band_step(F.col("band"), width, radius_deg)
    home = spots.select(F.col("la").alias("lat2"), F.col("lo").alias("lng2"), F.col("g").alias("gb"), "band", cell(F.col("band"), n).alias("cell"))
    probe = spots.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).withColumn("n", n)  # lat1 <= lat2
    around = F.array_distinct(F.array(*[F.pmod(cell(F.col("band"), F.col("n")) + k, F.col("n")) for k in (-1, 0, 1)]))
    probe = probe.select(F.col("la").alias("lat1"), F.col("lo").alias("lng1"), F.col("g").alias("ga"), "band", F.explode(around).alias("cell"))
    ordered = F.struct("lat1", "lng1", "ga") < F.struct(F.col("lat2").alias("lat1"), F.col("lng2").alias("lng1"), F.col("gb").alias("ga"))
    close = distance_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")) < radius_km
    apart = probe.join(home, ["band", "cell"]).where(ordered & (F.col("ga") != F.col("gb")) & close).select("lat1", "lng1", "ga", "lat2", "lng2", "gb")
    one = rows.select(F.col("k").alias("ka"), F.col("g").alias("ga"), F.col("la").alias("lat1"), F.col("lo").alias("lng1"))
    two = rows.select(F.col("k").alias("kb"), F.col("g").alias("gb"), F.col("la").alias("lat2"), F.col("lo").alias("lng2"))
    both = apart.join(one, ["lat1", "lng1", "ga"]).join(two, ["lat2", "lng2", "gb"]).where("ka <> kb")
    return both.select(F.least("ka", "kb").alias("key1"), F.greatest("ka", "kb").alias("key2")).distinct()
