"""Splitting the terminal catchment along the flow raster, for all outlets at once.

Cells are rows (basin, r, c, fdir, acc) of a grid of 1/1200 degree. A terminal catchment's mask is worked out once,
however many outlets lie in it. Pour points are looked for in boxes that widen until a stream cell is near enough.
Tracing goes by blocks of a catchment's cells, numbered from its own corner; what a block cannot tell, by the network
closure over the catchment's cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from thalweg.config import PIXELS_PER_DEGREE, Settings
from thalweg.functions.geometry import equal_area_km2, shoelace
from thalweg.operators.dissolve import border_edges, largest_part, stitch_rings
from thalweg.operators.network import jump_tables, upstream
from thalweg.operators.proximity import containing_regions
from thalweg.operators.raster import NO_STREAM, cell_edges, nudged, split_cells, split_shells, step_of
from thalweg.session import materialise

#: North-west corner of the grid's first cell.
WEST, NORTH = -180.0, 90.0
#: Edge in cells of the boxes in which stream cells are looked for first, and how much wider the next are.
FIRST_BOX, WIDER = 8, 4


@dataclass(frozen=True)
class Split:
    """terminals: (id, xs, ys, lng_snap, lat_snap, n_cells), the split terminal catchment; failed: (id, explanation)."""

    terminals: DataFrame
    failed: DataFrame
    cells: DataFrame


def cell_x(c: Column) -> Column:
    """Longitude of a cell's western edge."""
    return F.lit(WEST) + c / PIXELS_PER_DEGREE


def cell_y(r: Column) -> Column:
    """Latitude of a cell's northern edge."""
    return F.lit(NORTH) - r / PIXELS_PER_DEGREE


def catchment_masks(cells: DataFrame, catchments: DataFrame) -> DataFrame:
    """(comid, r, c, fdir, acc): cells whose centre lies in a catchment; elsewhere there is nothing."""
    key = F.struct("r", "c", "fdir", "acc")
    half = 0.5 / PIXELS_PER_DEGREE
    points = cells.where("fdir <> 0").select(key.alias("k"), (cell_x(F.col("c")) + half).alias("x"), (cell_y(F.col("r")) - half).alias("y"))
    inside = containing_regions(points, "k", "x", "y", catchments, "comid", "ring_lng", "ring_lat")
    return inside.select("comid", "k.*")


def pour_points(outlets: DataFrame, mask: DataFrame, settings: Settings) -> DataFrame:
    """(id, comid, r, c): per outlet the nearest cell of its catchment with enough flow, of equally near ones the first
    by row, then column. Outlets whose catchment has no such cell have no row.

    Outlets and stream cells meet in boxes of a grid, in those around as well. A hit nearer than a box is wide is the
    nearest of all; outlets without one look into wider boxes.
    """
    limits = [settings.threshold_single, settings.threshold_multiple]
    limit = F.when(F.col("n_catchments") == 1, limits[0]).otherwise(limits[1])
    pc, pr = (F.col("lng") - WEST) * PIXELS_PER_DEGREE, (NORTH - F.col("lat")) * PIXELS_PER_DEGREE
    stream = mask.where(F.col("acc") > min(limits)).select("comid", "r", "c", "acc")
    most = stream.groupBy("comid").agg(F.max("acc").alias("most"))
    there = F.abs("pr").between(0, 1e9) & F.abs("pc").between(0, 1e9)
    left = outlets.select("id", "comid", limit.alias("least"), pr.alias("pr"), pc.alias("pc")).where(there)
    left = materialise(left.join(most, "comid").where("most > least").drop("most"), "unsnapped")
    found, box = [], FIRST_BOX
    while True:
        cell = lambda v: F.floor(F.col(v) / box)  # noqa: B023, E731
        around = lambda v: F.explode(F.array(*[cell(v) + k for k in (-1, 0, 1)]))  # noqa: B023, E731
        look = left.withColumn("br", around("pr")).withColumn("bc", around("pc"))
        near = look.join(stream.withColumns({"br": cell("r"), "bc": cell("c")}), ["comid", "br", "bc"]).where("acc > least")
        d = F.round(F.pow(F.col("c") - F.col("pc"), 2) + F.pow(F.col("r") - F.col("pr"), 2), 6)  # in cells, so that ties are ties
        best = near.groupBy("id").agg(F.min(F.struct(d.alias("d"), "r", "c", "comid")).alias("m")).where(F.col("m.d") < box * box)
        best = materialise(best.select("id", "m.comid", "m.r", "m.c"), "pour-points")
        found.append(best)
        seen = Observation()
        left = materialise(left.join(best.select("id"), "id", "left_anti").observe(seen, F.count(F.lit(1)).alias("n")), "unsnapped")
        if not seen.get["n"]:
            break
        box *= WIDER
    snapped = found[0]
    for more in found[1:]:
        snapped = snapped.unionByName(more)
    return snapped


def split_terminals(outlets: DataFrame, catchments: DataFrame, cells: DataFrame, settings: Settings) -> Split:
    """outlets: (id, lng, lat, comid, n_catchments). Outlets whose catchment has no stream cell fail.

    The pour point is the nearest cell with enough flow; what drains to it within the catchment is kept, and of that
    the largest part without holes. The snapped point is moved by half a pixel after tracing.
    """
    terminal = catchments.join(outlets.select("comid").distinct(), "comid", "left_semi")
    mask = materialise(catchment_masks(cells, terminal), "masks")
    snapped = pour_points(outlets, mask, settings)
    failed = outlets.join(snapped, "id", "left_anti").select("id", F.lit(NO_STREAM).alias("explanation"))
    corner = mask.groupBy("comid").agg(F.min("r").alias("r0"), F.min("c").alias("c0"))
    moved = lambda t: t.join(corner, "comid").withColumns({"r": F.col("r") - F.col("r0"), "c": F.col("c") - F.col("c0")})
    seen = Observation()
    shells = split_shells(moved(mask.select("comid", "r", "c", "fdir")), "comid", moved(snapped))
    shells = materialise(shells.observe(seen, F.count_if(F.col("xs").isNull()).alias("n")), "shells")
    back = {"xs": F.transform("xs", lambda x: x + F.col("c0")), "ys": F.transform("ys", lambda y: y + F.col("r0"))}
    parts = shells.where("xs is not null").join(snapped.join(corner, "comid"), "id").withColumns(back).select("id", "n_cells", "xs", "ys", "r", "c")
    kept = split_cells(moved(mask.select("comid", "r", "c", "fdir")), "comid", moved(snapped)).join(snapped.select("id", "comid"), "id").join(corner, "comid")
    kept = kept.select("id", (F.col("r") + F.col("r0")).alias("r"), (F.col("c") + F.col("c0")).alias("c"))
    if seen.get["n"]:
        far, traced = _by_network(snapped.join(shells.where("xs is null").select("id"), "id"), mask)
        parts, kept = parts.unionByName(far), kept.unionByName(traced)
    lng, lat = nudged(cell_x(F.col("c")), cell_y(F.col("r")))
    out = parts.select("id", F.transform("xs", cell_x).alias("xs"), F.transform("ys", cell_y).alias("ys"), lng.alias("lng_snap"), lat.alias("lat_snap"), "n_cells")
    return Split(out, failed, kept)


def _by_network(snapped: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n_cells, xs, ys, r, c), the largest part of what drains to each cell, in columns and rows; and (id, r, c)."""
    mask = mask.join(snapped.select("comid").distinct(), "comid", "left_semi")
    node = F.struct("comid", "r", "c")
    to = mask.select("comid", node.alias("src"), (F.col("r") + step_of(F.col("fdir"), 0)).alias("r"), (F.col("c") + step_of(F.col("fdir"), 1)).alias("c"))
    edges = to.join(mask.select("comid", "r", "c", node.alias("dst")), ["comid", "r", "c"]).select("src", "dst")
    up = upstream(snapped.select("id", node.alias("k")), "id", "k", jump_tables(edges, "cells"), "k")
    kept = materialise(up.select("id", "k.r", "k.c"), "traced")
    shells = stitch_rings(border_edges(cell_edges(kept, ["id"]), ["id"]), "id").where("ring = 0")
    shells = largest_part(shells, "id", shoelace(F.col("xs"), F.col("ys")))
    n = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"))
    return shells.join(snapped.select("id", "r", "c"), "id").join(n, "id").select("id", "n_cells", "xs", "ys", "r", "c"), kept


def on_grid(edges: DataFrame) -> DataFrame:
    """Edges along the grid's lines cut at every cell corner, as those of split parts are; others stay as they are."""
    n = F.round(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) * PIXELS_PER_DEGREE)
    off = lambda c: F.abs(F.col(c) * PIXELS_PER_DEGREE - F.round(F.col(c) * PIXELS_PER_DEGREE)) > 0.01
    straight = (F.col("x1") == F.col("x2")) | (F.col("y1") == F.col("y2"))
    whole = ~straight | (n < 2) | off("x1") | off("y1") | off("x2") | off("y2")
    cut = edges.withColumn("_n", F.when(whole, 1).otherwise(n).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    place = lambda a, b, i: F.when(i == F.col("_n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n"))
    i = F.col("_i")
    moved = {"x1": place("x1", "x2", i - 1), "y1": place("y1", "y2", i - 1), "x2": place("x1", "x2", i), "y2": place("y1", "y2", i)}
    return cut.withColumns(moved).drop("_n", "_i")


def split_area(members: DataFrame, catchments: DataFrame, split: Split) -> DataFrame:
    """(id, km2) of watersheds whose terminal catchment (depth 0) is replaced by its split part."""
    unit = catchments.select("comid", equal_area_km2(F.col("ring_lng"), F.col("ring_lat")).alias("km2"))
    rest = members.where("depth > 0").join(unit, "comid").select("id", "km2")
    part = split.terminals.select("id", equal_area_km2(F.col("xs"), F.col("ys")).alias("km2"))
    every = rest.join(split.terminals.select("id"), "id", "left_semi").unionByName(part)
    return every.groupBy("id").agg(F.sum("km2").alias("km2"))
