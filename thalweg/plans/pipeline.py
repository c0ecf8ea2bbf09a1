"""A whole watershed run as one program: outlets in, one summary row per outlet and a failure table out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.config import Settings
from thalweg.functions.geometry import equal_area_km2, geodesic_m, line_start, shoelace
from thalweg.functions.numeric import percent_difference, significant
from thalweg.operators.dissolve import border_edges, closed, fill_holes, simplify, stitch_rings
from thalweg.operators.network import Jumps, drains, jump_tables, upstream, upstream_totals
from thalweg.operators.regions import edges_of, locate
from thalweg.operators.relocate import NO_MATCH, accept_terminal, search_reaches
from thalweg.operators.validate import check_megabasins, shape_outlets
from thalweg.plans.high_resolution import Split, on_grid, split_terminals
from thalweg.session import materialise

NO_BASIN = "not in any level 2 basin"
NO_CATCHMENT = "not in any unit catchment"


@dataclass(frozen=True)
class Inputs:
    """outlets(id, lat, lng[, name, area]); megabasins(basin, rings); catchments(comid, basin, rings); reaches.

    Rings are ring_lng and ring_lat, one list of coordinates or a list for each ring. simplified: catchments of
    simpler shapes, for watersheds drawn in low resolution; without it they are drawn from the full ones.
    """

    outlets: DataFrame
    megabasins: DataFrame
    catchments: DataFrame
    reaches: DataFrame
    simplified: DataFrame | None = None


@dataclass(frozen=True)
class Run:
    """Results by outlet: `located` (basin, comid, uparea) and `failed` (id, explanation); `jumps` is the network's."""

    outlets: DataFrame
    located: DataFrame
    failed: DataFrame
    jumps: Jumps

    @property
    def members(self) -> DataFrame:
        """(id, comid, depth): the reaches of each outlet's watershed."""
        return upstream(self.located, "id", "comid", self.jumps)


def locate_outlets(inputs: Inputs, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(located, failed). Every outlet is in exactly one of them."""
    o = inputs.outlets
    # keys found are used more than once below, for what has one and for what has none
    basin = locate(o, "id", "lng", "lat", inputs.megabasins, "basin", "ring_lng", "ring_lat", settings.search_dist).select("id", "basin")
    basin = materialise(basin, "basin-of-outlet")
    in_basin = o.join(basin, "id")
    no_basin = o.join(basin, "id", "left_anti").select("id", F.lit(NO_BASIN).alias("explanation"))
    unit = locate(in_basin, "id", "lng", "lat", inputs.catchments, "comid", "ring_lng", "ring_lat", settings.search_dist, within="basin").select("id", "comid")
    unit = materialise(unit, "catchment-of-outlet")
    with_reach = unit.join(inputs.reaches.select("comid", "uparea"), "comid")
    no_unit = in_basin.join(with_reach, "id", "left_anti").select("id", F.lit(NO_CATCHMENT).alias("explanation"))
    failed = no_basin.unionByName(no_unit)
    located = in_basin.join(with_reach, "id")
    if settings.match_areas:
        located = materialise(accept_terminal(located.withColumnRenamed("area_reported", "area"), settings), "located")
        kept = located.where("accepted").select("id", "comid", "uparea")
        moved = search_reaches(located.where(~F.col("accepted")), inputs.reaches, settings).select("id", "comid", "uparea")
        both = kept.unionByName(moved)
        failed = failed.unionByName(located.join(both, "id", "left_anti").select("id", F.lit(NO_MATCH).alias("explanation")))
        located = in_basin.join(both, "id")
    return located, failed


def run_batch(inputs: Inputs, settings: Settings, jumps: Jumps | None = None) -> Run:
    """Validate the layers, place the outlets. jumps: tables of the network, if it has them already."""
    check_megabasins(inputs.megabasins)
    shaped = shape_outlets(inputs.outlets)
    inputs = replace(inputs, outlets=shaped)
    located, failed = locate_outlets(inputs, settings)
    located = materialise(located.select("id", "basin", "comid", "uparea"), "outlets")
    return Run(shaped, located, failed, jumps or jump_tables(drains(inputs.reaches)))


def low_resolution(uparea, settings: Settings):
    """Whether a watershed is drawn from simplified shapes: always in a low-resolution run, else above the limit."""
    return F.lit(True) if not settings.high_res else F.col(uparea) > settings.low_res_threshold


def refine(run: Run, inputs: Inputs, cells: DataFrame, settings: Settings) -> tuple[Run, Split]:
    """The terminal catchments of watersheds up to the limit, split along the raster; the others stay as they are.

    Outlets that cannot be split fail; the run returned has them among its failures.
    """
    fine = run.located.where(~low_resolution("uparea", settings)).join(catchments_above(run, inputs), "comid")
    fine = fine.join(run.outlets.select("id", "lat", "lng"), "id")
    split = split_terminals(fine.select("id", "lng", "lat", "comid", "n_catchments"), inputs.catchments, cells, settings)
    located = run.located.join(split.failed, "id", "left_anti")
    return Run(run.outlets, located, run.failed.unionByName(split.failed), run.jumps), split


def catchments_above(run: Run, inputs: Inputs) -> DataFrame:
    """(comid, n_catchments) of every reach."""
    return upstream_totals(inputs.reaches.select("comid", F.lit(1).cast("bigint").alias("n_catchments")), run.jumps, sums=("n_catchments",))


def _smoothed(rings: DataFrame, settings: Settings) -> DataFrame:
    """Holes up to the limit filled, and the boundary simplified if set."""
    if settings.fill:
        rings = fill_holes(rings, shoelace(F.col("xs"), F.col("ys")), settings.fill_area())
    if settings.simplify:
        rings = simplify(rings, settings.simplify_tolerance)
    return rings


def _shed_members(run: Run, settings: Settings) -> DataFrame:
    """(shed, unit, coarse): the reaches of each terminal reach's watershed, once however many outlets share it, and
    whether it is drawn in low resolution."""
    ends = run.located.select("comid", low_resolution("uparea", settings).alias("coarse")).groupBy("comid").agg(F.max("coarse").alias("coarse"))
    members = upstream(ends, "comid", "comid", run.jumps, "unit").join(ends, "comid")
    return materialise(members.select(F.col("comid").alias("shed"), "unit", "coarse"), "members")


def _sheds(members: DataFrame, inputs: Inputs, settings: Settings) -> DataFrame:
    """(shed, part, ring, xs, ys): the boundary of each. Low resolution is made of the simplified layer, if there is
    one; slivers are closed, holes filled and the boundary simplified as set."""
    sides = ["x1", "y1", "x2", "y2"]
    layers = [(inputs.catchments, None)] if inputs.simplified is None else [(inputs.catchments, False), (inputs.simplified, True)]
    own = None
    for layer, coarse in layers:
        edges = materialise(closed(edges_of(layer, "comid", "ring_lng", "ring_lat")), "edges").select(F.col("comid").alias("unit"), *sides)
        rows = members if coarse is None else members.where(F.col("coarse") == coarse)
        rows = rows.join(edges, "unit").select("shed", *sides)
        own = rows if own is None else own.unionByName(rows)
    return _smoothed(stitch_rings(border_edges(own, ["shed"]), "shed"), settings)


def boundaries(run: Run, inputs: Inputs, settings: Settings, split: Split | None = None) -> DataFrame:
    """(id, part, ring, xs, ys): each watershed's catchments dissolved, slivers closed, small holes filled, simplified
    if set. With a split, the split part stands for the terminal catchment of those that have one."""
    if split is None:
        sheds = _sheds(_shed_members(run, settings), inputs, settings)
        return run.located.select("id", F.col("comid").alias("shed")).join(sheds, "shed").drop("shed")
    whole = replace(run, located=run.located.join(split.terminals.select("id"), "id", "left_anti"))
    kind = dict(run.located.dtypes)["id"]
    edges = edges_of(inputs.catchments, "comid", "ring_lng", "ring_lat")
    part = edges_of(split.terminals, "id", "xs", "ys").withColumn("comid", F.lit(None).cast(dict(edges.dtypes)["comid"]))
    edges = on_grid(edges.withColumn("id", F.lit(None).cast(kind)).unionByName(part))
    edges = materialise(closed(edges), "edges")
    sides = ["x1", "y1", "x2", "y2"]
    above = run.members.where("depth > 0").join(split.terminals.select("id"), "id", "left_semi")
    own = above.select("id", "comid").join(edges.where(F.col("comid").isNotNull()).select("comid", *sides), "comid").select("id", *sides)
    own = own.unionByName(edges.where(F.col("id").isNotNull()).select("id", *sides))
    rings = _smoothed(stitch_rings(border_edges(own, ["id"]), "id"), settings)
    return rings.unionByName(boundaries(whole, inputs, settings))


def summary(run: Run, inputs: Inputs, settings: Settings, with_distance: bool = False, split: Split | None = None) -> DataFrame:
    """One row per outlet, failed ones included, with the measured watershed.

    A watershed's area is that of its boundary: shells less holes. With a split, the pour point of those that have one
    is the snapped outlet.
    """
    ring = equal_area_km2(F.col("xs"), F.col("ys"))
    measure = lambda rings, by: rings.groupBy(by).agg(F.sum(F.when(F.col("ring") == 0, ring).otherwise(-ring)).alias("km2"))
    members = _shed_members(run, settings)
    count = members.groupBy("shed").agg(F.count(F.lit(1)).alias("n_catchments"))
    if split is None:  # measured once for each terminal reach
        sheds = count.join(measure(_sheds(members, inputs, settings), "shed"), "shed", "left")
        measured = run.located.select("id", F.col("comid").alias("shed")).join(sheds, "shed").drop("shed")
    else:
        count = run.located.select("id", F.col("comid").alias("shed")).join(count, "shed").drop("shed")
        measured = count.join(measure(boundaries(run, inputs, settings, split), "id"), "id", "left")
    start = line_start(F.col("line_lng"), F.col("line_lat"))
    ends = inputs.reaches.select("comid", start.alias("s"))
    found = run.located.join(ends, "comid").join(measured, "id").select("id", "basin", "comid", "uparea", "n_catchments", "km2", "s")
    if split is not None:
        point = F.struct(F.col("lng_snap").alias("lng"), F.col("lat_snap").alias("lat"))
        found = found.join(split.terminals.select("id", point.alias("p")), "id", "left").withColumn("s", F.coalesce("p", "s"))
    out = run.outlets.select("id", "lat", "lng", "name", "area_reported").join(found, "id", "left")
    area = F.when(F.col("km2").isNotNull(), significant(F.col("km2"), 3)).otherwise(F.lit(0.0))
    label = F.when(F.col("comid").isNull(), "failed").when(low_resolution("uparea", settings), "low res").otherwise("high res")
    cols = [
        "id", "lat", "lng", "name", "area_reported", "basin", "comid", "n_catchments",
        F.bround("s.lat", 3).alias("lat_snap"), F.bround("s.lng", 3).alias("lng_snap"),
        area.alias("area_calc"), label.alias("result"),
    ]
    if with_distance:
        cols.append(significant(geodesic_m("lat", "lng", "s.lat", "s.lng"), 2).alias("snap_dist"))
    out = out.select(*cols)
    diff = F.when(F.col("result") != "failed", percent_difference(F.col("area_calc"), F.col("area_reported")))
    return out.withColumn("perc_diff", diff)
