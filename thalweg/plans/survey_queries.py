"""Queries of the watershed operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.config import Settings
from thalweg.functions.geometry import bounds, equal_area_km2, geodesic_m, line_start, shoelace
from thalweg.functions.numeric import display, grid_ceil, grid_floor, percent_difference, relative_difference, significant
from thalweg.operators import dissolve, network, raster, regions, relocate, validate
from thalweg.plans import domain, fixtures, high_resolution, pipeline
from thalweg.session import kept, materialise
from thalweg.sources import sinks, viewer
from thalweg.sources.tables import table

LOW_RES = Settings(high_res=False)
#: Search distances of the nearest joins, in degrees.
BASIN_REACH, CATCHMENT_REACH = 0.25, 0.05
MATCHING = Settings(match_areas=True)
#: The largest rivers here are smaller than the usual limit between shapes.
SWITCH = Settings(low_res_threshold=500.0)
HOLE_LIMIT = 6.95e-4


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return domain.outlets(spark, d)


def _catchment_of(spark: SparkSession, d: str, reach: float = 0.0) -> DataFrame:
    return regions.locate(_placed(spark, d), "id", "lng", "lat", domain.catchments(spark, d), "comid", "ring_lng", "ring_lat", reach)


def _basin_of(spark: SparkSession, d: str, reach: float = 0.0) -> DataFrame:
    return regions.locate(_placed(spark, d), "id", "lng", "lat", domain.megabasins(spark, d), "basin", "ring_lng", "ring_lat", reach)


def _inputs(spark: SparkSession, d: str) -> pipeline.Inputs:
    return pipeline.Inputs(_placed(spark, d), domain.megabasins(spark, d), domain.catchments(spark, d), domain.reaches(spark, d))


def _jumps(spark: SparkSession, d: str, name: str = "rivers") -> network.Jumps:
    """Jump tables of a network depend on nothing else: they are written once per session and folder."""
    nets = {
        "rivers": lambda: network.drains(domain.reaches(spark, d)), "comb": lambda: network.drains(fixtures.comb(spark, d)),
        "tree": lambda: network.drains(fixtures.tree(spark, d)), "raster": lambda: raster.cell_drains(fixtures.cells(spark, d)),
    }
    return kept(spark, (name, d), lambda: network.jump_tables(nets[name](), name))


def _terminals(spark: SparkSession, d: str) -> DataFrame:
    """(id, comid) of outlets in a catchment that has a reach."""
    return _catchment_of(spark, d).join(domain.reaches(spark, d).select("comid"), "comid").select("id", "comid")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return network.upstream(_terminals(spark, d), "id", "comid", _jumps(spark, d))


def validate_outlets(spark, d):
    return validate.violations(table(spark, d, "outlets_sample"))


def shape_outlets(spark, d):
    return validate.shape_outlets(table(spark, d, "outlets_sample")).select("rec_no", "id", "lat", "lng", "name", "area_reported", "area_calc", "result")


def megabasin_join(spark, d):
    o = _placed(spark, d)
    return o.select("id").join(_basin_of(spark, d).select("id", "basin"), "id", "left")


def megabasin_nearest(spark, d):
    return _basin_of(spark, d, BASIN_REACH).select("id", "basin", F.round("distance", 6).alias("distance"))


def catchment_join(spark, d):
    return _placed(spark, d).select("id").join(_catchment_of(spark, d).select("id", "comid"), "id", "left")


def catchment_nearest(spark, d):
    return _catchment_of(spark, d, CATCHMENT_REACH).select("id", "comid", F.round("distance", 6).alias("distance"))


def box_search(spark, d):
    """Reaches that meet the largest search box around each outlet."""
    near = regions.lines_in_box(_placed(spark, d), "id", "lng", "lat", domain.reaches(spark, d), "comid", "line_lng", "line_lat", LOW_RES.search_ladder()[-1])
    return near.select("id", "comid", F.round("half_width", 6).alias("half_width"))


def basin_counts(spark, d):
    return _basin_of(spark, d).groupBy("basin").agg(F.countDistinct("id").alias("n_outlets"))


def failed_outlets(spark, d):
    return pipeline.locate_outlets(_inputs(spark, d), LOW_RES)[1]


def upstream_closure(spark, d):
    return _members(spark, d).select("id", "comid", "depth")


def _counted(net: DataFrame, jumps: network.Jumps) -> DataFrame:
    ones = net.select("comid", F.lit(1).cast("bigint").alias("n_upstream"))
    return network.upstream_totals(ones, jumps, sums=("n_upstream",), levels="levels")


def upstream_closure_wide(spark, d):
    """Number of reaches above each reach of the tree with four neighbours a reach, and how deep they go."""
    return _counted(fixtures.tree(spark, d), _jumps(spark, d, "tree"))


def upstream_closure_deep(spark, d):
    """The same of the comb, which is as deep as the lattice is high."""
    return _counted(fixtures.comb(spark, d), _jumps(spark, d, "comb"))


def network_faults(spark, d):
    return network.network_faults(domain.reaches(spark, d))


def network_faults_trunk(spark, d):
    """The rivers of order two and more as a network of their own: it names tributaries that it does not have."""
    return network.network_faults(domain.reaches(spark, d).where("ord >= 2"))


def reach_lookup(spark, d):
    r = domain.reaches(spark, d).select("comid", "uparea", "ord", "riv_name", line_start(F.col("line_lng"), F.col("line_lat")).alias("s"))
    return _catchment_of(spark, d).join(r, "comid").select("id", "comid", "uparea", "ord", "riv_name", F.col("s.lng").alias("lng_snap"), F.col("s.lat").alias("lat_snap"))


def watershed_catchments(spark, d):
    c = domain.catchments(spark, d).select("comid", F.col("unitarea").alias("sum_unitarea"), F.lit(1).cast("bigint").alias("n_catchments"))
    own = domain.reaches(spark, d).select("comid").join(c, "comid")
    totals = network.upstream_totals(own, _jumps(spark, d), sums=("n_catchments", "sum_unitarea"), levels="longest")
    return _terminals(spark, d).join(totals, "comid").select("id", "n_catchments", F.round("sum_unitarea", 3).alias("sum_unitarea"), "longest")


def _with_uparea(spark, d):
    up = domain.reaches(spark, d).select("comid", "uparea")
    return _placed(spark, d).join(_catchment_of(spark, d).select("id", "comid"), "id").join(up, "comid")


def area_match_accept(spark, d):
    a = relocate.accept_terminal(_with_uparea(spark, d), MATCHING)
    return a.select("id", "comid", F.round("pd", 6).alias("pd"), "accepted")


def area_match_search(spark, d):
    o = _placed(spark, d).where(F.col("area") > 0)
    return relocate.search_reaches(o, domain.reaches(spark, d), MATCHING).select("id", "comid", "uparea", "ring", F.round("pd", 6).alias("pd"))


def resolution_switch(spark, d):
    label = F.when(pipeline.low_resolution("uparea", SWITCH), "low res").otherwise("high res")
    return _with_uparea(spark, d).select("id", "comid", label.alias("result"))


def _lattice_sheds(spark, d):
    """Watersheds of the comb's reaches at the foot of each column, and their square catchments."""
    t = fixtures.comb(spark, d)
    o = t.where("r = 0").select(F.col("comid").alias("o"), "comid")
    up = network.upstream(o, "o", "comid", _jumps(spark, d, "comb"), "comid")
    return up.join(fixtures.lattice(spark, d), "comid").select("o", "comid", "r", "c", "unitarea")


def _square_edges(cells: DataFrame, by: list[str]) -> DataFrame:
    return raster.cell_edges(cells, by)


def dissolve_edges(spark, d):
    border = dissolve.border_edges(_square_edges(_lattice_sheds(spark, d), ["o"]), ["o"])
    return border.select("o", *[F.col(c).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")])


def dissolve_bounds(spark, d):
    border = dissolve.border_edges(_square_edges(_lattice_sheds(spark, d), ["o"]), ["o"])
    return border.groupBy("o").agg(
        F.min("x1").cast("bigint").alias("xmin"), F.min(F.least("y1", "y2")).cast("bigint").alias("ymin"),
        F.max("x2").cast("bigint").alias("xmax"), F.max(F.greatest("y1", "y2")).cast("bigint").alias("ymax"), F.count(F.lit(1)).alias("n_edges"),
    )


def _lattice_rings(spark, d):
    border = dissolve.border_edges(_square_edges(_lattice_sheds(spark, d), ["o"]), ["o"])
    return dissolve.stitch_rings(border, "o")


def dissolve_rings(spark, d):
    """Per watershed the planar area of its stitched rings: as many cells as it has catchments."""
    rings = _lattice_rings(spark, d).withColumn("a", shoelace(F.col("xs"), F.col("ys")))
    return rings.groupBy("o").agg(F.count_if(F.col("ring") == 0).alias("n_parts"), F.sum("a").cast("bigint").alias("area"))


def fill_holes(spark, d):
    r = fixtures.rings(spark, d)
    kept = dissolve.fill_holes(r, F.col("ring_area"), HOLE_LIMIT)
    return kept.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n_rings"), F.round(F.sum(F.when(F.col("ring") > 0, F.col("ring_area"))), 8).alias("hole_area"))


def largest_part(spark, d):
    holes = fixtures.rings(spark, d).where("ring > 0")
    return dissolve.largest_part(holes, "poly_id", F.col("ring_area"), "ring").select("poly_id", "ring", "ring_area")


def simplify_rings(spark, d):
    r = domain.catchments(spark, d).select("comid", F.col("ring_lng").alias("xs"), F.col("ring_lat").alias("ys"), F.size("ring_lng").alias("before"))
    return dissolve.simplify(r, LOW_RES.simplify_tolerance).select("comid", "before", F.size("xs").alias("after"))


def close_slivers(spark, d):
    e = regions.edges_of(domain.catchments(spark, d), "comid", "ring_lng", "ring_lat")
    return dissolve.snapped(e).groupBy("comid").agg(F.count(F.lit(1)).alias("n_edges"))


def equal_area(spark, d):
    c = domain.catchments(spark, d)
    return c.select("comid", F.round(equal_area_km2(F.col("ring_lng"), F.col("ring_lat")), 4).alias("km2"))


def planar_area(spark, d):
    c = domain.catchments(spark, d)
    return c.select("comid", F.round(F.abs(shoelace(F.col("ring_lng"), F.col("ring_lat"))), 9).alias("deg2"))


def layer_bounds(spark, d):
    c = domain.catchments(spark, d).select("basin", bounds(F.col("ring_lng"), F.col("ring_lat")).alias("b"))
    return c.groupBy("basin").agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def snap_distance(spark, d):
    r = domain.reaches(spark, d).select("comid", line_start(F.col("line_lng"), F.col("line_lat")).alias("s"))
    o = _placed(spark, d).join(_catchment_of(spark, d), "id").join(r, "comid")
    return o.select("id", "comid", F.round(geodesic_m("lat", "lng", "s.lat", "s.lng"), 3).alias("metres"))


def sigfig_round(spark, d):
    t = table(spark, d, "orders")
    price = F.col("o_totalprice").cast("double")
    return t.select("o_orderkey", significant(price, 3).alias("three"), significant(-price / 1000, 2).alias("two"), F.bround(price / 1000, 0).alias("whole"))


def percent_differences(spark, d):
    o = _with_uparea(spark, d)
    return o.select(
        "id", percent_difference(significant(F.col("uparea"), 3), F.col("area")).alias("perc_diff"),
        F.round(relative_difference(F.col("uparea"), F.col("area")), 6).alias("pd"),
    )


def window_align(spark, d):
    b = domain.catchments(spark, d).select("comid", bounds(F.col("ring_lng"), F.col("ring_lat")).alias("b"))
    low = lambda c: F.round(grid_floor(F.col(c)), 9)
    high = lambda c: F.round(grid_ceil(F.col(c)), 9)
    return b.select("comid", low("b.xmin").alias("xmin"), low("b.ymin").alias("ymin"), high("b.xmax").alias("xmax"), high("b.ymax").alias("ymax"))


def _mask():
    """The part of each tile of the raster that counts as the catchment."""
    return (F.col("c") + F.col("r") % 64 * 2) >= 24


def raster_mask(spark, d):
    m = raster.masked(fixtures.cells(spark, d), _mask())
    return m.groupBy("r").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("fdir").alias("sum_fdir"), F.min("c").alias("first"), F.max("c").alias("last"))


def _accumulated(spark, d):
    cells = fixtures.cells(spark, d)
    return cells.join(raster.accumulate(cells, jumps=_jumps(spark, d, "raster")), "k")


def raster_accumulation(spark, d):
    return _accumulated(spark, d).select("r", "c", "acc")


def raster_streams(spark, d):
    return raster.streams(_accumulated(spark, d), F.lit(1), Settings(threshold_single=20)).select("r", "c", "acc")


def _pour_points(spark, d):
    """A point per supplier, dealt out over the raster's rows."""
    h = fixtures.cells(spark, d).agg((F.max("r") + 1).alias("h"))
    o = table(spark, d, "supplier").crossJoin(F.broadcast(h))  # one row
    return o.select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_suppkey") * 37 % 64).alias("pc"), (F.col("s_suppkey") * 53 % F.col("h")).alias("pr"))


def snap_pour_point(spark, d):
    tile = lambda r: F.floor(F.col(r) / 64).alias("tile")
    s = raster.streams(_accumulated(spark, d), F.lit(1), Settings(threshold_single=20)).select("*", tile("r"))
    return raster.snap_points(_pour_points(spark, d).select("*", tile("pr")), s, ["tile"])


def _traced(spark, d):
    """What drains to each cell of the raster, every cell being an outlet."""
    starts = fixtures.cells(spark, d).select(F.col("k").alias("o"), "k")
    return network.upstream(starts, "o", "k", _jumps(spark, d, "raster"), "k")


def d8_upstream(spark, d):
    return _traced(spark, d).select("o", "k", "depth")


def polygonize_cells(spark, d):
    """The border of what drains to each cell."""
    return raster.upstream_borders(fixtures.cells(spark, d), jumps=lambda: _jumps(spark, d, "raster"))


def split_terminal(spark, d):
    """The largest part of what drains to each cell, holes aside."""
    shells = raster.upstream_shells(fixtures.cells(spark, d), jumps=lambda: _jumps(spark, d, "raster"))
    return shells.select("o", F.col("area").cast("bigint").alias("area"), "n_corners")


def _raster_world(spark, d):
    """The raster as four catchments of 16 columns, with its supplier points as outlets."""
    cells = fixtures.cells(spark, d)
    cells = materialise(cells.join(raster.accumulate(cells), "k"), "raster")
    h = cells.agg(F.max("r") + 1).first()[0]
    x = lambda c: high_resolution.WEST + c / 1200
    y = lambda r: high_resolution.NORTH - r / 1200
    ring = lambda k: ([x(16 * k), x(16 * k + 16), x(16 * k + 16), x(16 * k), x(16 * k)], [y(h), y(h), y(0), y(0), y(h)])
    catchments = spark.createDataFrame([(k, *ring(k)) for k in range(4)], "comid long, ring_lng array<double>, ring_lat array<double>")
    o = _pour_points(spark, d).select("id", high_resolution.cell_x(F.col("pc")).alias("lng"), high_resolution.cell_y(F.col("pr")).alias("lat"), F.floor(F.col("pc") / 16).alias("comid"), F.lit(1).alias("n_catchments"))
    return o, catchments, cells


def high_res_split(spark, d):
    """Terminal catchments split along the raster: traced cells and planar size in cells of the largest part."""
    o, catchments, cells = _raster_world(spark, d)
    split = high_resolution.split_terminals(o, catchments, cells, Settings(threshold_single=20))
    size = F.round(F.abs(shoelace(F.col("xs"), F.col("ys"))) * 1200 * 1200, 0).cast("bigint")
    return split.terminals.select("id", "n_cells", size.alias("size"), F.round("lng_snap", 6).alias("lng_snap"), F.round("lat_snap", 6).alias("lat_snap"))


def _map_rivers(spark, d):
    r = domain.reaches(spark, d).select("comid", "ord", "lengthkm", "line_lng", "line_lat")
    top = network.upstream_totals(r.select("comid", F.col("ord").alias("top")), _jumps(spark, d), maxima=("top",))
    ends = _terminals(spark, d).join(top, "comid").select("id", "top")
    rows = _members(spark, d).join(r, "comid").join(ends, "id")
    return rows.where(F.col("ord") >= F.col("top") - LOW_RES.num_stream_orders)


def river_map_filter(spark, d):
    return _map_rivers(spark, d).select("id", "comid", "ord", F.bround("lengthkm", 1).alias("lengthkm"), F.round(F.sqrt("ord"), 6).alias("width"))


def river_map_features(spark, d):
    rows = _map_rivers(spark, d).select("id", "comid", "ord", "lengthkm", F.col("line_lng").alias("xs"), F.col("line_lat").alias("ys"))
    return sinks.river_features(rows, "id")


def geojson_features(spark, d):
    """Catchments as features."""
    c = domain.catchments(spark, d).select("comid", F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("ring_lng").alias("xs"), F.col("ring_lat").alias("ys"))
    return sinks.geojson_features(c, "comid")


def _run(spark, d, settings=LOW_RES):
    inputs = _inputs(spark, d)
    return pipeline.run_batch(inputs, settings, _jumps(spark, d)), inputs, settings


def watershed_boundaries(spark, d):
    """The dissolved boundary of every outlet's watershed."""
    return sinks.geojson_features(pipeline.boundaries(*_run(spark, d)), "id")


def watershed_polygons(spark, d):
    """Parts, corners, area and bounds of every outlet's dissolved watershed, all holes kept."""
    rings = pipeline.boundaries(*_run(spark, d, Settings(high_res=False, fill=False)))
    b = bounds(F.col("xs"), F.col("ys"))
    rings = rings.select("id", "ring", (F.size("xs") - 1).alias("n"), shoelace(F.col("xs"), F.col("ys")).alias("a"), b.alias("b"))
    return rings.groupBy("id").agg(
        F.count_if(F.col("ring") == 0).alias("n_parts"), F.sum("n").alias("n_edges"), F.round(F.sum("a"), 11).alias("deg2"),
        F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"),
    )


def watershed_summary(spark, d):
    return pipeline.summary(*_run(spark, d))


def watershed_summary_matched(spark, d):
    """The run that moves outlets to reaches of fitting area, with snap distances."""
    return pipeline.summary(*_run(spark, d, Settings(high_res=False, match_areas=True, search_dist=0.025)), with_distance=True)


def viewer_table(spark, d):
    return viewer.viewer_table(watershed_summary(spark, d))


def display_formats(spark, d):
    o = _placed(spark, d)
    return o.select("id", display(F.col("area"), 0).alias("area"), display(F.col("lat"), 3).alias("lat"), display(F.col("lng"), 3).alias("lng"))


QUERIES = {
    f.__name__: f
    for f in (
        validate_outlets, shape_outlets, megabasin_join, megabasin_nearest, catchment_join, catchment_nearest, box_search, basin_counts, failed_outlets,
        upstream_closure, upstream_closure_wide, upstream_closure_deep, network_faults, network_faults_trunk, reach_lookup, watershed_catchments,
        area_match_accept, area_match_search, resolution_switch, dissolve_edges, dissolve_bounds, dissolve_rings, fill_holes, largest_part,
        simplify_rings, close_slivers, equal_area, planar_area, layer_bounds, snap_distance, sigfig_round, percent_differences, window_align,
        raster_mask, raster_accumulation, raster_streams, snap_pour_point, d8_upstream, polygonize_cells, split_terminal, high_res_split,
        river_map_filter, river_map_features, geojson_features, watershed_boundaries, watershed_polygons, watershed_summary, watershed_summary_matched, viewer_table, display_formats,
    )
}
