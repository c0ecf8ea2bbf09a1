"""A run from files to files: outlets and layers in, watersheds, tables and a map out, all as the settings say."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.config import Settings
from thalweg.functions.geometry import flat_list
from thalweg.operators.dissolve import border_edges, closed, stitch_rings
from thalweg.operators.regions import edges_of, locate
from thalweg.operators.validate import check_columns, check_megabasins, validate
from thalweg.plans import pipeline
from thalweg.session import materialise
from thalweg.sources import layers, outlets, sinks, viewer


@dataclass(frozen=True)
class Files:
    """Paths; {basin} in those of basin layers and rasters stands for the basin's number. cache: a folder for layers
    once read. Rasters are needed for high resolution only, simplified catchments are optional."""

    outlets: str
    megabasins: str
    catchments: str
    rivers: str
    simplified: str | None = None
    direction: str | None = None
    accumulation: str | None = None
    cache: str | None = None


@dataclass(frozen=True)
class Outcome:
    """summary and failed by outlet; boundaries: (id, part, ring, xs, ys); rivers: what the map shows."""

    summary: DataFrame
    failed: DataFrame
    boundaries: DataFrame
    rivers: DataFrame


def map_rivers(run: pipeline.Run, reaches: DataFrame, settings: Settings) -> DataFrame:
    """(id, comid, ord, lengthkm, xs, ys): reaches of a watershed of its highest orders."""
    r = reaches.select("comid", "ord", "lengthkm", F.col("line_lng").alias("xs"), F.col("line_lat").alias("ys"))
    top = pipeline.upstream_totals(r.select("comid", F.col("ord").alias("top")), run.jumps, maxima=("top",))
    ends = run.located.select("id", "comid").join(top, "comid").select("id", "top")
    rows = run.members.select("id", "comid").join(r, "comid").join(ends, "id")
    return rows.where(F.col("ord") >= F.col("top") - settings.num_stream_orders).drop("top")


def delineate(spark: SparkSession, files: Files, settings: Settings) -> Outcome:
    """Read, validate, run. Only basins that hold an outlet are opened; there are at most as many as in their layer."""
    o = outlets.read_outlets(spark, files.outlets)
    check_columns(o)
    validate(o)
    mega = layers.read_layer(spark, files.megabasins).select(F.col("basin").cast("int").alias("basin"), "ring_lng", "ring_lat")
    check_megabasins(mega)
    near = locate(o, "id", "lng", "lat", mega, "basin", "ring_lng", "ring_lat", settings.search_dist)
    basins = sorted(r["basin"] for r in near.select("basin").distinct().collect())
    if not basins:
        raise ValueError("no outlet lies in any basin")
    cached = lambda kind: f"{files.cache}/{kind}" if files.cache else None
    cats = layers.by_basin(spark, files.catchments, basins, cached("catchments"))
    simple = layers.by_basin(spark, files.simplified, basins, cached("simplified")) if files.simplified else None
    reaches = layers.by_basin(spark, files.rivers, basins, cached("rivers"), lines=True)
    reaches = reaches.withColumnRenamed("order", "ord") if "order" in reaches.columns else reaches
    inputs = pipeline.Inputs(o, mega, cats, reaches, simple)
    run, split = pipeline.run_batch(inputs, settings), None
    if settings.high_res and files.direction and files.accumulation:
        ends = cats.join(run.located.select("comid").distinct(), "comid", "left_semi")
        boxes = layers.window_of(ends, "basin", flat_list(F.col("ring_lng"), True), flat_list(F.col("ring_lat"), True))
        cells = layers.read_cells(spark, files.direction, files.accumulation, sorted(boxes), boxes)
        run, split = pipeline.refine(run, inputs, cells, settings)
    table = materialise(pipeline.summary(run, inputs, settings, with_distance=True, split=split), "summary")
    return Outcome(table, run.failed, pipeline.boundaries(run, inputs, settings, split), map_rivers(run, reaches, settings))


def dissolve_layer(spark: SparkSession, path: str) -> DataFrame:
    """(part, ring, xs, ys): all polygons of a shapefile as one, slivers closed. Its border is stitched in one task."""
    layer = layers.read_layer(spark, path).select(F.lit(1).alias("all"), "ring_lng", "ring_lat")
    border = border_edges(closed(edges_of(layer, "all", "ring_lng", "ring_lat")), ["all"])
    return stitch_rings(border, "all").drop("all")


def write(outcome: Outcome, settings: Settings) -> None:
    """The files of a run: a geodata file per watershed (output_ext: geojson, shp, parquet; empty: none), OUTPUT and
    FAILED tables (output_csv), and a map with its layers (make_map, map_rivers)."""
    folder, ext = settings.output_dir.rstrip("/"), settings.output_ext.lower().lstrip(".")
    label = F.initcap("result").alias("result")
    attributes = outcome.summary.where("result <> 'failed'").select("id", "name", label, "area_reported", "area_calc", "perc_diff", "lat", "lng", "lat_snap", "lng_snap")
    shapes = materialise(outcome.boundaries, "boundaries")
    if ext in ("geojson", "json"):
        sinks.write_each(sinks.geojson_features(shapes, "id", attributes=attributes).select("id", "geojson"), folder, f".{ext}")
    elif ext == "shp":
        sinks.write_shapefiles(shapes, attributes, folder)
    elif ext == "parquet":
        shapes.join(attributes, "id").write.mode("overwrite").parquet(f"{folder}/watersheds")
    elif ext:
        raise ValueError(f"output_ext {settings.output_ext!r} is not supported: geojson, json, shp, parquet or nothing")
    if settings.output_csv:
        sinks.write_summary(outcome.summary, f"{folder}/OUTPUT.csv")
        sinks.write_failures(outcome.failed, f"{folder}/FAILED.csv")
    if settings.make_map:
        place = settings.map_folder.rstrip("/")
        rounded = sinks.geojson_features(shapes, "id", attributes=attributes).join(attributes.select("id", "lat", "lng", "lat_snap", "lng_snap"), "id")
        viewer.write_layers(rounded, place)
        if settings.map_rivers:
            viewer.write_layers(sinks.river_features(outcome.rivers, "id"), place, "rivers")
        viewer.write_viewer(viewer.viewer_table(outcome.summary), f"{place}/_viewer.html", rivers=settings.map_rivers)
