"""Layers and rasters on disk as the tables a run takes: shapefiles by basin, flow rasters on the world grid."""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.config import PIXELS_PER_DEGREE
from thalweg.sources.geotiff import GeoTiffSource, directory
from thalweg.sources.shapefile import ShapefileSource

#: North-west corner of the world grid of cells.
WEST, NORTH = -180.0, 90.0


class WrongProjection(ValueError):
    """A layer that is not in degrees on WGS84."""


def check_projection(path: str) -> None:
    """Raise unless the layer's sidecar, if it has one, names geographic coordinates on WGS84."""
    side = os.path.splitext(path.removeprefix("file://"))[0] + ".prj"
    if not os.path.exists(side):
        return
    with open(side, encoding="latin-1") as f:
        text = "".join(f.read().split()).upper().replace("_", "")
    if not text.startswith("GEOGCS[") or ("WGS1984" not in text and "WGS84" not in text):
        raise WrongProjection(f"{side}: only geographic coordinates on WGS84 are read")


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c if c in ("xs", "ys", "shape_type") else c.lower() for c in df.columns])


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A shapefile with its attributes in lower case; ring_lng and ring_lat hold a list for each ring."""
    check_projection(path)
    spark.dataSource.register(ShapefileSource)
    return _lower(spark.read.format("shapefile").load(path)).drop("shape_type").withColumnsRenamed({"xs": "ring_lng", "ys": "ring_lat"})


def _one_line(df: DataFrame) -> DataFrame:
    """Lines of several parts as one run of corners, the first part's first one leading."""
    return df.withColumns({"line_lng": F.flatten("ring_lng"), "line_lat": F.flatten("ring_lat")}).drop("ring_lng", "ring_lat")


def by_basin(spark: SparkSession, template: str, basins: list[int], cache: str | None = None, lines: bool = False) -> DataFrame:
    """The layer of each basin (its number stands for {basin} in the template) as one table with a `basin` column.

    cache: a folder of Parquet by basin. A basin found there is read from it, one that is not is written to it first.
    """

    def load(b: int) -> DataFrame:
        df = read_layer(spark, template.format(basin=b))
        df = _one_line(df) if lines else df
        ids = {c: F.col(c).cast("long") for c in ("comid", "up1", "up2", "up3", "up4") if c in df.columns}
        return df.withColumns(ids).withColumn("basin", F.lit(b))

    if not basins:
        raise ValueError("no basin to read")
    if cache is None:
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(load, basins))
    for b in basins:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/basin={b}/_SUCCESS")
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            load(b).drop("basin").write.mode("overwrite").parquet(f"{cache}/basin={b}")
    return spark.read.option("basePath", cache).parquet(*[f"{cache}/basin={b}" for b in basins])


def on_world_grid(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(r, c, value) of a raster's cells, numbered on the world grid of 1/1200 degree from its north-west corner."""
    spark.dataSource.register(GeoTiffSource)
    raster = directory(path.removeprefix("file://"))
    for step in (raster.dx, raster.dy):
        if abs(step * PIXELS_PER_DEGREE - 1) > 1e-6:
            raise ValueError(f"{path}: cells are {step} degrees wide, not 1/{PIXELS_PER_DEGREE}")
    row, column = round((NORTH - raster.y0) * PIXELS_PER_DEGREE), round((raster.x0 - WEST) * PIXELS_PER_DEGREE)
    reader = spark.read.format("geotiff")
    if window:
        reader = reader.option("window", ",".join(map(str, window)))
    return reader.load(path).select((F.col("r") + row).alias("r"), (F.col("c") + column).alias("c"), "value")


def read_cells(spark: SparkSession, direction: str, accumulation: str, basins: list[int], windows: dict[int, tuple] | None = None) -> DataFrame:
    """(basin, r, c, fdir, acc): cells of each basin's two rasters ({basin} in the templates), joined cell by cell.

    windows: the part of a basin's rasters that is needed; blocks outside of it are never opened.
    """

    def one(b: int) -> DataFrame:
        of = lambda t, name, kind: on_world_grid(spark, t.format(basin=b), (windows or {}).get(b)).select("r", "c", F.col("value").cast(kind).alias(name))
        return of(direction, "fdir", "int").join(of(accumulation, "acc", "long"), ["r", "c"]).select(F.lit(b).alias("basin"), "r", "c", "fdir", "acc")

    return functools.reduce(DataFrame.unionByName, map(one, basins))


def window_of(df: DataFrame, by: str, xs: Column, ys: Column) -> dict:
    """The box of all rings of each value of `by` (basins: a bounded number of rows on the driver)."""
    lows = {n: F.min(F.array_min(c)) for n, c in (("x0", xs), ("y0", ys))}
    highs = {n: F.max(F.array_max(c)) for n, c in (("x1", xs), ("y1", ys))}
    rows = df.groupBy(by).agg(*[v.alias(n) for n, v in {**lows, **highs}.items()]).collect()
    return {r[by]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows}
