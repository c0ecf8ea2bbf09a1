"""Writers of results."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions.geometry import coordinates_json
from thalweg.sources.shapefile import polygon_layer


def geojson_features(rings: DataFrame, by: str, digits: int = 5, attributes: DataFrame | None = None) -> DataFrame:
    """(by, geojson): one MultiPolygon feature per key from rows (by, part, ring, xs, ys), coordinates rounded.

    attributes: a row per key, whose columns become the feature's properties.
    """
    coords = rings.withColumn("_c", coordinates_json(F.col("xs"), F.col("ys"), digits))
    join = lambda a: F.concat(F.lit("["), F.concat_ws(",", a), F.lit("]"))
    part = coords.groupBy(by, "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "_c"))), lambda s: s["_c"]).alias("r"))
    poly = part.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("part", join("r").alias("p")))), lambda s: s["p"]).alias("ps"))
    if attributes is not None:
        poly = poly.join(attributes, by)
    props = F.to_json(F.struct(by, *[c for c in (attributes.columns if attributes is not None else ()) if c != by]))
    text = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"MultiPolygon","coordinates":'), join("ps"), F.lit("}}"))
    return poly.select(by, text.alias("geojson"))


def river_features(lines: DataFrame, by: str, digits: int = 5) -> DataFrame:
    """(by, geojson): the reaches of each watershed as a feature collection, rows (by, comid, ord, lengthkm, xs, ys)."""
    geometry = F.concat(F.lit('{"type":"LineString","coordinates":'), coordinates_json(F.col("xs"), F.col("ys"), digits), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("comid", "ord", "lengthkm")), F.lit(',"geometry":'), geometry, F.lit("}"))
    every = lines.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("comid", feature.alias("f")))).alias("fs"))
    return every.select(by, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.transform("fs", lambda s: s["f"])), F.lit("]}")).alias("geojson"))


def write_features(features: DataFrame, path: str) -> None:
    """Features as line-delimited GeoJSON, one per watershed."""
    features.select("geojson").write.mode("overwrite").text(path)


def file_name(key: Column) -> Column:
    """A name for a key's file: letters, digits and ._-+~ only, and another one for every key."""
    return F.replace(F.replace(F.url_encode(key.cast("string")), F.lit("%"), F.lit("~")), F.lit("*"), F.lit("~2A"))


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_each(rows: DataFrame, folder: str, ending: str) -> int:
    """One file per row (key, text): Spark writes them side by side, wherever `folder` is; then each gets its name.

    Returns how many. The driver handles names only.
    """
    spark, (key, text) = rows.sparkSession, rows.columns
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit("n"), file_name(F.col(key))).alias("_name"), F.col(text).alias("value")).repartition("_name").write.partitionBy("_name").text(draft)
    target, fs = _hadoop(spark, draft)
    n = 0
    for part in fs.listStatus(target):
        name = part.getPath().getName()
        if not name.startswith("_name=n"):
            continue
        for file in fs.listStatus(part.getPath()):
            final, _ = _hadoop(spark, f"{folder}/{name.removeprefix('_name=n')}{ending}")
            fs.delete(final, False)
            fs.rename(file.getPath(), final)
            n += 1
    fs.delete(target, True)
    return n


def write_shapefiles(rings: DataFrame, attributes: DataFrame, folder: str) -> int:
    """One shapefile per watershed, with its attributes. Contents are made where the rows are and go through the driver
    one file at a time, to any file system."""
    spark = rings.sparkSession
    kinds = [(c, k) for c, k in attributes.dtypes]
    flat = rings.select("id", "part", "ring", "xs", "ys").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "ring", "xs", "ys"))).alias("_r"))
    rows = flat.join(attributes.withColumn("_name", file_name(F.col("id"))), "id").select("_name", F.col("_r.xs").alias("_xs"), F.col("_r.ys").alias("_ys"), *attributes.columns)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files = polygon_layer([([row[c] for c, _ in kinds], list(zip(row["_xs"], row["_ys"])))], kinds)
                yield pa.RecordBatch.from_arrays([pa.array([f"{row['_name']}.{e}" for e in files]), pa.array(list(files.values()), pa.binary())], ["name", "content"])

    n = 0
    for row in rows.mapInArrow(run, "name string, content binary").toLocalIterator():
        target, fs = _hadoop(spark, f"{folder}/{row['name']}")
        out = fs.create(target, True)
        out.write(bytes(row["content"]))
        out.close()
        n += row["name"].endswith(".shp")
    return n


def write_summary(summary: DataFrame, path: str, single: bool = True) -> None:
    """The summary as CSV with a heading; `single` brings the batch's rows (one per outlet) into one file."""
    (summary.coalesce(1) if single else summary).write.mode("overwrite").option("header", True).csv(path)


def write_failures(failed: DataFrame, path: str) -> bool:
    """Failures as CSV with the headings ID and EXPLANATION, quoted where needed; nothing if there are none."""
    if failed.isEmpty():
        return False
    failed.select(F.col("id").alias("ID"), F.col("explanation").alias("EXPLANATION")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def cache_layer(df: DataFrame, path: str, by: str = "basin") -> None:
    """A layer as Parquet by basin; nothing happens if it exists."""
    df.write.mode("ignore").partitionBy(by).parquet(path)
