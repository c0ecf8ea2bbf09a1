"""The domain tables with repeated rows taken together: one row per outlet id, reach and catchment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.sources.tables import table


def outlets(spark: SparkSession, d: str) -> DataFrame:
    """One row per id; repeated rows are alike but for when they were loaded."""
    t = table(spark, d, "outlets_sample").where(F.col("id").isNotNull())
    first = F.min_by(F.struct("lat", "lng", "name", "area"), "rec_no")
    return t.groupBy("id").agg(first.alias("o")).select("id", "o.*")


def reaches(spark: SparkSession, d: str) -> DataFrame:
    """One row per reach, with whatever value any of its rows has."""
    line = F.max(F.struct("line_lng", "line_lat"))
    cols = [F.max(c).alias(c) for c in ("basin", "up1", "up2", "up3", "up4", "uparea", "lengthkm", "ord", "riv_name")]
    return table(spark, d, "rivers").groupBy("comid").agg(*cols, line.alias("l")).select("comid", "basin", "up1", "up2", "up3", "up4", "uparea", "lengthkm", "ord", "riv_name", "l.*")


def catchments(spark: SparkSession, d: str) -> DataFrame:
    ring = F.max(F.struct("ring_lng", "ring_lat"))
    return table(spark, d, "catchments").groupBy("comid").agg(F.max("basin").alias("basin"), F.max("unitarea").alias("unitarea"), ring.alias("r")).select("comid", "basin", "unitarea", "r.*")


def megabasins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "megabasins").select("basin", "ring_lng", "ring_lat")


#: The same as common table expressions.
SQL = {
    "o": "o as (select id, arg_min(lat, rec_no) lat, arg_min(lng, rec_no) lng, arg_min(name, rec_no) as \"name\", arg_min(area, rec_no) area from outlets_sample where id is not null group by id)",
    "rv": "rv as (select comid, max(basin) basin, max(up1) up1, max(up2) up2, max(up3) up3, max(up4) up4, max(uparea) uparea, max(lengthkm) lengthkm, max(ord) ord, max(riv_name) riv_name, max(line_lng) line_lng, max(line_lat) line_lat from rivers group by comid)",
    "ca": "ca as (select comid, max(basin) basin, max(unitarea) unitarea, max(ring_lng) rx, max(ring_lat) ry from catchments group by comid)",
    "mb": "mb as (select basin, ring_lng rx, ring_lat ry from megabasins)",
}
