"""Checks of an outlet table: one aggregation pass, reported in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("id", "lat", "lng")
#: Rules in the order they are reported, and what an error says.
RULES = {
    "unique": "outlet ids must be unique",
    "numeric": "lat and lng must be numbers",
    "lat": "lat must be greater than -60 and less than 85",
    "lng": "lng must be greater than -180 and less than 180",
    "id": "ids must not be empty",
}


class InvalidOutlets(ValueError):
    """An outlet table that cannot be used."""


def check_columns(df: DataFrame) -> None:
    for c in REQUIRED:
        if c not in df.columns:
            raise InvalidOutlets(f"column {c!r} is missing")


def violations(df: DataFrame) -> DataFrame:
    """(rule, n): how many rows (for `unique`: surplus rows) break each rule; in one pass but for the key count."""
    check_columns(df)
    lat, lng = F.expr("try_cast(lat as double)"), F.expr("try_cast(lng as double)")
    blank = F.col("id").isNull() | (F.length(F.trim(F.col("id").cast("string"))) == 0)
    per_id = df.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(lat.isNull() | lng.isNull() | F.isnan(lat) | F.isnan(lng)).alias("numeric"),
        F.count_if(~((lat > -60) & (lat < 85))).alias("lat"),
        F.count_if(~((lng > -180) & (lng < 180))).alias("lng"),
        F.count_if(blank).alias("id_"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    surplus = F.when(F.col("id").isNotNull(), F.col("n") - 1).otherwise(0)
    one = per_id.agg(total(surplus).alias("unique"), total("numeric").alias("numeric"), total("lat").alias("lat"), total("lng").alias("lng"), total("id_").alias("id"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in RULES])).alias("v")).select("v.*")


def validate(df: DataFrame) -> None:
    """Raise for the first rule, in order, that any row breaks."""
    found = {r["rule"]: r["n"] for r in violations(df).collect()}  # five rows
    for rule, text in RULES.items():
        if found[rule]:
            raise InvalidOutlets(f"{text} ({found[rule]} rows)")


def check_megabasins(df: DataFrame) -> None:
    """The level 2 layer must hold basin 11."""
    if df.where(F.col("basin") == 11).isEmpty():
        raise InvalidOutlets("the megabasin layer lacks basin 11")


def shape_outlets(df: DataFrame) -> DataFrame:
    """Optional columns resolved once: `area` becomes `area_reported` (a number or null), `name` exists, defaults set."""
    area = F.expr("try_cast(area as double)") if "area" in df.columns else F.lit(None).cast("double")
    name = F.col("name").cast("string") if "name" in df.columns else F.lit(None).cast("string")
    out = df.withColumns({"area_reported": area, "name": name})
    out = out.drop("area") if "area" in df.columns else out
    return out.withColumns({"area_calc": F.lit(0.0), "result": F.lit("failed")})
