"""Outlet tables from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators.validate import check_columns


def read_outlets(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of outlets with a heading: id stays text (leading zeros too), lat, lng and area become numbers or null.

    Blanks after commas are ignored; any other column is kept as text. Missing required columns raise.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=False, escape='"')
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    check_columns(raw)
    numbers = {c: F.expr(f"try_cast(`{c}` as double)") for c in ("lat", "lng", "area") if c in raw.columns}
    return raw.withColumns(numbers)
