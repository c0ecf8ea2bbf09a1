"""Outlet lines as they arrive: the same rules as in a batch, without state.

A line's verdict depends on the line alone, so no watermark is needed; reasons are found by higher-order functions
instead of explode and aggregate, which a stream could not do without keeping groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thalweg.operators.quarantine import OUTLET_RULES, check_value, split_cells


def first_reason() -> Column:
    """The first rule that the cells of a row (see split_cells) break, or null."""
    reason = None
    for col, name, kind, lo, hi in OUTLET_RULES:
        value = F.substring("_rest", 1, 1) if col == -2 else F.size("_cells").cast("string") if col == -1 else F.get("_cells", F.lit(col))
        broken = check_value(value, kind, lo, hi)
        reason = F.when(broken, name) if reason is None else reason.when(broken, name)
    return reason


def outlet_stream(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(typed outlets, failing lines with their reason) of a folder to which Parquet files of lines are added."""
    lines = split_cells(spark.readStream.schema(schema).parquet(path)).withColumn("reason", first_reason())
    number = lambda i: F.expr(f"try_cast(trim(_cells[{i}]) as double)")
    good = lines.where(F.col("reason").isNull()).select(
        "line_no", F.trim(F.col("_cells")[0]).alias("id"), number(1).alias("lat"), number(2).alias("lng"),
        F.nullif(F.trim(F.col("_cells")[3]), F.lit("")).alias("name"), number(4).alias("area"),
    )
    return good, lines.where(F.col("reason").isNotNull()).select("line_no", "line", "reason")
