"""Table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thalweg.session import kept


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; columns are pruned and filters pushed by whoever uses it.

    Its schema is read from the files once per session and path.
    """
    path = f"{folder}/{name}.parquet"
    schema = kept(spark, ("schema", path), lambda: spark.read.parquet(path).schema)
    return spark.read.schema(schema).parquet(path)
