"""Moving an outlet to a nearby reach whose upstream area fits the reported one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.config import Settings
from thalweg.functions.numeric import relative_difference
from thalweg.operators.regions import lines_in_box

NO_MATCH = "no reach with a closely matching upstream area within the search distance"


def accept_terminal(outlets: DataFrame, settings: Settings) -> DataFrame:
    """Adds `pd`, the relative difference of areas, and `accepted`: as good as allowed, or nothing to compare with."""
    pd = relative_difference(F.col("uparea"), F.col("area"))
    return outlets.withColumn("pd", pd).withColumn("accepted", F.col("pd").isNull() | (F.col("pd") <= settings.area_matching_threshold))


def search_reaches(outlets: DataFrame, rivers: DataFrame, settings: Settings) -> DataFrame:
    """(id, comid, uparea, ring, pd): per outlet the best reach of the smallest box that holds one good enough.

    The box grows by steps; a reach belongs to the first box it meets, and is good enough if the difference is below
    the threshold. Of those in the first such box the smallest difference wins, then the smaller key. Outlets without
    any have no row. `uparea` is rounded to whole units, half to even.
    """
    ladder = settings.search_ladder()
    near = lines_in_box(outlets, "id", "lng", "lat", rivers, "comid", "line_lng", "line_lat", ladder[-1])
    steps = F.array(*[F.lit(w) for w in ladder])
    ring = F.size(F.filter(steps, lambda w: w < F.col("half_width"))) + 1
    found = near.withColumn("ring", ring).where(F.col("ring") <= len(ladder))
    found = found.join(outlets.select("id", "area"), "id").join(rivers.select("comid", "uparea"), "comid")
    found = found.withColumn("pd", relative_difference(F.col("uparea"), F.col("area"))).where(F.col("pd") < settings.area_matching_threshold)
    best = found.groupBy("id").agg(F.min(F.struct("ring", "pd", "comid", "uparea")).alias("m"))
    return best.select("id", F.col("m.comid").alias("comid"), F.bround("m.uparea", 0).alias("uparea"), F.col("m.ring").alias("ring"), F.col("m.pd").alias("pd"))
