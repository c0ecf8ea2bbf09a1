"""River networks: everything upstream of given reaches, by doubling jumps.

A reach drains into one below it. Jump tables hold where water is after 1, 2, 4, ... reaches; what lies within 2^(k+1)
reaches of an outlet is what lies within 2^k of it, and what reaches that by one jump of 2^k. So a closure takes
a chain of log2(depth) equi-joins on keys, whatever its size, and no group is ever held in one place. The same operator traces a
flow-direction raster, where cells are the reaches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from thalweg.session import materialise

#: Neighbour columns, and the value that means none.
NEIGHBOURS = ("up1", "up2", "up3", "up4")
NONE = 0


def drains(rivers: DataFrame, key: str = "comid", neighbours: tuple[str, ...] = NEIGHBOURS) -> DataFrame:
    """(src, dst): water goes from reach src to dst. Neighbours that are not reaches themselves are left out."""
    edges = rivers.select(F.col(key).alias("dst"), F.explode(F.array(*neighbours)).alias("src"))
    edges = edges.where(F.col("src").isNotNull() & (F.col("src") != NONE) & F.col("dst").isNotNull()).distinct()
    return edges.join(rivers.select(F.col(key).alias("src")).distinct(), "src").select("src", "dst")


@dataclass(frozen=True)
class Jumps:
    """Tables (src, dst, step): where water of src is after `step` reaches, and every reach itself with step 0.

    plain: every reach has one way down and no path returns, so no reach is found twice.
    """

    tables: list[DataFrame]
    plain: bool


def jump_tables(edges: DataFrame, name: str = "jumps") -> Jumps:
    """Tables of 1, 2, 4, ... steps downstream, until no path is as long (or, with a cycle, longer than all reaches).

    They depend on the network alone and serve any number of closures.
    """
    first = materialise(edges.select("src", "dst", F.lit(1).alias("step")), f"{name}-0")
    counts = first.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    n, plain = counts[0], counts[1] <= 1
    steps, ended = [first], n == 0
    while not ended and 2 ** (len(steps) - 1) <= n:
        last = steps[-1]
        far = last.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        step = last.join(far, "dst").select("src", F.col("far").alias("dst"), (F.col("step") * 2).alias("step"))
        seen = Observation()
        step = materialise((step if plain else step.distinct()).observe(seen, F.count(F.lit(1)).alias("n")), f"{name}-{len(steps)}")
        ended = seen.get["n"] == 0
        if not ended:
            steps.append(step)
    if n == 0:
        return Jumps([], True)
    here = first.select("src").union(first.select("dst")).distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("step"))
    here = materialise(here, f"{name}-here")
    return Jumps([t.unionByName(here) for t in steps], plain and ended)


def upstream(outlets: DataFrame, outlet: str, start: str, jumps: Jumps, node: str = "comid") -> DataFrame:
    """(outlet, node, depth): all reaches from which water comes to the outlet's reach, that reach (depth 0) included.

    A reach that has several ways down is listed once, with its least depth. Outlets without a reach give nothing.
    """
    key = outlets.where(F.col(start).isNotNull()).select(F.col(outlet).alias("_o"), F.col(start).alias("_n")).distinct()
    reached = key.select("_o", "_n", F.lit(0).alias("depth"))
    for table in jumps.tables:
        step = table.select(F.col("dst").alias("_n"), F.col("src").alias("_far"), "step")
        reached = reached.join(step, "_n", "left").select(
            "_o", F.coalesce("_far", "_n").alias("_n"), (F.col("depth") + F.coalesce("step", F.lit(0))).alias("depth")
        )
        if not jumps.plain:
            reached = reached.groupBy("_o", "_n").agg(F.min("depth").alias("depth"))
    return reached.select(F.col("_o").alias(outlet), F.col("_n").alias(node), "depth")


def upstream_totals(
    values: DataFrame, jumps: Jumps, node: str = "comid", sums: tuple[str, ...] = (), maxima: tuple[str, ...] = (), levels: str | None = None
) -> DataFrame:
    """(node, *sums, *maxima[, levels]): columns of `values` (a row per node) added up, or their largest taken, over all
    nodes upstream of each node, itself included; `levels` counts the steps to the farthest of them.

    Where every reach has one way down, totals double as jumps do: what lies within 2^(k+1) reaches is what lies within
    2^k and what does so of the reaches 2^k above. No pair of reaches is ever listed, so n nodes cost n rows a step,
    and log2(depth) steps make one plan. With several ways down, reaches are listed by pairs, so that none counts twice.
    """
    steps = [levels] if levels else []
    own = values.where(F.col(node).isNotNull()).select(F.col(node).alias("_n"), *sums, *maxima, *[F.lit(0).alias(c) for c in steps])
    fold = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in (*maxima, *steps)]
    if not jumps.plain:
        up = upstream(own.select(F.col("_n").alias("_o"), F.col("_n").alias("_s")), "_o", "_s", jumps, "_n")
        far = up.join(own.drop(*steps), "_n").withColumns({c: F.col("depth") for c in steps})
        return far.groupBy(F.col("_o").alias(node)).agg(*fold)
    totals = own
    for table in jumps.tables:
        far = table.where("step > 0").select(F.col("src").alias("_n"), "dst", "step")
        here = F.struct("_n", *sums, *maxima, *steps)
        there = F.struct(F.col("dst").alias("_n"), *sums, *maxima, *[(F.col(c) + F.col("step")).alias(c) for c in steps])
        both = F.when(F.col("dst").isNull(), F.array(here)).otherwise(F.array(here, there))
        totals = totals.join(far, "_n", "left").select(F.explode(both).alias("e")).select("e.*").groupBy("_n").agg(*fold)
    return totals.withColumnRenamed("_n", node)


def network_faults(rivers: DataFrame, key: str = "comid", neighbours: tuple[str, ...] = NEIGHBOURS) -> DataFrame:
    """(comid, fault): reaches named as neighbours that do not exist, and reaches that drain into several."""
    named = rivers.select(F.col(key).alias("dst"), F.explode(F.array(*neighbours)).alias("src")).where((F.col("src") != NONE)).distinct()
    missing = named.select("src").distinct().join(rivers.select(F.col(key).alias("src")), "src", "left_anti").select(F.col("src").alias(key), F.lit("missing").alias("fault"))
    several = named.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("src").alias(key), F.lit("several ways down").alias("fault"))
    return missing.unionByName(several)
