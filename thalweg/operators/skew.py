"""A few keys holding most records: fragment-replicate by estimated load.

One pass with a frequent-items sketch estimates the loads of the largest keys of every field at once. Keys above a
task's fair share are cut into shards in proportion to their load, the other large ones are placed whole, all the rest
fall into hash buckets, and shards, keys and buckets are bin-packed onto tasks, heaviest first. Rows go to the task of
their shard or bucket; the matching side goes to those same tasks only. What the driver holds is bounded by the number
of tasks, never by the number of keys.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.session import SUBSET_KEYS, parallelism

#: Light-key hash buckets per task: enough for an even packing, few enough to list on the driver. A key that may hold
#: more rows than a bucket's fair share is placed on its own.
BUCKETS_PER_TASK = 16
#: A key above this part of a task's fair share is cut into shards of at most that size.
HEAVY_PART = 0.5
#: Keys the sketch follows for each one that is placed: it errs by a small part of a bucket's share.
TRACKED_PER_PLACED = 4
_MOST_TRACKED = 1_000_000  # the sketch's own limit


@dataclass(frozen=True)
class Placement:
    """Where rows go. heavy: (field, key) -> its estimated rows and the tasks of its shards; buckets: task of each."""

    tasks: int
    total: int
    heavy: dict[tuple[str, str], tuple[int, list[int]]]
    buckets: list[int]
    loads: list[float]


def pack(loads: list[float], tasks: int) -> tuple[list[int], list[float]]:
    """Heaviest first onto the least loaded task; returns the task of each load and the loads of the tasks."""
    heap = [(0.0, t) for t in range(tasks)]
    where, sums = [0] * len(loads), [0.0] * tasks
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, t = heapq.heappop(heap)
        where[i], sums[t] = t, load + loads[i]
        heapq.heappush(heap, (sums[t], t))
    return where, sums


def estimate_loads(df: DataFrame, fields: list[str], most: int) -> tuple[int, dict[tuple[str, str], int]]:
    """(rows, estimated rows of the largest keys), in one pass. Null keys are counted among the rows only.

    At most `most` keys a field come to the driver; the sketch takes the same memory whatever the number of keys.
    """
    tracked = min(TRACKED_PER_PLACED * most, _MOST_TRACKED)
    text = df.select(*[F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(fields)])
    tops = [F.expr(f"approx_top_k(_{i}, {min(most, tracked)}, {tracked})").alias(f"t{i}") for i in range(len(fields))]
    row = text.agg(F.count(F.lit(1)).alias("n"), *tops).first()
    found = {(f, x[0]): int(x[1]) for i, f in enumerate(fields) for x in row[f"t{i}"] or [] if x[0] is not None}
    return row["n"], found


def plan_placement(df: DataFrame, fields: str | list[str], tasks: int | None = None) -> Placement:
    """Estimate loads and bin-pack them. Several fields share the tasks: each row then has a place in every field."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    tasks = tasks or parallelism(df.sparkSession)
    n_buckets = tasks * BUCKETS_PER_TASK
    total, found = estimate_loads(df, fields, n_buckets)
    rows = total * len(fields)
    placed = {k: n for k, n in found.items() if n > rows / n_buckets}  # fewer than buckets
    share = max(1.0, rows / tasks * HEAVY_PART)
    units: list[tuple[tuple[str, str] | None, float]] = []
    for k, n in sorted(placed.items(), key=lambda x: (-x[1], x[0])):
        shards = max(1, -(-n // int(share)))
        units += [(k, n / shards)] * shards
    rest = max(0, rows - sum(placed.values())) / n_buckets
    units += [(None, rest)] * n_buckets
    where, sums = pack([n for _, n in units], tasks)
    heavy: dict[tuple[str, str], tuple[int, list[int]]] = {k: (n, []) for k, n in placed.items()}
    for (k, _), t in zip(units, where):
        if k is not None:
            heavy[k][1].append(t)
    return Placement(tasks, total, heavy, where[len(where) - n_buckets :], sums)


def _placed(keyed: DataFrame, p: Placement, spread: Column | None) -> DataFrame:
    """Adds _task and _shard to rows with _field and _k: those of one shard, chosen by `spread`, or (None) a row each
    for all shards of its key."""
    spark = keyed.sparkSession
    # both bounded by the number of tasks
    heavy = spark.createDataFrame([(f, k, ts) for (f, k), (_, ts) in p.heavy.items()], "_hf string, _hk string, _tasks array<int>")
    buckets = spark.createDataFrame(list(enumerate(p.buckets)), "_b int, _bt int")
    out = keyed.withColumn("_b", F.pmod(F.xxhash64("_field", "_k"), F.lit(len(p.buckets))).cast("int"))
    out = out.join(F.broadcast(heavy), (F.col("_k") == F.col("_hk")) & (F.col("_field") == F.col("_hf")), "left").join(F.broadcast(buckets), "_b", "left")
    n = F.greatest(F.coalesce(F.size("_tasks"), F.lit(1)), F.lit(1))
    shard = F.explode(F.sequence(F.lit(0), n - 1)) if spread is None else F.pmod(spread, n).cast("int")
    out = out.withColumn("_shard", shard)
    task = F.when(F.col("_hk").isNotNull(), F.get("_tasks", F.col("_shard"))).otherwise(F.col("_bt"))
    return out.withColumn("_task", task).drop("_b", "_bt", "_hf", "_hk", "_tasks")


def _routed(df: DataFrame, key: str, p: Placement, replicate: bool) -> DataFrame:
    """(_row, _k, _task, _shard): each row, packed, with the place of one shard, or (replicate) of all of its key.

    Rows of a split key are spread by a hash of all their columns, so that a retried task routes them alike.
    """
    packed = df.where(F.col(key).isNotNull()).select(F.lit(key).alias("_field"), F.col(key).cast("string").alias("_k"), F.struct(*df.columns).alias("_row"))
    return _placed(packed, p, None if replicate else F.xxhash64("_row")).select("_row", "_k", "_task", "_shard")


def route(df: DataFrame, key: str, p: Placement, replicate: bool = False) -> DataFrame:
    """(_row, _k, _task, _shard): rows, packed, sent to the tasks of the placement; null keys are left out."""
    return _routed(df, key, p, replicate).repartitionById(p.tasks, F.col("_task"))


def balanced_totals(
    df: DataFrame, fields: str | list[str], sums: dict[str, str], p: Placement | None = None, spread: list[str] | None = None
) -> DataFrame:
    """Per field and key: field, keyval (text), n_rows, n_shards, and a sum per entry of `sums` (result name -> column).

    All fields are totalled in one pass. Batches are combined before the exchange, rows of one key meet at the shards
    of its placement, and the shards' partial results (at most one per shard and key) are added at the end. Rows of a
    split key are spread by a hash of the columns `spread` (of all columns if not given), so that a retried task
    routes them alike; rows alike in all of these share a shard. Null keys are left out; null values add nothing, and
    a sum over nulls only is null; an empty table gives an empty result; columns not named are ignored.
    """
    fields = [fields] if isinstance(fields, str) else list(fields)
    p = p or plan_placement(df, fields)
    names = list(sums)
    keys = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("k")) for f in fields])
    values = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(sums.values())]
    keyed = df.select(F.xxhash64(*(spread or df.columns)).alias("_h"), F.explode(keys).alias("_e"), *values)
    keyed = keyed.select("_h", F.col("_e.f").alias("_field"), F.col("_e.k").alias("_k"), *[f"_v{i}" for i in range(len(names))]).where("_k is not null")
    routed = _placed(keyed, p, F.col("_h")).drop("_h")
    by = ["_task", "_shard", "_field", "_k"]
    value_names = [f"_v{i}" for i in range(len(names))]
    kinds = [T.IntegerType(), T.IntegerType(), T.StringType(), T.StringType(), T.LongType(), *[T.DoubleType()] * len(names)]
    schema = T.StructType([T.StructField(n, t) for n, t in zip([*by, "_n", *value_names], kinds)])

    def combine(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            g = pa.Table.from_batches([batch]).group_by(by, use_threads=False).aggregate([([], "count_all")] + [(v, "sum") for v in value_names])
            yield from g.select([*by, "count_all", *[f"{v}_sum" for v in value_names]]).rename_columns(schema.names).to_batches()

    partial = routed.select(*by, *value_names).mapInArrow(combine, schema).repartitionById(p.tasks, F.col("_task"))
    shards = partial.groupBy(*by).agg(F.sum("_n").alias("_n"), *[F.sum(v).alias(v) for v in value_names])
    return shards.groupBy(F.col("_field").alias("field"), F.col("_k").alias("keyval")).agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).cast("int").alias("n_shards"),
        *[F.sum(v).alias(n) for v, n in zip(value_names, names)],
    )


def fragment_join(df: DataFrame, side: DataFrame, key: str, how: str = "left", p: Placement | None = None) -> DataFrame:
    """Join rows to a side table on `key` without a task taking all rows of a hot key.

    Columns of `side` that clash with df's get the suffix `_side`. Null keys match nothing: an inner join leaves
    them out, a left join keeps them with nulls. `side` is replicated to the shards of split keys only. Where the
    session has SUBSET_KEYS off, as ours has, rows lie as they were bin-packed; otherwise Spark would exchange them a
    second time, so the tasks are then left to its hash of task, shard and key, and hot keys are split all the same.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    p = p or plan_placement(df, key)
    packed = df.sparkSession.conf.get(SUBSET_KEYS, "true") == "false"
    place = route if packed else _routed
    names = {c: f"{c}_side" if c in df.columns else c for c in side.columns if c != key}
    right = place(side, key, p, True).select(F.col("_task").alias("_rt"), F.col("_shard").alias("_rs"), F.col("_k").alias("_rk"), F.col("_row").alias("_side"))
    on = (F.col("_task") == F.col("_rt")) & (F.col("_shard") == F.col("_rs")) & (F.col("_k") == F.col("_rk"))
    joined = place(df, key, p, False).join(right, on, how)
    out = joined.select("_row.*", *[F.col("_side")[c].alias(n) for c, n in names.items()])
    if how == "left":
        nulls = df.where(F.col(key).isNull())
        out = out.unionByName(nulls, allowMissingColumns=True)
    return out


def dominant_values(df: DataFrame, fields: str | list[str], one_in: int = 20, p: Placement | None = None, spread: list[str] | None = None) -> DataFrame:
    """(field, keyval, n_rows, n_shards): non-null values that hold at least one in `one_in` of all rows, rows with a
    null key included; exact counts, made at the shards of the placement."""
    p = p or plan_placement(df, fields)
    return balanced_totals(df, fields, {}, p, spread).where(F.col("n_rows") * one_in >= F.lit(p.total))
