"""Top N items within every group, by secondary sort.

Rows are hash-partitioned by group, sorted within partitions by group, score and identifier, and streamed as Arrow
batches that emit the first N distinct identifiers of each group; no group is ever held. Before the exchange the
same pass runs over the input partitions, so that a group with a third of all rows sends at most N rows per
input partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each value, alike for equal ones (nan equals nan)."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _first_n(n: int, with_rank: bool):
    """A pass over sorted batches (g, s, i): keeps the first n rows of each g, repeats of (g, i) counting once.

    Batches are worked on as arrays; between them only the last group and its at most n identifiers are remembered.
    """

    def run(batches):
        group, seen, begun = None, [], False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            g, i = batch.column(0), batch.column(2)
            own, items = _codes(g), _codes(i)
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            starts = np.flatnonzero(new)
            nth = np.cumsum(new) - 1
            first = np.zeros(len(own), bool)
            first[np.unique(nth * (items.max() + 1) + items, return_index=True)[1]] = True
            carried = begun and _same(g[0].as_py(), group)
            before = np.zeros(len(starts), np.int64)
            if carried:  # the group goes on from the batch before
                in_group = nth == 0
                first &= ~(in_group & pc.is_in(i, pa.array(seen, i.type)).to_numpy(zero_copy_only=False))
                before[0] = len(seen)
            count = np.cumsum(first)
            rank = count - (count[starts] - first[starts])[nth] + before[nth]
            keep = np.flatnonzero(first & (rank <= n))
            last = keep[nth[keep] == nth[-1]]
            kept = i.take(pa.array(last)).to_pylist()
            seen = seen + kept if carried and len(starts) == 1 else kept
            group, begun = g[-1].as_py(), True
            out = batch.take(pa.array(keep))
            if with_rank:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(rank[keep].astype(np.int32))], [*out.schema.names, "r"])
            if out.num_rows:
                yield out

    return run


def top_n(df: DataFrame, group: str, item: str, score: Column, n: int) -> DataFrame:
    """(group, item, rnk int): per group its first n distinct items by score ascending, then item ascending.

    Rows whose group, item or score is null (or whose score is no number) are left out. An item that comes more than
    once counts with its best score. Groups with fewer than n items give what they have; an empty table gives an
    empty result; other columns are ignored, whatever their names. n must be at least 1.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).alias("g"), score.cast("double").alias("s"), F.col(item).alias("i"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    kinds = dict(rows.dtypes)
    schema = f"g {kinds['g']}, s double, i {kinds['i']}"
    local = rows.sortWithinPartitions("g", "s", "i").mapInArrow(_first_n(n, False), schema)
    placed = local.repartition("g").sortWithinPartitions("g", "s", "i")
    ranked = placed.mapInArrow(_first_n(n, True), schema + ", r int")
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("r").alias("rnk"))
