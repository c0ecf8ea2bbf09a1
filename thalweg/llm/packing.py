"""Filling fixed-capacity containers: first-fit decreasing within randomised groups.

Texts are measured in tokens next to where they are read; only (identifier, part, size) moves, and is written once.
Sizes are dealt out at random (by a seed) into groups of a bounded number of items, and every group is packed on its own: items in falling size, each
into the first container that still has room, found by a tournament tree over the remaining capacities in
logarithmic time. Texts longer than a container, and only they, are divided into full parts and a remainder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thalweg.llm.tokens import RANKS_PATH, encoder
from thalweg.session import materialise

CAPACITY = 2048
#: Items per group: the bound on what one task packs, and large enough that open containers are a small part.
GROUP_SIZE = 20_000
SEED = 42


class TournamentTree:
    """Remaining capacities as leaves, maxima above them: the first leaf with enough room in log2(n) steps."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, item: int) -> int:
        """Put an item into the first container with room for it."""
        room, at = self.room, 1
        if room[1] < item:
            raise ValueError("no container has room")
        while at < self.size:
            at *= 2
            if room[at] < item:
                at += 1
        leaf = at - self.size
        room[at] -= item
        at //= 2
        while at:
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return leaf


def first_fit_decreasing(sizes, capacity: int) -> np.ndarray:
    """The container number of each item; equal sizes keep their order. Every size must lie in 0..capacity."""
    sizes = np.asarray(sizes, np.int64)
    if len(sizes) and (sizes.min() < 0 or sizes.max() > capacity):
        raise ValueError("sizes must lie between 0 and the capacity")
    out = np.zeros(len(sizes), np.int64)
    tree = TournamentTree(max(1, len(sizes)), capacity)
    for k in np.argsort(-sizes, kind="stable"):
        out[k] = tree.place(int(sizes[k]))
    return out


def _measure(capacity: int, path: str, doc_type: pa.DataType):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            docs, parts, starts, sizes = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                n = len(enc.encode_ordinary(text)) if text else 0
                for part, at in enumerate(range(0, max(n, 1), capacity)):
                    docs.append(doc)
                    parts.append(part)
                    starts.append(at)
                    sizes.append(min(capacity, n - at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, doc_type), pa.array(parts, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32())],
                ["doc", "part", "first_token", "n_tokens"],
            )

    return run


def measure(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, ranks_path: str = RANKS_PATH) -> DataFrame:
    """(key, part, first_token, n_tokens): one row per text, or per part of a text longer than the capacity.

    Null and empty texts have one part of no tokens. Parts are token ranges, so joining them gives the text back.
    """
    kind = dict(df.dtypes)[key]
    probe = df.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    doc_type = to_arrow_type(probe.schema["doc"].dataType)
    rows = probe.mapInArrow(_measure(capacity, ranks_path, doc_type), f"doc {kind}, part int, first_token long, n_tokens int")
    return rows.withColumnRenamed("doc", key)


def _pack(capacity: int):
    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]  # one group: bounded by its size
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins = first_fit_decreasing(table.column("n_tokens").to_numpy(), capacity)
        group = np.full(table.num_rows, TaskContext.get().partitionId())
        table = table.append_column("grp", pa.array(group, pa.int32())).append_column("bin", pa.array(bins, pa.int32()))
        yield from table.combine_chunks().to_batches()

    return run


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, ranks_path: str = RANKS_PATH, seed: int = SEED) -> DataFrame:
    """(key, part, first_token, n_tokens, container): every text's parts and the container each goes into.

    No container holds more than `capacity` tokens and no text up to that size is divided. Null and empty texts
    take no room and still get a container. Repeated rows are separate items. An empty table gives an empty result;
    other columns are ignored, whatever their names. Container names are unique across groups.
    """
    if capacity < 1 or group_size < 1:
        raise ValueError("capacity and group_size must be positive")
    items = materialise(measure(df, key, text, capacity, ranks_path), "sizes")  # texts are read once, groups go by parts
    groups = max(1, -(-items.count() // group_size))
    kind = dict(items.dtypes)[key]
    # random whatever the keys, so repeated ones spread; a retried task reads the same rows of the same file again
    dealt = items.withColumnRenamed(key, "doc").repartitionById(groups, F.floor(F.rand(seed) * groups).cast("int"))
    packed = dealt.mapInArrow(_pack(capacity), f"doc {kind}, part int, first_token long, n_tokens int, grp int, bin int")
    return packed.select(
        F.col("doc").alias(key), "part", "first_token", "n_tokens", F.concat_ws("-", "grp", "bin").alias("container")
    )


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, containers, and the part of all room that is filled."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("n_items"),
        F.sum("t").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_containers"),
        F.max("t").alias("fullest"),
        F.round(F.sum("t") / (F.count(F.lit(1)) * F.lit(capacity)), 6).alias("filled"),
    )


def check_report(packed: DataFrame, docs: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: texts packed, containers over the capacity, texts divided though they would fit, texts whose parts leave
    something out, and texts that have no container. All but the first are 0 where the packing is sound."""
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).where(F.col("t") > capacity).agg(F.count(F.lit(1)).alias("n_overfull"))
    per = packed.groupBy(key).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_if(F.col("part") == 0).alias("copies"))
    texts = per.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_texts"),
        F.count_if((F.col("n") > F.col("copies")) & (F.col("t") <= F.col("copies") * capacity)).alias("n_split"),
        F.count_if(F.col("t") != F.col("end") * F.col("copies")).alias("n_torn"),
    )
    lost = docs.select(key).join(per.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    return texts.crossJoin(over).crossJoin(lost)  # a row each
