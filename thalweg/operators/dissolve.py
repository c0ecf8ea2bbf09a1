"""Union of polygons that share vertices: cancel shared edges, stitch what is left into rings.

An edge that two neighbouring polygons share is inside their union; one that an odd number of polygons has is on its
border. Counting edges is an aggregate with map-side combining; only borders go on to be stitched, one union at a
time. Polygons must be disjoint and noded alike, which holds for shapes made of pixels; `snapped` moves vertices onto
a lattice first and closes slivers narrower than it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thalweg.config import SLIVER_DEGREES
from thalweg.functions.rings import polygons, stitch
from thalweg.session import parallelism


def snapped(edges: DataFrame, step: float = 2 * SLIVER_DEGREES) -> DataFrame:
    """Edges with their ends on a lattice; what shrinks to a point goes."""
    on = lambda c: F.round(F.col(c) / step) * step
    moved = edges.withColumns({c: on(c) for c in ("x1", "y1", "x2", "y2")})
    return moved.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def closed(edges: DataFrame, step: float = 2 * SLIVER_DEGREES) -> DataFrame:
    """Edges whose ends, where several lie at one place of the lattice, all go to the least of them; others stay exact.

    Slivers narrower than the lattice close as with `snapped`, but clean borders do not move.
    """
    key = lambda x, y: F.struct(F.round(F.col(x) / step).alias("kx"), F.round(F.col(y) / step).alias("ky"))
    at = lambda n: F.struct(F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y"))
    ends = edges.select(F.explode(F.array(*[F.struct(key(f"x{n}", f"y{n}").alias("k"), at(n).alias("p")) for n in (1, 2)])).alias("e"))
    several = ends.groupBy("e.k").agg(F.min("e.p").alias("p"), F.max("e.p").alias("q")).where("p <> q")
    for n in (1, 2):
        to = several.select(F.col("k").alias("_k"), F.col("p").alias("_p"))
        edges = edges.withColumn("_k", key(f"x{n}", f"y{n}")).join(to, "_k", "left")
        edges = edges.withColumns({f"x{n}": F.coalesce("_p.x", f"x{n}"), f"y{n}": F.coalesce("_p.y", f"y{n}")}).drop("_k", "_p")
    return edges.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def border_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges that an odd number of polygons of a union has, in canonical direction (lower end first)."""
    swap = (F.col("x2") < F.col("x1")) | ((F.col("x2") == F.col("x1")) & (F.col("y2") < F.col("y1")))
    a = {c: F.when(swap, F.col(o)).otherwise(F.col(c)) for c, o in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    canonical = edges.select(*by, *[v.alias(f"_{c}") for c, v in a.items()])
    n = canonical.groupBy(*by, "_x1", "_y1", "_x2", "_y2").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return n.select(*by, *[F.col(f"_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def _stitch_batches(names: list[str], key_type: pa.DataType):
    """A pass over edges sorted by union: only the union at hand is held, across batches."""

    def rows_of(held: list[tuple[pa.Array, list[np.ndarray]]]) -> pa.RecordBatch:
        keys, parts, rings, coords = [], [], [], []
        for key, segments in held:
            found = polygons(stitch(np.concatenate(segments)))
            keys += [key] * len(found)
            parts += [p for p, _, _ in found]
            rings += [r for _, r, _ in found]
            coords += [c for _, _, c in found]
        offsets = np.cumsum([0, *map(len, coords)]).astype(np.int32)
        flat = np.concatenate(coords) if coords else np.zeros((0, 2))
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(flat[:, i]))) for i in (0, 1)]
        key = pa.concat_arrays(keys) if keys else pa.array([], key_type)
        return pa.RecordBatch.from_arrays([key.cast(key_type), pa.array(parts, pa.int32()), pa.array(rings, pa.int32()), *lists], names)

    def run(batches):
        last: tuple[pa.Array, list[np.ndarray]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            segments = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)], axis=1)
            starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()]
            done = []
            for a, z in zip(starts, [*starts[1:], len(codes)]):
                key = keys.slice(a, 1)
                if a == 0 and last is not None and last[0].equals(key):
                    last[1].append(segments[a:z])
                    continue
                if last is not None:
                    done.append(last)
                last = (key, [segments[a:z]])
            yield rows_of(done)
        if last is not None:
            yield rows_of([last])

    return run


def stitch_rings(border: DataFrame, by: str) -> DataFrame:
    """(by, part, ring, xs, ys): the rings of each union's border. What one task holds is one union's border, never its
    polygons; unions are spread over as many tasks as a large exchange has."""
    kind, names = dict(border.dtypes)[by], [by, "part", "ring", "xs", "ys"]
    edges = border.select(by, "x1", "y1", "x2", "y2").repartition(parallelism(border.sparkSession), by).sortWithinPartitions(by)
    run = _stitch_batches(names, to_arrow_type(border.schema[by].dataType))
    return edges.mapInArrow(run, f"{by} {kind}, part int, ring int, xs array<double>, ys array<double>")


def fill_holes(rings: DataFrame, area: Column, least: float, ring: str = "ring") -> DataFrame:
    """Rings without the holes (ring > 0) of at most `least` area; 0 drops all holes."""
    keep = F.lit(False) if least == 0 else F.abs(area) > least
    return rings.where((F.col(ring) == 0) | keep)


def largest_part(parts: DataFrame, by: str, area: Column, part: str = "part") -> DataFrame:
    """The part with the largest area of each polygon; of equal ones the first."""
    w = Window.partitionBy(by).orderBy(F.abs(area).desc(), F.col(part))
    return parts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def douglas_peucker(x, y, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """A closed ring with fewer corners, none farther than the tolerance off the old course; never below a triangle."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n <= 4 or tolerance <= 0:
        return x, y
    keep = np.zeros(n, bool)
    far = int(np.argmax((x - x[0]) ** 2 + (y - y[0]) ** 2))
    keep[[0, far, n - 1]] = True
    stack = [(0, far), (far, n - 1)]
    best = (0.0, -1)
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b], y[a + 1 : b]
        dx, dy = x[b] - x[a], y[b] - y[a]
        span = dx * dx + dy * dy
        t = np.clip(((px - x[a]) * dx + (py - y[a]) * dy) / span, 0, 1) if span else np.zeros(len(px))
        d = np.hypot(px - x[a] - t * dx, py - y[a] - t * dy)
        k = int(np.argmax(d))
        best = max(best, (float(d[k]), a + 1 + k))
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    if keep.sum() < 4 and best[1] >= 0:
        keep[best[1]] = True
    return x[keep], y[keep]


def simplify(rings: DataFrame, tolerance: float, xs: str = "xs", ys: str = "ys") -> DataFrame:
    """Rings simplified one by one, next to where they are."""
    schema = "struct<xs:array<double>,ys:array<double>>"

    @F.pandas_udf(schema)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        done = [douglas_peucker(x, y, tolerance) if x is not None and y is not None else ([], []) for x, y in zip(a, b)]
        return pd.DataFrame({"xs": [d[0] for d in done], "ys": [d[1] for d in done]})

    return rings.withColumn("_s", run(xs, ys)).withColumns({xs: F.col("_s.xs"), ys: F.col("_s.ys")}).drop("_s")
