"""Raster map algebra on cell tables (tile, r, c, ...): a cell is a row, neighbourhood is arithmetic.

Windows and masks are filters, tracing is the network closure over the cells' drains, polygons of cells come from
edge cancellation. Tiles of the same window are independent, so all outlets are traced in one program.

Flow is traced block by block first: cells are exchanged once, with places where water enters a block, and what lies
above a cell within its block is a run of numbers there. Only cells that water from other blocks reaches, and cells of
loops or repeated cells, go by the network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from thalweg.config import HALF_PIXEL, Settings
from thalweg.functions.forest import SIDES, Forest
from thalweg.functions.geometry import shoelace
from thalweg.functions.rings import area as ring_area
from thalweg.operators.dissolve import border_edges, largest_part, stitch_rings
from thalweg.operators.network import Jumps, jump_tables, upstream, upstream_totals
from thalweg.session import materialise, parallelism

# fixed values: direction code -> row and column step, clockwise from north
STEPS = {64: (-1, 0), 128: (-1, 1), 1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1)}
NO_STREAM = "no stream cell within the catchment"
#: Rows and columns of a block, and rows of a batch that goes out of a pass over blocks.
BLOCK, BATCH = 256, 100_000


def step_of(fdir: Column, which: int) -> Column:
    """Row (0) or column (1) step of a direction code; null for any other value."""
    out = F.when(F.lit(False), F.lit(0))
    for code, move in STEPS.items():
        out = out.when(fdir == code, F.lit(move[which]))
    return out


def cell_drains(cells: DataFrame, key: str = "k") -> DataFrame:
    """(src, dst) keys of cells: each cell and the one it flows into. Code 0 (outside) and steps off the table end."""
    to = cells.where(F.col("fdir") != 0).select(F.col(key).alias("src"), (F.col("r") + step_of(F.col("fdir"), 0)).alias("r"), (F.col("c") + step_of(F.col("fdir"), 1)).alias("c"))
    return to.join(cells.select("r", "c", F.col(key).alias("dst")), ["r", "c"]).select("src", "dst")


def _block_rows(cells: DataFrame, key: str | None, by: str | None, points: DataFrame | None) -> DataFrame:
    """(kind, by, br, bc, r, c, fdir, key) sorted by block: cells (0), places that water from another block enters (1),
    points (2: by, r, c, key). Without a key or a place there is no cell."""
    kind = dict((cells if points is None else points).dtypes)[key or "id"]
    at = lambda kind_, r, c, fdir, k: F.struct(F.lit(kind_).cast("tinyint").alias("kind"), (F.col(by) if by else F.lit(0)).alias("by"), r.cast("bigint").alias("r"), c.cast("bigint").alias("c"), fdir.cast("int").alias("fdir"), k.cast(kind).alias("key"))
    block = lambda v: F.floor(v / BLOCK)
    r, c, none = F.col("r"), F.col("c"), F.lit(None)
    to_r, to_c = r + step_of(F.col("fdir"), 0), c + step_of(F.col("fdir"), 1)
    out = (block(to_r) != block(r)) | (block(to_c) != block(c))
    both = F.array(at(0, r, c, F.col("fdir"), F.col(key) if key else none), F.when(out, at(1, to_r, to_c, none, none)))
    given = r.isNotNull() & c.isNotNull() & (F.col(key).isNotNull() if key else F.lit(True))
    rows = cells.where(given).select(F.explode(both).alias("e")).where("e is not null").select("e.*")
    if points is not None:
        rows = rows.unionByName(points.select(at(2, r, c, none, F.col("id")).alias("e")).select("e.*"))
    rows = rows.select("kind", "by", block(F.col("r")).alias("br"), block(F.col("c")).alias("bc"), "r", "c", "fdir", "key")
    return rows.repartition(parallelism(rows.sparkSession), "by", "br", "bc").sortWithinPartitions("by", "br", "bc")


def _forests(batches) -> Iterator[tuple[Forest, pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """Per block its forest, the keys of its cells, then cell numbers and keys of its points."""
    step = np.zeros((2, 256), np.int64)
    for code, move in STEPS.items():
        step[:, code] = move

    def forest(rows: pa.Table, br: int, bc: int):
        kind, r, c = (rows.column(i).to_numpy() for i in (0, 4, 5))
        fdir = rows.column(6).fill_null(0).to_numpy()
        fdir = np.where((fdir > 0) & (fdir < 256), fdir, 0)
        keys = rows.column(7).combine_chunks()
        cell, enters, point = (np.flatnonzero(kind == k) for k in range(3))
        f = Forest(r[cell], c[cell], *step[:, fdir[cell]], (r[enters], c[enters]), (br * BLOCK, bc * BLOCK), BLOCK)
        return f, keys.take(pa.array(cell)), f.at(r[point], c[point]), keys.take(pa.array(point))

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(1).dictionary_encode().indices.fill_null(-1), batch.column(2), batch.column(3)]
        new = np.any([np.diff(c.to_numpy(zero_copy_only=False)) != 0 for c in codes], axis=0)
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, z in zip(starts, starts[1:]):
            block = tuple(batch.column(i)[a].as_py() for i in (1, 2, 3))
            if held and block != last:
                yield forest(pa.Table.from_batches(held), *last[1:])
                held = []
            held.append(batch.slice(a, z - a))
            last = block
    if held:
        yield forest(pa.Table.from_batches(held), *last[1:])


def _records(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _open_batches(batches):
    for f, keys, _, _ in _forests(batches):
        yield _records([keys.filter(pa.array(~f.whole))], ["o"])


def _border_batches(batches):
    ends = np.array([e for _, _, e in SIDES])

    def rows(f: Forest, keys: pa.Array, held: list) -> pa.RecordBatch:
        outlet, cell, side = (np.concatenate(v) for v in zip(*held))
        corner = (f.c, f.r, f.c, f.r)
        return _records([keys.take(pa.array(outlet)), *[corner[i][cell] + ends[side, i] for i in range(4)]], ["o", "x1", "y1", "x2", "y2"])

    for f, keys, _, _ in _forests(batches):
        held, n = [], 0
        for some in f.borders():
            held.append(some)
            n += len(some[0])
            if n >= BATCH:
                yield rows(f, keys, held)
                held, n = [], 0
        if held:
            yield rows(f, keys, held)


def _shape_batches(batches):
    for f, keys, _, _ in _forests(batches):
        area, corners, plain = f.shapes()
        area, corners = area.astype(float), corners.copy()
        for o in np.flatnonzero(f.whole & ~plain).tolist():
            ring = f.shell(o)
            area[o], corners[o] = abs(ring_area(ring)), len(ring) - 1
        yield _records([x.filter(pa.array(f.whole)) if isinstance(x, pa.Array) else x[f.whole] for x in (keys, area, corners)], ["o", "area", "n_corners"])


def _own_batches(batches):
    for f, keys, _, _ in _forests(batches):
        kept, size = ~f.whole | f.leaves, f.size[: f.n]
        above = np.bincount(f.below[: f.n][kept], weights=size[kept], minlength=f.n + 1)[: f.n].astype(np.int64)
        yield _records([keys, np.where(kept, size - above, size), kept], ["k", "acc", "kept"])


def _shell_batches(batches):
    for f, _, at, ids in _forests(batches):
        rings = {o: f.shell(o) for o in np.unique(at[f.whole[at]]).tolist()}
        found = [rings.get(o) for o in at.tolist()]
        lists = [pa.array([None if x is None else x[:, i] for x in found], pa.list_(pa.float64())) for i in (0, 1)]
        yield _records([ids, pa.array(f.size[at], mask=~f.whole[at]), *lists], ["id", "n_cells", "xs", "ys"])


def _point_batches(batches):
    for f, _, at, ids in _forests(batches):
        for i in np.flatnonzero(f.whole[at]).tolist():
            cells = f.order[f.tin[at[i]] : f.tin[at[i]] + f.size[at[i]]]
            yield _records([ids.take(pa.array(np.full(len(cells), i))), f.r[cells], f.c[cells]], ["id", "r", "c"])


def _over_blocks(run: Callable, schema: str, cells: DataFrame, key: str | None = None, by: str | None = None, points: DataFrame | None = None) -> DataFrame:
    kind = dict((cells if points is None else points).dtypes)[key or "id"]
    return _block_rows(cells, key, by, points).mapInArrow(run, schema.format(kind=kind))


def _open_outlets(cells: DataFrame, key: str) -> DataFrame | None:
    """(o): cells with water from other blocks above them, or a loop, or repeated cells; None if there are none."""
    seen = Observation()
    found = materialise(_over_blocks(_open_batches, "o {kind}", cells, key).observe(seen, F.count(F.lit(1)).alias("n")), "open")
    return found if seen.get["n"] else None


def _traced(outlets: DataFrame, cells: DataFrame, key: str, jumps: Callable[[], Jumps] | None) -> DataFrame:
    """(o, r, c): the cells that drain to each outlet's, by the network."""
    net = jumps() if jumps else jump_tables(cell_drains(cells, key), "raster")
    return upstream(outlets.select("o", F.col("o").alias("k")), "o", "k", net, "k").join(cells.select(F.col(key).alias("k"), "r", "c"), "k").select("o", "r", "c")


def upstream_borders(cells: DataFrame, key: str = "k", jumps: Callable[[], Jumps] | None = None) -> DataFrame:
    """(o, x1, y1, x2, y2): the border of what drains to each cell. `jumps` gives the network's tables, if needed."""
    borders = _over_blocks(_border_batches, "o {kind}, x1 bigint, y1 bigint, x2 bigint, y2 bigint", cells, key)
    rest = _open_outlets(cells, key)
    if rest is None:
        return borders
    far = border_edges(cell_edges(_traced(rest, cells, key, jumps), ["o"]), ["o"])
    return borders.unionByName(far.select("o", *[F.col(c).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")]))


def upstream_shells(cells: DataFrame, key: str = "k", jumps: Callable[[], Jumps] | None = None) -> DataFrame:
    """(o, area, n_corners): planar area and corners of the largest part of what drains to each cell, holes aside."""
    shapes = _over_blocks(_shape_batches, "o {kind}, area double, n_corners bigint", cells, key)
    rest = _open_outlets(cells, key)
    if rest is None:
        return shapes
    shells = stitch_rings(border_edges(cell_edges(_traced(rest, cells, key, jumps), ["o"]), ["o"]), "o").where("ring = 0")
    shells = largest_part(shells.withColumn("area", F.abs(shoelace(F.col("xs"), F.col("ys")))), "o", F.col("area"))
    return shapes.unionByName(shells.select("o", "area", (F.size("xs") - 1).cast("bigint").alias("n_corners")))


def split_shells(cells: DataFrame, by: str, points: DataFrame) -> DataFrame:
    """(id, n_cells, xs, ys): the ring of the largest part of what drains to each point's cell, in columns and rows, and
    the number of all these cells. Water stays among cells that agree in `by`; points: (id, by, r, c) of cells.

    What is null could not be told from the cell's block alone.
    """
    return _over_blocks(_shell_batches, "id {kind}, n_cells bigint, xs array<double>, ys array<double>", cells, by=by, points=points)


def split_cells(cells: DataFrame, by: str, points: DataFrame) -> DataFrame:
    """(id, r, c): the cells themselves, of points for which their block tells."""
    return _over_blocks(_point_batches, "id {kind}, r bigint, c bigint", cells, by=by, points=points)


def accumulate(cells: DataFrame, key: str = "k", jumps: Jumps | None = None) -> DataFrame:
    """(key, acc): number of cells that flow through each cell, itself included.

    With jumps of all cells it goes by these. Else blocks are added up first, and cells whose number their block does
    not tell, or whose water leaves it, make a network of their own.
    """
    if jumps:
        return upstream_totals(cells.select(key, F.lit(1).cast("bigint").alias("acc")), jumps, key, sums=("acc",))
    placed = F.col("r").isNotNull() & F.col("c").isNotNull()
    seen = Observation()
    own = _over_blocks(_own_batches, "k {kind}, acc bigint, kept boolean", cells, key)
    own = materialise(own.observe(seen, F.count_if("kept").alias("n")), "blocks")
    acc = own.where("not kept").select(F.col("k").alias(key), "acc")
    acc = acc.unionByName(cells.where(~placed & F.col(key).isNotNull()).select(key, F.lit(1).cast("bigint").alias("acc")))
    if not seen.get["n"]:
        return acc
    net = own.where("kept").select("k", "acc").join(cells.where(placed).select(F.col(key).alias("k"), "r", "c", "fdir"), "k")
    return acc.unionByName(upstream_totals(net.select("k", "acc"), jump_tables(cell_drains(net), "blocks"), "k", sums=("acc",)).withColumnRenamed("k", key))


def masked(cells: DataFrame, inside: Column) -> DataFrame:
    """Cells of the mask; what lies outside is simply not there, and the window shrinks with it."""
    return cells.where(inside)


def streams(cells: DataFrame, n_catchments: Column, settings: Settings) -> DataFrame:
    """Cells with more accumulation than the threshold for one, or for several, catchments."""
    limit = F.when(n_catchments == 1, F.lit(settings.threshold_single)).otherwise(F.lit(settings.threshold_multiple))
    return cells.where(F.col("acc") > limit)


def snap_points(points: DataFrame, stream_cells: DataFrame, by: list[str]) -> DataFrame:
    """(id, r, c): per point the nearest stream cell of its tile; of equally near ones the first by row, then column.

    Points whose tile has no stream cell have no row. `points` has id, pr, pc and the columns `by`.
    """
    d = F.pow(F.col("r") - F.col("pr"), 2) + F.pow(F.col("c") - F.col("pc"), 2)
    best = points.join(stream_cells, by).groupBy("id").agg(F.min(F.struct(d.alias("d"), "r", "c")).alias("m"))
    return best.select("id", F.col("m.r").alias("r"), F.col("m.c").alias("c"))


def nudged(lng: Column, lat: Column) -> tuple[Column, Column]:
    """The snapped corner moved by half a pixel to the cell's centre, after tracing."""
    return lng + HALF_PIXEL, lat - HALF_PIXEL


def cell_edges(cells: DataFrame, by: list[str]) -> DataFrame:
    """The four edges of each cell, rows growing downwards, as (by, x1, y1, x2, y2) in cell units."""
    sides = [(0, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 1), (0, 0, 0, 1)]
    x, y = F.col("c").cast("double"), F.col("r").cast("double")
    edges = F.explode(F.array(*[F.struct((x + a).alias("x1"), (y + b).alias("y1"), (x + c).alias("x2"), (y + d).alias("y2")) for a, b, c, d in sides]))
    return cells.select(*by, edges.alias("e")).select(*by, "e.*")
