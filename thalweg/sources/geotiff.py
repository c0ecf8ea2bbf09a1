"""GeoTIFF rasters as a Spark data source of cells, after the published TIFF 6 and GeoTIFF descriptions.

    spark.dataSource.register(GeoTiffSource)
    spark.read.format("geotiff").option("window", "xmin,ymin,xmax,ymax").load("fdir.tif")

Rows are (r, c, value) of cells that are not nodata. A task reads one block (strip or tile); blocks outside the
window are never opened. Uncompressed, deflate and LZW blocks of one band are read, with or without differencing.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


@dataclass(frozen=True)
class Raster:
    """What a file's directory says; blocks are (row, column, height, width, offset, bytes)."""

    order: str
    width: int
    height: int
    dtype: str
    compression: int
    predictor: int
    blocks: tuple[tuple[int, int, int, int, int, int], ...]
    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None

    def cells_of(self, window: tuple[float, float, float, float] | None) -> tuple[int, int, int, int]:
        """First and last row and column (last excluded) of a window of coordinates."""
        if window is None:
            return 0, self.height, 0, self.width
        xmin, ymin, xmax, ymax = window
        c0, c1 = int(np.floor((xmin - self.x0) / self.dx)), int(np.ceil((xmax - self.x0) / self.dx))
        r0, r1 = int(np.floor((self.y0 - ymax) / self.dy)), int(np.ceil((self.y0 - ymin) / self.dy))
        return max(r0, 0), min(r1, self.height), max(c0, 0), min(c1, self.width)


def directory(path: str) -> Raster:
    with open(path, "rb") as f:
        head = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{path} is no TIFF file")
        f.seek(struct.unpack(order + "I", head[4:])[0])
        tags: dict[int, list] = {}
        entries = [f.read(12) for _ in range(struct.unpack(order + "H", f.read(2))[0])]
        for e in entries:
            tag, kind, n = struct.unpack(order + "HHI", e[:8])
            size = _SIZES.get(kind, 1) * n
            if size <= 4:
                data = e[8 : 8 + size]
            else:
                f.seek(struct.unpack(order + "I", e[8:])[0])
                data = f.read(size)
            tags[tag] = [data.rstrip(b"\0").decode("latin-1")] if kind == 2 else list(struct.unpack(f"{order}{n}{_CODES[kind]}", data)) if kind in _CODES else [data]
    one = lambda t, default: tags.get(t, [default])[0]
    if one(277, 1) != 1:
        raise ValueError("only rasters of one band are read")
    width, height = one(256, 0), one(257, 0)
    letter = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
    dtype = f"{order}{letter}{one(258, 8) // 8}"
    blocks = []
    if 322 in tags:
        tw, th = one(322, 0), one(323, 0)
        across = -(-width // tw)
        for k, (o, n) in enumerate(zip(tags[324], tags[325])):
            blocks.append((k // across * th, k % across * tw, th, tw, o, n))
    else:
        rows = min(one(278, height), height)
        for k, (o, n) in enumerate(zip(tags[273], tags[279])):
            blocks.append((k * rows, 0, min(rows, height - k * rows), width, o, n))
    scale, tie = tags.get(33550, [1.0, 1.0, 0.0]), tags.get(33922, [0.0] * 6)
    nodata = one(42113, None)
    return Raster(
        order, width, height, dtype, one(259, 1), one(317, 1), tuple(blocks),
        tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], None if nodata is None else float(nodata),
    )


def lzw(data: bytes) -> bytes:
    """TIFF's variant of LZW: codes of 9 to 12 bits, most significant first, 256 clears and 257 ends."""
    out, table, bits, held, n = bytearray(), [], 9, 0, 0
    last = b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < bits:
            continue
        n -= bits
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, bits, last = base.copy(), 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        size = len(table) + 1  # the width grows one code early
        bits = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


def block_array(path: str, raster: Raster, block: tuple) -> np.ndarray:
    _, _, h, w, offset, size = block
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read(size)
    if raster.compression in (8, 32946):
        data = zlib.decompress(data)
    elif raster.compression == 5:
        data = lzw(data)
    elif raster.compression != 1:
        raise ValueError(f"compression {raster.compression} is not supported")
    a = np.frombuffer(data, raster.dtype, h * w).reshape(h, w)
    if raster.predictor == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
    elif raster.predictor != 1:
        raise ValueError("floating-point differencing is not supported")
    return a


class _Block(InputPartition):
    def __init__(self, k: int):
        self.k = k


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, window):
        self.path, self.window = path, window

    def partitions(self):
        raster = directory(self.path)
        r0, r1, c0, c1 = raster.cells_of(self.window)
        return [_Block(k) for k, (r, c, h, w, _, _) in enumerate(raster.blocks) if r < r1 and r + h > r0 and c < c1 and c + w > c0] or [_Block(-1)]

    def read(self, part):
        if part.k < 0:
            return
        raster = directory(self.path)
        r0, r1, c0, c1 = raster.cells_of(self.window)
        block = raster.blocks[part.k]
        r, c = block[:2]
        a = block_array(self.path, raster, block)
        a = a[max(r0 - r, 0) : r1 - r, max(c0 - c, 0) : c1 - c]
        keep = np.ones(a.shape, bool) if raster.nodata is None else a != raster.nodata
        if a.dtype.kind == "f":
            keep &= ~np.isnan(a)
        rows, cols = np.nonzero(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows + max(r0, r), pa.int64()), pa.array(cols + max(c0, c), pa.int64()), pa.array(a[keep].astype(float), pa.float64())], ["r", "c", "value"]
        )


class GeoTiffSource(DataSource):
    """Options: path, window (xmin,ymin,xmax,ymax in the raster's coordinates)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> StructType:
        return StructType([StructField("r", LongType()), StructField("c", LongType()), StructField("value", DoubleType())])

    def reader(self, schema: StructType) -> GeoTiffReader:
        window = self.options.get("window")
        return GeoTiffReader(self.options["path"].removeprefix("file://"), tuple(map(float, window.split(","))) if window else None)
