"""ESRI shapefiles as a Spark data source, after the published format description.

    spark.dataSource.register(ShapefileSource)
    spark.read.format("shapefile").load("layer.shp")

Attributes come from the .dbf; `xs` and `ys` hold one coordinate array per ring or line (points: one of one). The
index file lets every task seek to its own records, so one large layer is read in parallel.
"""

from __future__ import annotations

import glob
import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

RECORDS_PER_TASK = 50_000
#: Fixed value: the text of a projection sidecar for WGS84 degrees.
WGS84_PRJ = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    width: int
    decimals: int


def dbf_header(path: str) -> tuple[int, int, int, list[Field]]:
    """(records, header size, record size, fields) of an attribute file."""
    with open(path, "rb") as f:
        head = f.read(32)
        count, header, record = struct.unpack("<IHH", head[4:12])
        fields = []
        while (d := f.read(32)) and d[0] != 0x0D and len(d) == 32:
            fields.append(Field(d[:11].split(b"\0")[0].decode("latin-1"), chr(d[11]), d[16], d[17]))
    return count, header, record, fields


def _value(field: Field, raw: bytes, encoding: str):
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text or set(text) == {"*"}:
        return None
    if field.kind in "NF":
        try:
            return float(text) if field.decimals or field.kind == "F" else int(text)
        except ValueError:
            return None
    if field.kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return text


def _type(field: Field):
    if field.kind in "NF":
        return DoubleType() if field.decimals or field.kind == "F" else LongType()
    return BooleanType() if field.kind == "L" else StringType()


def shape_of(content: bytes) -> tuple[int, list[list[float]], list[list[float]]]:
    """(type, xs, ys) of a record's content: one array per part. Null shapes have none; Z and M are left aside."""
    kind = struct.unpack("<i", content[:4])[0]
    base = kind % 10
    if kind == 0:
        return kind, [], []
    if base == 1:
        x, y = struct.unpack("<2d", content[4:20])
        return kind, [[x]], [[y]]
    if base == 8:
        n = struct.unpack("<i", content[36:40])[0]
        pts = np.frombuffer(content, "<f8", 2 * n, 40).reshape(-1, 2)
        return kind, [pts[:, 0].tolist()], [pts[:, 1].tolist()]
    if base not in (3, 5):
        raise ValueError(f"shape type {kind} is not supported")
    n_parts, n_points = struct.unpack("<2i", content[36:44])
    starts = [*np.frombuffer(content, "<i4", n_parts, 44).tolist(), n_points]
    pts = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    parts = [pts[a:b] for a, b in zip(starts, starts[1:])]
    return kind, [p[:, 0].tolist() for p in parts], [p[:, 1].tolist() for p in parts]


def index_of(path: str) -> np.ndarray:
    """(offset, length) in bytes of every record of a layer."""
    with open(os.path.splitext(path)[0] + ".shx", "rb") as f:
        return np.frombuffer(f.read()[100:], ">i4").reshape(-1, 2).astype(np.int64) * 2


def encoding_of(path: str) -> str:
    side = os.path.splitext(path)[0] + ".cpg"
    if os.path.exists(side):
        name = open(side).read().strip()
        return {"": "latin-1"}.get(name, name if not name.isdigit() else f"cp{name}")
    return "latin-1"


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, paths: list[str], per_task: int):
        self.paths, self.per_task = paths, per_task

    def partitions(self):
        out = []
        for p in self.paths:
            n = (os.path.getsize(os.path.splitext(p)[0] + ".shx") - 100) // 8
            out += [_Range(p, a, min(n, a + self.per_task)) for a in range(0, n, self.per_task)]
        return out or [_Range("", 0, 0)]

    def read(self, part):
        if part.last <= part.first:
            return
        base, index = os.path.splitext(part.path)[0], index_of(part.path)
        _, header, size, fields = dbf_header(base + ".dbf")
        encoding = encoding_of(part.path)
        with open(part.path, "rb") as shp, open(base + ".dbf", "rb") as dbf:
            dbf.seek(header + part.first * size)
            for offset, length in index[part.first : part.last].tolist():
                row = dbf.read(size)
                values, at = [], 1
                for f in fields:
                    values.append(_value(f, row[at : at + f.width], encoding))
                    at += f.width
                if row[:1] == b"*":
                    continue  # deleted
                shp.seek(offset + 8)
                yield (*values, *shape_of(shp.read(length)))


class ShapefileSource(DataSource):
    """Options: path (a file, a pattern or a folder), recordsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _paths(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(os.path.join(path, "*.shp") if os.path.isdir(path) else path))
        if not found:
            raise FileNotFoundError(f"no shapefile at {path}")
        return found

    def schema(self) -> StructType:
        fields = dbf_header(os.path.splitext(self._paths()[0])[0] + ".dbf")[3]
        arrays = ArrayType(ArrayType(DoubleType()))
        return StructType([*[StructField(f.name, _type(f)) for f in fields], StructField("shape_type", IntegerType()), StructField("xs", arrays), StructField("ys", arrays)])

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(self._paths(), int(self.options.get("recordsPerTask", RECORDS_PER_TASK)))


def _dbf_fields(kinds: list[tuple[str, str]], rows: list[list]) -> list[tuple[str, str, int, int]]:
    """(name, type, width, decimals) of columns given as (name, Spark type); names are cut to ten letters and kept apart."""
    out: list[tuple[str, str, int, int]] = []
    for i, (name, kind) in enumerate(kinds):
        short, k = name[:10], 1
        while short in {f[0] for f in out}:
            short, k = f"{name[: 10 - len(str(k))]}{k}", k + 1
        if kind in ("int", "bigint", "smallint", "tinyint"):
            out.append((short, "N", 18, 0))
        elif kind in ("double", "float"):
            out.append((short, "N", 24, 10))
        else:
            width = max([1, *(len(str(r[i]).encode("utf-8")) for r in rows if r[i] is not None)])
            out.append((short, "C", min(width, 254), 0))
    return out


def polygon_layer(rows: list[tuple[list, list[tuple[list, list]]]], kinds: list[tuple[str, str]]) -> dict[str, bytes]:
    """The files of a polygon layer, by ending: rows are (attribute values, rings as (xs, ys)). Shells are written
    clockwise and holes counter-clockwise, whichever way they come: the first ring of a part must be its shell, turning
    the other way than its holes."""
    shp, shx, at, boxes = [], [], 50, []
    for k, (_, rings) in enumerate(rows):
        pts = [np.column_stack([np.asarray(x, float), np.asarray(y, float)])[::-1] for x, y in rings]  # ours are counter-clockwise
        if pts:
            every = np.vstack(pts)
            box = (*every.min(axis=0), *every.max(axis=0))
            boxes.append(box)
            starts = np.cumsum([0, *[len(p) for p in pts[:-1]]])
            content = struct.pack("<i4d2i", 5, *box, len(pts), len(every)) + starts.astype("<i4").tobytes() + every.astype("<f8").tobytes()
        else:
            content = struct.pack("<i", 0)
        shp.append(struct.pack(">2i", k + 1, len(content) // 2) + content)
        shx.append(struct.pack(">2i", at, len(content) // 2))
        at += 4 + len(content) // 2
    b = np.array(boxes or [(0.0, 0.0, 0.0, 0.0)])
    box = (*b[:, :2].min(axis=0), *b[:, 2:].max(axis=0))
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + size // 2) + struct.pack("<2i8d", 1000, 5, *box, 0.0, 0.0, 0.0, 0.0)
    values = [v for v, _ in rows]
    fields = _dbf_fields(kinds, values)

    def cell(v, kind: str, width: int, decimals: int) -> bytes:
        if v is None or v != v:
            return b" " * width
        if kind == "C":
            raw = str(v).encode("utf-8")[:width]
            return raw.decode("utf-8", "ignore").encode("utf-8").ljust(width)
        text = f"{v:.{decimals}f}" if decimals else str(int(v))
        return text.rjust(width).encode()[:width]

    desc = b"".join(n.encode("latin-1", "replace")[:10].ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields)
    body = b"".join(b" " + b"".join(cell(v, t, w, d) for v, (_, t, w, d) in zip(row, fields)) for row in values)
    dbf = bytes([3, 124, 1, 1]) + struct.pack("<IHH", len(rows), 33 + len(desc), 1 + sum(f[2] for f in fields)) + b"\0" * 20 + desc + b"\r" + body + b"\x1a"
    shp_, shx_ = b"".join(shp), b"".join(shx)
    return {"shp": head(len(shp_)) + shp_, "shx": head(len(shx_)) + shx_, "dbf": dbf, "prj": WGS84_PRJ.encode(), "cpg": b"UTF-8"}


def write_missing_prj(folder: str) -> list[str]:
    """A projection sidecar for every layer of a folder that has none; returns those written."""
    made = []
    for shp in sorted(glob.glob(os.path.join(folder, "*.shp"))):
        side = os.path.splitext(shp)[0] + ".prj"
        if not os.path.exists(side):
            with open(side, "w") as f:
                f.write(WGS84_PRJ)
            made.append(side)
    return made
