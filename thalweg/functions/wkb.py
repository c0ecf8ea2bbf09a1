"""Well-known binary, the form in which geometries rest; coordinate arrays are the form in which they are worked on."""

from __future__ import annotations

import struct

import numpy as np

POINT, LINE, POLYGON, MULTI_LINE, MULTI_POLYGON = 1, 2, 3, 5, 6


def _coordinates(xs, ys) -> bytes:
    return struct.pack("<I", len(xs)) + np.column_stack([xs, ys]).astype("<f8").tobytes()


def encode(kind: int, parts: list[list[tuple]]) -> bytes:
    """parts: per part its rings (or one line, or one point), each a pair of coordinate sequences."""
    head = lambda k: b"\x01" + struct.pack("<I", k)
    if kind == POINT:
        (x,), (y,) = parts[0][0]
        return head(POINT) + struct.pack("<2d", x, y)
    if kind == LINE:
        return head(LINE) + _coordinates(*parts[0][0])
    if kind == POLYGON:
        return head(POLYGON) + struct.pack("<I", len(parts[0])) + b"".join(_coordinates(*r) for r in parts[0])
    if kind in (MULTI_LINE, MULTI_POLYGON):
        single = LINE if kind == MULTI_LINE else POLYGON
        return head(kind) + struct.pack("<I", len(parts)) + b"".join(encode(single, [p]) for p in parts)
    raise ValueError(f"geometry type {kind} is not supported")


def decode(data: bytes) -> tuple[int, list[list[tuple]]]:
    """(kind, parts), the inverse of encode; either byte order."""
    kind, parts, _ = _read(data, 0)
    return kind, parts


def _read(data: bytes, at: int) -> tuple[int, list, int]:
    order = "<" if data[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def coordinates(n: int) -> tuple:
        nonlocal at
        pts = np.frombuffer(data, order + "f8", 2 * n, at).reshape(-1, 2)
        at += 16 * n
        return pts[:, 0].tolist(), pts[:, 1].tolist()

    if kind == POINT:
        return kind, [[coordinates(1)]], at
    if kind == LINE:
        return kind, [[coordinates(count())]], at
    if kind == POLYGON:
        return kind, [[coordinates(count()) for _ in range(count())]], at
    if kind in (MULTI_LINE, MULTI_POLYGON):
        parts = []
        for _ in range(count()):
            _, part, at = _read(data, at)
            parts += part
        return kind, parts, at
    raise ValueError(f"geometry type {kind} is not supported")
