"""Pictures for finding faults: rasters as PNG, vector layers as SVG. They show one watershed at a time, and refuse
windows and layers too large for a picture."""

from __future__ import annotations

import html
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from thalweg.operators.raster import STEPS

#: Pixels and corners of the largest picture.
MOST_PIXELS, MOST_CORNERS = 16_000_000, 2_000_000
#: Direction codes in rising order, as a colour bar shows them.
CODES = sorted(STEPS)
_HUES = np.array([[230, 60, 60], [230, 150, 50], [220, 220, 60], [90, 190, 80], [60, 190, 190], [70, 110, 220], [150, 90, 210], [220, 90, 170]], np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of rows x columns x 3 bytes."""
    h, w, _ = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 3)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def raster_picture(cells: DataFrame, value: str, scale: int = 4, codes: bool = False) -> bytes:
    """Cells (r, c, value) as a PNG, a square of `scale` pixels each; what is not there is white.

    codes: values are flow directions, one colour each, with a bar of the codes in order below; else darker is more, by
    the logarithm. Serves masks, directions, accumulation, streams and traced catchments alike.
    """
    rows = cells.select("r", "c", value).limit(MOST_PIXELS + 1).toPandas().dropna()
    if not len(rows):
        return png(np.full((1, 1, 3), 255, np.uint8))
    r, c, v = rows["r"].to_numpy(int), rows["c"].to_numpy(int), rows[value].to_numpy(float)
    h, w = np.ptp(r) + 1, np.ptp(c) + 1
    if len(rows) > MOST_PIXELS or h * w * scale * scale > MOST_PIXELS:
        raise ValueError(f"a picture of {h} x {w} cells is too large")
    picture = np.full((h, w, 3), 255, np.uint8)
    if codes:
        k = np.searchsorted(CODES, v)
        known = np.isin(v, CODES)
        picture[r[known] - r.min(), c[known] - c.min()] = _HUES[k[known]]
    else:
        depth = np.log1p(np.maximum(v, 0))
        shade = 225 - (200 * depth / max(depth.max(), 1e-9)).astype(int)
        picture[r - r.min(), c - c.min()] = np.stack([shade, shade, np.full(len(v), 235)], axis=1).astype(np.uint8)
    picture = picture.repeat(scale, axis=0).repeat(scale, axis=1)
    if codes:
        bar = np.full((scale * 2, picture.shape[1], 3), 255, np.uint8)
        for k, hue in enumerate(_HUES):
            bar[scale:, k * picture.shape[1] // 8 : (k + 1) * picture.shape[1] // 8] = hue
        picture = np.concatenate([picture, bar])
    return png(picture)


def vector_picture(layers: list[tuple[str, DataFrame]], points: list[tuple[str, float, float]] = (), width: int = 800) -> str:
    """Ring layers (colour, rows with xs, ys), the first one at the bottom, and points (colour, x, y) as an SVG."""
    drawn, every = [], [np.array([(x, y) for _, x, y in points]).reshape(-1, 2)]
    for colour, rows in layers:
        for row in rows.select("xs", "ys").toLocalIterator():
            pts = np.column_stack([row["xs"], row["ys"]]).astype(float)
            drawn.append((colour, pts))
            every.append(pts)
            if sum(map(len, every)) > MOST_CORNERS:
                raise ValueError("the layers have too many corners for a picture")
    all_ = np.concatenate(every)
    low, high = (all_.min(axis=0), all_.max(axis=0)) if len(all_) else (np.zeros(2), np.ones(2))
    size = np.maximum(high - low, 1e-9)
    scale = width / size.max()
    at = lambda p: ((p - low) * [scale, -scale] + [0, size[1] * scale]).round(2)
    body = [f'<path fill="none" stroke="{html.escape(c)}" d="M{"L".join(f"{x} {y}" for x, y in at(p).tolist())}"/>' for c, p in drawn]
    body += [f'<circle r="4" fill="{html.escape(c)}" cx="{q[0]}" cy="{q[1]}"/>' for c, q in ((c, at(np.array([x, y]))) for c, x, y in points)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-5 -5 {size[0] * scale + 10:.1f} {size[1] * scale + 10:.1f}">{"".join(body)}</svg>'
