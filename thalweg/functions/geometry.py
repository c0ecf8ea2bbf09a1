"""Geometry as expressions over coordinate arrays (rings and lines), and the geodesic kernel.

A ring is a pair of equally long arrays, closed. Nothing here leaves the JVM but `geodesic_m`, which iterates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the WGS84 ellipsoid
A = 6378137.0
INVERSE_FLATTENING = 298.257223563
_E2 = (2 - 1 / INVERSE_FLATTENING) / INVERSE_FLATTENING
_E = math.sqrt(_E2)


def is_nested(df: DataFrame, column: str) -> bool:
    """Whether a coordinate column has a list for each ring of a polygon, and not one list."""
    return isinstance(df.schema[column].dataType.elementType, T.ArrayType)


def flat_list(c: Column, nested: bool) -> Column:
    """All coordinates of a polygon in one list, whether they are nested or not."""
    return F.flatten(F.filter(c, lambda r: r.isNotNull())) if nested else c


def _steps(xs: Column) -> Column:
    """0 .. number of edges - 1; empty where there is no edge."""
    return F.when(F.size(xs) > 1, F.sequence(F.lit(0), F.size(xs) - 2)).otherwise(F.array().cast("array<int>"))


def shoelace(xs: Column, ys: Column) -> Column:
    """Signed planar area of a closed ring, counter-clockwise positive, in squared units."""
    term = lambda acc, i: acc + F.get(xs, i) * F.get(ys, i + 1) - F.get(xs, i + 1) * F.get(ys, i)
    return F.aggregate(_steps(xs), F.lit(0.0), term) / 2


def equal_area_y(lat: Column) -> Column:
    """Northing of the ellipsoidal cylindrical equal-area map, in metres."""
    s = F.sin(F.radians(lat))
    es = F.lit(_E) * s
    q = (1 - _E2) * (s / (1 - es * es) - F.ln((1 - es) / (1 + es)) / (2 * _E))
    return F.lit(A / 2) * q


def equal_area_km2(xs: Column, ys: Column) -> Column:
    """Area of a ring of degrees on the ellipsoid, in square kilometres, always positive."""
    east = F.transform(xs, lambda x: F.lit(A) * F.radians(x))
    return F.abs(shoelace(east, F.transform(ys, equal_area_y))) / 1e6


def bounds(xs: Column, ys: Column) -> Column:
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(px - x1 - t * dx, 2) + F.pow(py - y1 - t * dy, 2))


def box_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Half-width of the smallest square around the point that meets the segment (Chebyshev distance).

    Along the segment the larger of |dx| and |dy| is convex and piecewise linear, so its least value lies at an end
    or where one of them is zero or both are equal.
    """
    ax, ay, dx, dy = x1 - px, y1 - py, x2 - x1, y2 - y1
    clamp = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    at = lambda t: F.greatest(F.abs(ax + t * dx), F.abs(ay + t * dy))
    places = [F.try_divide(-ax, dx), F.try_divide(-ay, dy), F.try_divide(ay - ax, dx - dy), F.try_divide(-ay - ax, dx + dy)]
    return F.least(at(F.lit(0.0)), at(F.lit(1.0)), *[at(clamp(t)) for t in places])


def line_start(xs: Column, ys: Column) -> Column:
    """First coordinate of a line."""
    return F.struct(F.get(xs, F.lit(0)).alias("lng"), F.get(ys, F.lit(0)).alias("lat"))


def coordinates_json(xs: Column, ys: Column, digits: int = 5) -> Column:
    """A coordinate list as JSON text, rounded; never with an exponent."""

    def text(v: Column) -> Column:
        v = F.round(v, digits)
        small = F.rtrim(v.cast(f"decimal({digits + 5},{digits})").cast("string"), F.lit("0"))
        return F.when((F.abs(v) < 1e-3) & (v != 0), small).otherwise(v.cast("string"))

    pairs = F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: F.concat(F.lit("["), text(p["x"]), F.lit(","), text(p["y"]), F.lit("]")))
    return F.concat(F.lit("["), F.concat_ws(",", pairs), F.lit("]"))


def vincenty_m(lat1, lng1, lat2, lng2) -> np.ndarray:
    """Geodesic distance on WGS84 in metres; nan where a coordinate is, or where near-antipodal points do not converge."""
    f = 1 / INVERSE_FLATTENING
    b = A * (1 - f)
    lat1, lng1, lat2, lng2 = (np.radians(np.asarray(v, float)) for v in (lat1, lng1, lat2, lng2))
    u1, u2, diff = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lng2 - lng1
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = diff.copy()
    done = np.zeros(lam.shape, bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sig = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / np.where(ss == 0, 1, ss))
            ca2 = 1 - sa**2
            c2m = np.where(ca2 == 0, 0.0, cs - 2 * s1 * s2 / np.where(ca2 == 0, 1, ca2))
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = diff + (1 - c) * f * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if (done | np.isnan(lam)).all():
                break
        k = ca2 * (A**2 - b**2) / b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        ds = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        out = b * big_a * (sig - ds)
    return np.where(done, out, np.nan)


@F.pandas_udf(T.DoubleType())
def geodesic_m(lat1: pd.Series, lng1: pd.Series, lat2: pd.Series, lng2: pd.Series) -> pd.Series:
    return pd.Series(vincenty_m(lat1, lng1, lat2, lng2)).replace({np.nan: None}).astype(float)
