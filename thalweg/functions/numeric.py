"""Scalar arithmetic of the result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thalweg.config import HALF_PIXEL, PIXELS_PER_DEGREE


def significant(x: Column, digits: int) -> Column:
    """x rounded (half up) to a number of significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - digits + 1)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / scale) * scale)


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| / |b|; null where b is zero or either is null."""
    return F.abs(F.try_divide(a - b, b))


def percent_difference(computed: Column, reported: Column, digits: int = 2) -> Column:
    """Signed difference in percent of the reported value, to significant digits; null where that is zero or null."""
    return significant(F.try_divide(computed - reported, reported) * 100, digits)


def grid_floor(x: Column) -> Column:
    """Lower window edge: the pixel boundary at or below x, half a pixel out."""
    return F.floor(x * PIXELS_PER_DEGREE) / F.lit(float(PIXELS_PER_DEGREE)) - HALF_PIXEL


def grid_ceil(x: Column) -> Column:
    """Upper window edge: the pixel boundary at or above x, half a pixel out."""
    return F.ceil(x * PIXELS_PER_DEGREE) / F.lit(float(PIXELS_PER_DEGREE)) + HALF_PIXEL


def display(x: Column, digits: int) -> Column:
    """Number with thousands separators; empty where null."""
    return F.coalesce(F.format_number(x, digits), F.lit(""))
