"""Columns over pixel coordinates. Arrays are [row, column]; centres are (x, y) = (column, row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(r: Column, c: Column, x, y) -> Column:
    """Euclidean distance of pixel (r, c) from the point (x, y)."""
    dx, dy = c - F.lit(x) if not isinstance(x, Column) else c - x, r - F.lit(y) if not isinstance(y, Column) else r - y
    return F.sqrt(dx * dx + dy * dy)


def mask_centre(height: int, width: int) -> tuple[int, int]:
    """(x, y) of the centre that all masks are built around."""
    return width // 2, height // 2


def half_even(x: Column) -> Column:
    """Nearest integer, ties to the even one."""
    return F.rint(x).cast("int")


def in_ring(d: Column, inner: float, outer: float) -> Column:
    """Closed on both sides."""
    return d.between(inner, outer)


def radial_bin(d: Column, radius: float, bins: int) -> Column:
    """Number of the half-open bin [i * radius / bins, (i + 1) * radius / bins) of a distance; null from radius on.

    The estimate by division is corrected against the edges themselves.
    """
    step = radius / bins
    i = F.floor(d / step)
    i = F.when(d < i * step, i - 1).when(d >= (i + 1) * step, i + 1).otherwise(i)
    return F.when((d < radius) & (i < bins), i.cast("int"))


def circular_gaussian(r2: Column, amplitude, sigma, offset) -> Column:
    """amplitude * exp(-r2 / (2 sigma^2)) + offset."""
    return amplitude * F.exp(-r2 / (2 * sigma * sigma)) + offset


def reflect(i: Column, n: Column) -> Column:
    """Index reflected at the borders of 0..n-1, the edge pixel repeated: -1 -> 0, n -> n - 1."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)
