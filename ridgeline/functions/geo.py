"""Angles, projected coordinates and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.params import Grid


def norm_deg(a: Column) -> Column:
    """Angle in [0, 360)."""
    return a - 360 * F.floor(a / 360)


def angle_diff_deg(a: Column, b: Column) -> Column:
    """Signed short difference in (-180, 180]."""
    d = norm_deg(a - b)
    return F.when(d > 180, d - 360).otherwise(d)


def angle_in_arc(angle: Column, lo: Column, hi: Column, tolerance: float = 0.0, strict_reference: bool = True) -> Column:
    """Is the angle in the arc, by distance from the arc's middle ``(lo + hi) / 2``?

    An arc across north then has its middle on the far side; ``strict_reference=False`` mends that.
    """
    if strict_reference:
        return F.abs(angle_diff_deg(angle, (lo + hi) / 2)) <= F.abs(hi - lo) / 2 + tolerance
    width = norm_deg(hi - lo)
    return F.abs(angle_diff_deg(angle, lo + width / 2)) <= width / 2 + tolerance


def aspect_in_arc(aspect: Column, lo: float, hi: float) -> Column:
    """Inclusive; an arc with ``lo > hi`` goes across north."""
    return aspect.between(lo, hi) if lo <= hi else (aspect >= lo) | (aspect <= hi)


def aspect_window(aspect: Column, half: float) -> tuple[Column, Column]:
    return norm_deg(aspect - half), norm_deg(aspect + half)


def window_half_width(lo: Column, hi: Column) -> Column:
    return norm_deg(hi - lo) / 2


def lv95_to_wgs84(e: Column, n: Column) -> tuple[Column, Column]:
    """(lon, lat) by the national survey's published approximation. Its coefficients."""
    y, x = (e - 2_600_000) / 1e6, (n - 1_200_000) / 1e6
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return lon * 100 / 36, lat * 100 / 36


def wgs84_to_lv95(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(e, n), the inverse approximation. Its coefficients."""
    p, q = (lat * 3600 - 169_028.66) / 1e4, (lon * 3600 - 26_782.5) / 1e4
    e = 2_600_072.37 + 211_455.93 * q - 10_938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q
    n = 1_200_147.07 + 308_807.95 * p + 3_745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p
    return e, n


def cell_of(e: Column, n: Column, grid: Grid) -> tuple[Column, Column]:
    """(row, col) of a point, NULL outside; the origin is the centre of cell (0, 0), rows run south."""
    row = F.floor((grid.origin_n - n) / grid.cell_m + 0.5)
    col = F.floor((e - grid.origin_e) / grid.cell_m + 0.5)
    inside = row.between(0, grid.rows - 1) & col.between(0, grid.cols - 1)
    return F.when(inside, row.cast("int")), F.when(inside, col.cast("int"))


def centre_of(row: Column, col: Column, grid: Grid) -> tuple[Column, Column]:
    return grid.origin_e + col * grid.cell_m, grid.origin_n - row * grid.cell_m


def outer_box(grid: Grid) -> tuple[float, float, float, float]:
    """(e_min, n_min, e_max, n_max), half a cell beyond the centres."""
    half = grid.cell_m / 2
    return grid.origin_e - half, grid.origin_n - (grid.rows - 1) * grid.cell_m - half, grid.origin_e + (grid.cols - 1) * grid.cell_m + half, grid.origin_n + half


def distance_m(r0: Column, c0: Column, r1: Column, c1: Column, cell_m: float) -> Column:
    return F.sqrt((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0)) * cell_m


def snap(x: Column, cell: float) -> Column:
    return F.round(x / cell) * cell
