"""Pixels as column expressions, and a PNG encoder."""

from __future__ import annotations

import math
import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUN_AZIMUTH, SUN_ZENITH = 315.0, 45.0
#: Fixed values: (from, to) colours of the three elevation bands, and their bounds.
BANDS = [(0.0, 0.4, (90.0, 130.0, 80.0), (160.0, 150.0, 110.0)), (0.4, 0.8, (160.0, 150.0, 110.0), (200.0, 195.0, 185.0)), (0.8, 1.0, (200.0, 195.0, 185.0), (250.0, 250.0, 252.0))]


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def shade(slope: Column, aspect: Column) -> Column:
    z = math.radians(SUN_ZENITH)
    lit = math.cos(z) * F.cos(F.radians(slope)) + math.sin(z) * F.sin(F.radians(slope)) * F.cos(F.radians(SUN_AZIMUTH - aspect))
    return F.when(slope.isNotNull() & aspect.isNotNull(), clamp(lit, 0.0, 1.0)).otherwise(math.cos(z))


def tint(t: Column) -> list[Column]:
    """Red, green and blue for a height between 0 and 1."""
    t, out = clamp(t, 0.0, 1.0), []
    for k in range(3):
        band = lambda lo, hi, a, b: a[k] + (b[k] - a[k]) * ((t - lo) / (hi - lo))  # noqa: B023, E731
        out.append(F.when(t < 0.4, band(*BANDS[0])).when(t < 0.8, band(*BANDS[1])).otherwise(band(*BANDS[2])))
    return out


def hillshade_pixels(terrain: DataFrame) -> DataFrame:
    """``row, col, r, g, b, a`` from ``row, col, z, slope, aspect``; cells without a height are transparent."""
    span = terrain.agg(F.min("z").alias("_lo"), F.greatest(F.max("z") - F.min("z"), F.lit(1.0)).alias("_span"))
    t = (F.col("z") - F.col("_lo")) / F.col("_span")
    mix = 0.3 + 0.7 * shade(F.col("slope"), F.col("aspect"))
    colour = [F.when(F.col("z").isNull(), 0).otherwise(F.floor(F.round(clamp(x * mix, 0.0, 255.0), 9))).cast("int") for x in tint(t)]
    alpha = F.when(F.col("z").isNull(), 0).otherwise(255).cast("int")
    return terrain.join(F.broadcast(span)).select("row", "col", *(c.alias(n) for c, n in zip(colour, "rgb")), alpha.alias("a"))


def reach_pixels(flood: DataFrame, dem: DataFrame) -> DataFrame:
    """``row, col, r, g, b, a`` of reached cells from ``row, col, alt``; others are absent, that is transparent."""
    agl = flood.join(dem, ["row", "col"]).withColumn("agl", F.greatest(F.col("alt") - F.col("z"), F.lit(0.0)))
    top = agl.agg(F.greatest(F.max("agl"), F.lit(1.0)).alias("_top"))
    t = clamp(F.col("agl") / F.col("_top"), 0.0, 1.0)
    ramp = {"r": 215 + 30 * t, "g": 130 - 90 * t, "b": 60 - 30 * t, "a": 110 + 90 * t}
    return agl.join(F.broadcast(top)).select("row", "col", *(F.floor(x).cast("int").alias(n) for n, x in ramp.items()))


def png(rows: int, cols: int, pixels: DataFrame) -> bytes:
    """An image of the pixels; rows are streamed to the driver one partition at a time, the image is what it holds."""
    image = bytearray(rows * (4 * cols + 1))
    for p in pixels.toLocalIterator():
        at = p["row"] * (4 * cols + 1) + 1 + 4 * p["col"]
        image[at : at + 4] = bytes((p["r"], p["g"], p["b"], p["a"]))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(bytes(image))) + part(b"IEND", b"")
