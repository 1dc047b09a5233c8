"""Bitmaps of numbers, made by Spark and sent to all tasks: they tell most rows that a join would leave out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of bits: bounds of a bitmap's size, 128 MB at most.  A fuller bitmap lets more rows through; none is lost.
LEAST_BITS, MOST_BITS = 1 << 17, 1 << 30


def bitmap_bits(numbers: int) -> int:
    """Bits for so many numbers: a power of two, so that one bit in 32 or fewer is set."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (32 * numbers).bit_length()))


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the numbers from 0 to ``bits`` in the only column."""
    (place,) = places.columns
    blocks = places.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8 + 8192, np.uint8)
    for r in blocks.toLocalIterator():
        at = int(r["block"]) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def noted(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds the numbers, at the places at which Spark's bitmap functions put them."""
    block = np.where(place > 0, 1 + (place - 1) // 32768, 0)
    bit = np.where(place > 0, (place - 1) % 32768, 0)
    return (bits[block * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 > 0
