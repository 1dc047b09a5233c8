"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one row in HEAVY_SHARE; so there are fewer than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 10_000


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join ``left`` with ``right``, where ``right`` has one row per ``key``, without a skewed task.

    Heavy keys of ``left`` are found by a partial aggregate.  They number fewer than ``HEAVY_SHARE`` whatever
    the size of the input, so their rows of ``right`` are broadcast; all other keys are shuffled.
    ``how`` is ``left`` or ``inner``.  A NULL key matches nothing.  ``left`` should be a written table: it is read
    more than once.
    """
    rows = left.count() if rows is None else rows
    least = max(rows // HEAVY_SHARE, 100)
    heavy = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > least) & F.col(key).isNotNull()).select(key)
    heavy_right = right.join(F.broadcast(heavy), key, "left_semi")
    hot = left.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(heavy_right), key, how)
    cold = left.join(F.broadcast(heavy), key, "left_anti").join(right, key, how)
    return hot.unionByName(cold)
