"""Spatial joins by equi joins on buckets, and skylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_polygons(points: DataFrame, polygons: DataFrame, bucket: float) -> DataFrame:
    """Pairs ``(point_id, polygon_id)`` by the even-odd rule, half-open in y, the ring closed implicitly.

    ``points(point_id, x, y)``, ``polygons(polygon_id, ring array<struct<x,y>>)``.  Polygons go to the buckets that
    their boxes touch; rings of under three points hold nothing.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    to = lambda x: F.floor(x / bucket)
    rings = polygons.filter(F.size("ring") >= 3).withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    rings = rings.withColumn("bx", F.explode(F.sequence(to(F.col("x0")), to(F.col("x1"))))).withColumn("by", F.explode(F.sequence(to(F.col("y0")), to(F.col("y1")))))
    near = points.select("point_id", "x", "y", to(F.col("x")).alias("bx"), to(F.col("y")).alias("by")).join(rings, ["bx", "by"])
    near = near.filter("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    crossed = """aggregate(sequence(1, size(ring)), 0, (n, i) -> n + CASE WHEN (ring[i - 1].y > y) <> (ring[if(i = 1, size(ring), i - 1) - 1].y > y)
        AND x < (ring[if(i = 1, size(ring), i - 1) - 1].x - ring[i - 1].x) * try_divide(y - ring[i - 1].y, ring[if(i = 1, size(ring), i - 1) - 1].y - ring[i - 1].y) + ring[i - 1].x
        THEN 1 ELSE 0 END) % 2 = 1"""
    return near.filter(F.expr(crossed)).select("point_id", "polygon_id")


def drop_restricted(launches: DataFrame, hits: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Launches in no critical or high restriction; ids keep their gaps."""
    bad = hits.join(restrictions.filter(F.col("severity").isin("Critical", "High")), "polygon_id", "left_semi").select(F.col("point_id").alias("launch_id")).distinct()
    return launches.join(bad, "launch_id", "left_anti")


def nearest(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """For each ``points(point_id, e, n)`` the nearest ``nodes(node, e, n)`` within the radius, inclusive; ties: least node."""
    to = lambda x: F.floor(F.col(x) / radius)
    beside = lambda x: F.explode(F.sequence(F.col(x) - 1, F.col(x) + 1))
    a = points.select("point_id", F.col("e").alias("pe"), F.col("n").alias("pn")).withColumns({"be": F.floor(F.col("pe") / radius), "bn": F.floor(F.col("pn") / radius)})
    a = a.withColumn("be", beside("be")).withColumn("bn", beside("bn"))
    b = nodes.select("node", "e", "n", to("e").alias("be"), to("n").alias("bn"))
    d2 = (F.col("e") - F.col("pe")) * (F.col("e") - F.col("pe")) + (F.col("n") - F.col("pn")) * (F.col("n") - F.col("pn"))
    pairs = a.join(b, ["be", "bn"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    return pairs.groupBy("point_id").agg(F.min(F.struct("d2", "node")).alias("m")).select("point_id", F.col("m.node").alias("node"), F.sqrt("m.d2").alias("distance_m"))


def ring_order(rings: int) -> list[tuple[int, int, int]]:
    """(ordinal, rows, columns) of offsets in the order of the search: ring by ring, column sides before row sides."""
    out = [(0, 0)]
    for r in range(1, rings + 1):
        out += [(d, side) for d in range(-r, r + 1) for side in (-r, r)]
        out += [(side, d) for d in range(-r + 1, r) for side in (-r, r)]
    return [(k, a, b) for k, (a, b) in enumerate(out)]


def snap_to_cells(points: DataFrame, dem: DataFrame, rings: int = 24) -> DataFrame:
    """``point_id, row, col, z`` of the first cell with a height in the rings around ``points(point_id, row, col)``; points off the raster give no row."""
    offsets = points.sparkSession.createDataFrame(ring_order(rings), "ordinal int, dr int, dc int")
    inside = points.join(dem.select("row", "col"), ["row", "col"], "left_semi")
    spread = inside.crossJoin(F.broadcast(offsets)).select("point_id", "ordinal", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    found = spread.join(dem.filter("z IS NOT NULL"), ["row", "col"])
    return found.groupBy("point_id").agg(F.min_by(F.struct("row", "col", "z"), "ordinal").alias("c")).select("point_id", "c.*")


def pareto(rows: DataFrame, cost: str, value: str) -> DataFrame:
    """Rows that none beats: no other has at most the cost and at least the value, one of them strictly.

    Best value by cost first (a partial aggregate), then a running maximum over distinct costs; in range partitions
    of the cost, so only one maximum per partition is looked at together.
    """
    tops = rows.groupBy(F.col(cost).alias("_c")).agg(F.max(value).alias("_top")).withColumn("_part", F.floor(F.log2(F.greatest(F.col("_c").cast("double"), F.lit(0.0)) + 1) * 16))
    parts = tops.groupBy("_part").agg(F.max("_top").alias("_best"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # some hundreds of rows
    before = parts.select("_part", F.max("_best").over(order).alias("_before"))
    own = Window.partitionBy("_part").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tops.withColumn("_own", F.max("_top").over(own)).join(F.broadcast(before), "_part")
    best = F.greatest("_own", "_before")
    front = ranked.filter(best.isNull() | (F.col("_top") > best)).select("_c", "_top")
    return rows.join(front, (rows[cost] == front["_c"]) & (rows[value] == front["_top"]), "left_semi")
