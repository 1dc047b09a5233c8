"""Glide floods and hiking times: fixpoints over rasters, by kernels on bounded pieces of the raster."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scoring import MOVES, SAC_MULTIPLIER, ground_ratios
from ridgeline.params import Glide, Hike
from ridgeline.scratch import materialise

#: Cells along a side of the tiles in which rasters meet kernels.
TILE = 64


def flood_kernel(heights: dict[tuple[int, int], float], start: tuple[int, int], altitude: float, cell_m: float, p: Glide) -> dict[tuple[int, int], float]:
    """Greatest altitudes at which cells are reached with the buffer kept; the start itself isn't tested."""
    moves = [(dr, dc, cell_m * length / ratio) for dr, dc, length, ratio in ground_ratios(p)]
    best, heap, settled = {start: altitude}, [(-altitude, start)], set()
    while heap:
        negative, at = heapq.heappop(heap)
        if at in settled:
            continue
        settled.add(at)
        for dr, dc, loss in moves:
            to = (at[0] + dr, at[1] + dc)
            z = heights.get(to)
            new = -negative - loss
            if z is not None and to not in settled and new - z >= p.buffer_m and new > best.get(to, -math.inf):
                best[to] = new
                heapq.heappush(heap, (-new, to))
    return best


def floods(launches: DataFrame, dem: DataFrame, cell_m: float, p: Glide = Glide()) -> DataFrame:
    """``launch_id, row, col, alt, is_source`` for every cell that a launch reaches.

    A launch meets only the tiles within its greatest reach, by an equi join on tiles, and is one group of the kernel;
    so no raster is broadcast and a group's size is bounded by the reach, not by the raster.
    """
    top = max((r for _, _, _, r in ground_ratios(p)), default=0.0)
    least = dem.agg(F.min("z").alias("_least"))
    reach = F.ceil(F.greatest(F.col("alt_m") + p.takeoff_agl_m - p.buffer_m - F.col("_least"), F.lit(0.0)) * top / cell_m) + 1
    tile = lambda x: F.floor(x / TILE)
    near = launches.select("launch_id", F.col("row").alias("r0"), F.col("col").alias("c0"), "alt_m").join(F.broadcast(least)).withColumn("reach", reach)
    near = near.withColumn("tr", F.explode(F.sequence(tile(F.col("r0") - F.col("reach")), tile(F.col("r0") + F.col("reach")))))
    near = near.withColumn("tc", F.explode(F.sequence(tile(F.col("c0") - F.col("reach")), tile(F.col("c0") + F.col("reach")))))
    tiles = dem.filter("z IS NOT NULL").groupBy(tile(F.col("row")).alias("tr"), tile(F.col("col")).alias("tc")).agg(F.collect_list("row").alias("rows"), F.collect_list("col").alias("cols"), F.collect_list("z").alias("zs"))

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        heights = {(int(r), int(c)): float(z) for rows, cols, zs in zip(g["rows"], g["cols"], g["zs"]) for r, c, z in zip(rows, cols, zs)}
        first = g.iloc[0]
        start = (int(first["r0"]), int(first["c0"]))
        best = flood_kernel(heights, start, float(first["alt_m"]) + p.takeoff_agl_m, cell_m, p)
        return pd.DataFrame([(first["launch_id"], r, c, a, (r, c) == start) for (r, c), a in best.items()], columns=["launch_id", "row", "col", "alt", "is_source"])

    return near.join(tiles, ["tr", "tc"]).groupBy("launch_id").applyInPandas(kernel, "launch_id long, row int, col int, alt double, is_source boolean")


def flood_summary(flood: DataFrame, launches: DataFrame, cell_m: float) -> DataFrame:
    """Reached cells, greatest distance, its cell (ties: least row, column) and area, one row per launch."""
    far = F.sqrt((F.col("row") - F.col("r0")) ** 2 + (F.col("col") - F.col("c0")) ** 2) * cell_m
    own = flood.filter("NOT is_source").join(launches.select("launch_id", F.col("row").alias("r0"), F.col("col").alias("c0")), "launch_id").withColumn("far", far)
    stats = own.groupBy("launch_id").agg(F.count(F.lit(1)).alias("reached"), F.max("far").alias("max_distance_m"), F.min_by(F.struct("row", "col"), F.struct(-F.col("far"), "row", "col")).alias("farthest"))
    out = launches.select("launch_id").join(stats, "launch_id", "left")
    return out.select("launch_id", F.coalesce("reached", F.lit(0)).alias("reached"), F.coalesce("max_distance_m", F.lit(0.0)).alias("max_distance_m"), (F.coalesce("reached", F.lit(0)) * cell_m * cell_m).alias("area_m2"), F.col("farthest.row").alias("far_row"), F.col("farthest.col").alias("far_col"))


def hike_seconds(z0: float, z1: float, length: float, multiplier: float) -> float:
    kmh = max(6 * math.exp(-3.5 * abs((z1 - z0) / length + 0.05)), 0.05)
    return length / (kmh / 3.6) * multiplier


def hike_kernel(heights: dict[tuple[int, int], float], seeds: dict[tuple[int, int], float], cell_m: float, p: Hike) -> dict[tuple[int, int], float]:
    """Least seconds from the seeds; nothing goes on beyond the cap, but seeds keep their own time."""
    best = dict(seeds)
    heap = [(t, at) for at, t in seeds.items()]
    heapq.heapify(heap)
    multiplier = SAC_MULTIPLIER[p.sac]
    while heap:
        t, at = heapq.heappop(heap)
        z = heights.get(at)
        if t > best[at] or t > p.max_seconds or z is None:
            continue
        for dr, dc, length in MOVES:
            to = (at[0] + dr, at[1] + dc)
            z1 = heights.get(to)
            if z1 is None:
                continue
            new = t + hike_seconds(z, z1, cell_m * length, multiplier)
            if new <= p.max_seconds and new < best.get(to, math.inf):
                best[to] = new
                heapq.heappush(heap, (new, to))
    return best


def hike_field(dem: DataFrame, seeds: DataFrame, cell_m: float, p: Hike = Hike(), tile: int = TILE, max_rounds: int = 10_000) -> DataFrame:
    """``row, col, seconds`` of all cells that hikers reach from ``seeds(row, col, seconds)``.

    By tiles: each round solves exactly the tiles beside which a time has improved, with the times around them as
    seeds, until none improves.  Costs aren't negative, so the order of tiles doesn't matter.  A task holds one tile.
    """
    t = lambda x: F.floor(F.col(x) / tile)
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = dem.filter("z IS NOT NULL").withColumn("tr", F.explode(F.array_distinct(F.transform(step, lambda s: F.floor((F.col("row") + s) / tile)))))
    around = around.withColumn("tc", F.explode(F.array_distinct(F.transform(step, lambda s: F.floor((F.col("col") + s) / tile)))))
    around = materialise(around.select("row", "col", "z", "tr", "tc"), "halo")
    seeds = seeds.join(dem.select("row", "col"), ["row", "col"], "left_semi").groupBy("row", "col").agg(F.min("seconds").cast("double").alias("seconds"))
    state = materialise(seeds, "hike")
    moved = state

    def kernel(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        heights = {(int(r), int(c)): float(z) for r, c, z in zip(g["row"], g["col"], g["z"])}
        known = {(int(r), int(c)): float(s) for r, c, s in zip(g["row"], g["col"], g["seconds"]) if s == s}
        best = hike_kernel(heights, known, cell_m, p)
        out = [(r, c, s) for (r, c), s in best.items() if r // tile == key[0] and c // tile == key[1] and s < known.get((r, c), math.inf)]
        return pd.DataFrame(out, columns=["row", "col", "seconds"])

    for _ in range(max_rounds):
        touched = moved.withColumn("tr", F.explode(F.array_distinct(F.transform(step, lambda s: F.floor((F.col("row") + s) / tile)))))
        touched = touched.withColumn("tc", F.explode(F.array_distinct(F.transform(step, lambda s: F.floor((F.col("col") + s) / tile))))).select("tr", "tc").distinct()
        work = around.join(touched, ["tr", "tc"], "left_semi").join(state, ["row", "col"], "left")
        moved = materialise(work.groupBy("tr", "tc").applyInPandas(kernel, "row int, col int, seconds double"), "moved")
        if moved.isEmpty():
            return state
        state = materialise(state.unionByName(moved).groupBy("row", "col").agg(F.min("seconds").alias("seconds")), "hike")
    raise RuntimeError("hiking times did not settle")


def relax(edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``node, seconds`` from ``edges(src, dst, seconds)`` and ``seeds(node, seconds)``, by rounds over the frontier.

    One join and one partial aggregate a round; the state is written, so lineage doesn't grow.
    """
    state = materialise(seeds.groupBy("node").agg(F.min("seconds").cast("double").alias("seconds")), "cost")
    edges = materialise(edges.select("src", "dst", F.col("seconds").alias("step")), "edges")
    moved = state
    for _ in range(max_rounds):
        new = edges.join(moved, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("seconds") + F.col("step")).alias("new"))
        moved = materialise(new.join(state, "node", "left").filter("seconds IS NULL OR new < seconds").select("node", F.col("new").alias("seconds")), "moved")
        if moved.isEmpty():
            return state
        state = materialise(state.unionByName(moved).groupBy("node").agg(F.min("seconds").alias("seconds")), "cost")
    raise RuntimeError("path costs did not settle")
