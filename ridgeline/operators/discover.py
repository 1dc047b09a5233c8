"""Candidate launch cells, greedy thinning and the launch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geo import aspect_in_arc, aspect_window
from ridgeline.params import Discovery
from ridgeline.scratch import materialise


def candidates(terrain: DataFrame, p: Discovery = Discovery()) -> DataFrame:
    """Cells that pass the filters, with their score; measures are rounded so that engines agree on the bounds."""
    t = terrain.withColumns({c: F.round(c, 6) for c in ("slope", "aspect", "roughness")})
    t = t.filter(F.col("z").isNotNull() & F.col("slope").between(p.slope_min, p.slope_max) & (F.col("roughness") <= p.max_roughness_m) & aspect_in_arc(F.col("aspect"), *p.arc))
    steep, rough = (F.col("slope") - 30) / 8, F.col("roughness") / p.max_roughness_m
    return t.withColumn("score", F.round(F.col("z") - 50 * steep * steep - 50 * rough * rough, 6))


def thin(cells: DataFrame, radius_cells: float, max_rounds: int = 10_000) -> DataFrame:
    """The cells that a pass in descending score (ties by row, column) keeps, dropping any nearer than the radius to a kept one.

    In rounds: a cell without a better undecided neighbour is kept and its neighbours go.  Neighbours meet by an
    equi join on buckets of the radius, so no round compares all pairs.
    """
    size = max(1.0, float(radius_cells))
    better = F.struct(-F.col("score"), F.col("row"), F.col("col"))
    left = materialise(cells.select("row", "col", "score"), "undecided")
    kept = left.limit(0)
    for _ in range(max_rounds):
        own = left.select("row", "col", better.alias("rank"), F.floor(F.col("row") / size).alias("br"), F.floor(F.col("col") / size).alias("bc"))
        beside = lambda x: F.explode(F.sequence(F.col(x) - 1, F.col(x) + 1))
        spread = own.withColumn("br", beside("br")).withColumn("bc", beside("bc"))
        a, b = own.alias("a"), spread.alias("b")
        d2 = (F.col("a.row") - F.col("b.row")) ** 2 + (F.col("a.col") - F.col("b.col")) ** 2
        pairs = a.join(b, (F.col("a.br") == F.col("b.br")) & (F.col("a.bc") == F.col("b.bc")) & (d2 < radius_cells**2) & (F.col("b.rank") < F.col("a.rank")))
        beaten = materialise(pairs.select(F.col("a.row").alias("row"), F.col("a.col").alias("col"), F.col("b.row").alias("by_row"), F.col("b.col").alias("by_col")), "beaten")
        new = materialise(left.join(beaten.select("row", "col").distinct(), ["row", "col"], "left_anti"), "kept")
        kept = kept.unionByName(new)
        gone = beaten.join(new.select(F.col("row").alias("by_row"), F.col("col").alias("by_col")), ["by_row", "by_col"], "left_semi").select("row", "col").distinct()
        rest = left.join(new, ["row", "col"], "left_anti").join(gone, ["row", "col"], "left_anti")
        left = materialise(rest, "undecided")
        if left.isEmpty():
            return kept
    raise RuntimeError("thinning did not end")


def launches(terrain: DataFrame, cell_m: float, p: Discovery = Discovery()) -> DataFrame:
    """Launch rows with ids in order of score; what later filters drop leaves gaps in the ids."""
    found = candidates(terrain, p)
    kept = thin(found, p.dedupe_radius_m / cell_m)
    best = found.join(kept.select("row", "col"), ["row", "col"], "left_semi").orderBy(F.desc("score"), "row", "col").limit(p.max_launches)
    order = Window.orderBy(F.desc("score"), "row", "col")  # over max_launches rows at most
    lo, hi = aspect_window(F.col("aspect"), p.arc_half_width)
    return best.select((F.row_number().over(order) - 1).alias("launch_id"), "row", "col", F.col("z").alias("alt_m"), "aspect", "slope", "score", lo.alias("window_lo"), hi.alias("window_hi"), F.lit("AutoDiscovered").alias("kind"))
