"""Rasters as rows ``(row, col, z)``: stencils, roughness, ranges and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.params import Grid


def from_function(spark: SparkSession, grid: Grid, z: Column) -> DataFrame:
    """A raster from an expression over ``row`` and ``col``."""
    cells = spark.range(grid.rows * grid.cols).select((F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col"))
    return cells.withColumn("z", z.cast("double"))


def synthetic_mountain(spark: SparkSession) -> tuple[Grid, DataFrame]:
    grid = Grid(161, 161, 25.0, 2_600_000.0, 1_200_000.0)
    d2 = (F.col("row") - 80.5) * (F.col("row") - 80.5) + (F.col("col") - 80.5) * (F.col("col") - 80.5)
    return grid, from_function(spark, grid, 800 + 1600 * F.exp(-d2 / 2450) - (F.col("row") - 80.5) * 0.5)


def neighbourhood(dem: DataFrame) -> DataFrame:
    """The eight neighbours of each cell as columns; NULL where a cell is absent or without a height.

    Two window passes: heights above and below by column, then the three by row.
    """
    by_col, by_row = Window.partitionBy("col").orderBy("row"), Window.partitionBy("row").orderBy("col")

    def beside(name: str, step: int, axis: str, w) -> Column:  # noqa: ANN001
        f = F.lag if step < 0 else F.lead
        return F.when(f(axis, 1).over(w) == F.col(axis) + step, f(name, 1).over(w))

    tall = dem.withColumns({"n": beside("z", -1, "row", by_col), "s": beside("z", 1, "row", by_col)})
    return tall.withColumns({
        "w": beside("z", -1, "col", by_row), "e": beside("z", 1, "col", by_row), "nw": beside("n", -1, "col", by_row),
        "ne": beside("n", 1, "col", by_row), "sw": beside("s", -1, "col", by_row), "se": beside("s", 1, "col", by_row),
    })


def terrain(dem: DataFrame, cell_m: float) -> DataFrame:
    """``slope`` and ``aspect`` in degrees (Horn) and ``roughness``, the RMS residual of the plane through nine cells."""
    dx = ((F.col("ne") + 2 * F.col("e") + F.col("se")) - (F.col("nw") + 2 * F.col("w") + F.col("sw"))) / (8 * cell_m)
    dn = ((F.col("nw") + 2 * F.col("n") + F.col("ne")) - (F.col("sw") + 2 * F.col("s") + F.col("se"))) / (8 * cell_m)
    steep = F.sqrt(F.col("dx") * F.col("dx") + F.col("dn") * F.col("dn"))
    aspect = F.degrees(F.atan2(-F.col("dx"), -F.col("dn")))
    # the plane's residual from sums of heights above the centre: all squares less what mean and slopes explain
    off = [F.col(k) - F.col("z") for k in ("nw", "n", "ne", "w", "e", "sw", "s", "se")]
    mean = sum(off, F.lit(0.0)) / 9
    b = ((F.col("ne") + F.col("e") + F.col("se")) - (F.col("nw") + F.col("w") + F.col("sw"))) / 6
    c = ((F.col("sw") + F.col("s") + F.col("se")) - (F.col("nw") + F.col("n") + F.col("ne"))) / 6
    rough = F.sqrt(F.greatest(sum((o * o for o in off), F.lit(0.0)) - 9 * mean * mean - 6 * b * b - 6 * c * c, F.lit(0.0)) / 9)
    rough = F.when(mean.isNotNull(), rough)
    out = neighbourhood(dem).withColumns({"dx": dx, "dn": dn, "roughness": rough})
    out = out.withColumns({"steep": steep, "aspect": aspect - 360 * F.floor(aspect / 360)})
    out = out.withColumns({"slope": F.degrees(F.atan("steep")), "aspect": F.when(F.col("steep") >= 1e-6, F.col("aspect"))})
    return out.select(*dem.columns, "slope", "aspect", "roughness")


def elevation_range(dem: DataFrame) -> DataFrame:
    return dem.agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count("z").alias("n_cells"))


def overlay(pixels: DataFrame, grid: Grid, pixel_m: float) -> DataFrame:
    """Tiles' pixels ``(tile, e, n, z)`` averaged onto a grid; a pixel counts in each cell that it overlaps.

    Where tiles meet, their means are averaged in the order of tiles, one after the other.
    """
    half = pixel_m / 2
    lo = lambda x: F.floor(x / grid.cell_m + 0.5)
    hi = lambda x: F.ceil(x / grid.cell_m + 0.5) - 1
    col = F.sequence(lo(F.col("e") - half - grid.origin_e), hi(F.col("e") + half - grid.origin_e))
    row = F.sequence(lo(grid.origin_n - F.col("n") - half), hi(grid.origin_n - F.col("n") + half))
    spread = pixels.filter("z IS NOT NULL").withColumn("col", F.explode(col)).withColumn("row", F.explode(row))
    spread = spread.filter(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1))
    means = spread.groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "tile").agg(F.avg("z").alias("z"))
    ordered = F.expr("transform(array_sort(collect_list(struct(tile, z))), x -> x.z)")
    return means.groupBy("row", "col").agg(ordered.alias("zs")).select("row", "col", F.expr("aggregate(slice(zs, 2, size(zs)), zs[0], (a, z) -> (a + z) / 2)").alias("z"))
