"""Composite queries: ranked launches, reachability, data set information, and the demonstration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.geo import centre_of, lv95_to_wgs84
from ridgeline.functions.scoring import launch_score, wind_factor
from ridgeline.operators import discover, raster, reach
from ridgeline.operators.spatial import pareto
from ridgeline.params import Discovery, Glide, Grid, Hike, Scoring, Wind
from ridgeline.scratch import materialise


def rank_launches(launches: DataFrame, summary: DataFrame, hike: DataFrame, grid: Grid, wind: Wind | None = Wind(), scoring: Scoring = Scoring()) -> DataFrame:
    """Launches with reach, hiking time, wind factor and score, best first; unreached ones have infinite time."""
    rows = launches.join(summary, "launch_id").join(hike, ["row", "col"], "left").withColumn("hike_s", F.coalesce("seconds", F.lit(float("inf"))))
    rows = rows.withColumn("wind_factor", wind_factor(F.col("aspect"), F.lit(float(wind.from_deg)), scoring.full_strength_deg) if wind else F.lit(1.0))
    rows = rows.withColumn("score", launch_score(F.col("max_distance_m"), F.col("area_m2"), F.col("hike_s"), F.col("wind_factor"), scoring))
    e, n = centre_of(F.col("row"), F.col("col"), grid)
    far_e, far_n = centre_of(F.col("far_row"), F.col("far_col"), grid)
    (lon, lat), (far_lon, far_lat) = lv95_to_wgs84(e, n), lv95_to_wgs84(far_e, far_n)
    return rows.select(
        "launch_id", "row", "col", e.alias("e"), n.alias("n"), lon.alias("lon"), lat.alias("lat"), "alt_m", "aspect", "slope", (F.col("max_distance_m") / 1000).alias("glide_distance_km"),
        (F.col("area_m2") / 1e6).alias("glide_area_km2"), (F.col("hike_s") / 60).alias("hike_minutes"), "wind_factor", "score", far_lat.alias("farthest_lat"), far_lon.alias("farthest_lon"),
    ).orderBy(F.desc("score"), "launch_id")


def dem_info(dem: DataFrame, grid: Grid) -> DataFrame:
    return raster.elevation_range(dem).withColumns({"rows": F.lit(grid.rows), "cols": F.lit(grid.cols), "cell_m": F.lit(grid.cell_m)})


def reachability(launches: DataFrame, launch_id: int, dem: DataFrame, cell_m: float, glide: Glide = Glide()) -> DataFrame:
    """Cells that one launch reaches, with altitude; an unknown id is an error."""
    one = launches.filter(F.col("launch_id") == launch_id)
    if one.isEmpty():
        raise KeyError(launch_id)
    return reach.floods(one, dem, cell_m, glide)


def evaluate(dem: DataFrame, grid: Grid, seeds: DataFrame, discovery: Discovery = Discovery(), glide: Glide = Glide(), hiking: Hike = Hike(), wind: Wind | None = Wind(), scoring: Scoring = Scoring()) -> DataFrame:
    """From a raster and hiking seeds to ranked launches."""
    dem = materialise(dem, "dem")
    launches = materialise(discover.launches(raster.terrain(dem, grid.cell_m), grid.cell_m, discovery), "launches")
    summary = reach.flood_summary(reach.floods(launches, dem, grid.cell_m, glide), launches, grid.cell_m)
    return rank_launches(launches, summary, reach.hike_field(dem, seeds, grid.cell_m, hiking), grid, wind, scoring)


def demo(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The synthetic mountain: ranked launches and the frontier of hiking time against reach."""
    grid, dem = raster.synthetic_mountain(spark)
    seeds = spark.createDataFrame([(grid.rows - 2, grid.cols // 2, 0.0)], "row int, col int, seconds double")
    ranked = materialise(evaluate(dem, grid, seeds, Discovery(max_launches=80)), "ranked")
    return ranked, pareto(ranked, "hike_minutes", "glide_distance_km").orderBy("hike_minutes")
