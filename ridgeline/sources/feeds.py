"""Readers and writers of the map feeds, with explicit schemas."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "struct<lat:double,lon:double,e:double,n:double>"
LIFTS = f"name string, kind string, lower {END}, upper {END}, length_m float, travel_seconds float"
TRAILS = "sac string, points array<array<double>>"
WARNINGS = "name string, kind string, severity string, polygon array<array<double>>"
OBSTACLES = "kind string, registration string, top_amsl_m float, max_agl_m float, geom struct<type:string,coords:variant>"
PEAKS = "name string, lat double, lon double, ele double"
OVERPASS = "elements array<struct<type:string,id:long,lat:double,lon:double,nodes:array<long>,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>>"
STAC = "features array<struct<id:string,assets:map<string,struct<href:string>>>>, links array<struct<rel:string,href:string>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An optional table: absent files give no rows."""
    try:
        return read_json(spark, path, schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def obstacle_points(obstacles: DataFrame) -> DataFrame:
    """``coords`` as a list of points, for points and lines alike."""
    point = F.array(F.try_variant_get("geom.coords", "$", "array<double>"))
    return obstacles.withColumn("points", F.when(F.col("geom.type") == "Point", point).otherwise(F.try_variant_get("geom.coords", "$", "array<array<double>>")))


def elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Overpass elements of one type."""
    return read_json(spark, path, OVERPASS).select(F.explode("elements").alias("x")).select("x.*").filter(F.col("type") == kind)


def outer_rings(spark: SparkSession, path: str) -> DataFrame:
    """Rings of restricted areas: ways, and the members of relations that aren't inner; at least three points."""
    ways = elements(spark, path, "way").select("id", "tags", "geometry")
    members = elements(spark, path, "relation").select("id", "tags", F.explode("members").alias("m"))
    members = members.filter("m.type = 'way' AND m.role <> 'inner'").select("id", "tags", "m.geometry")
    return ways.unionByName(members).filter(F.size("geometry") >= 3)


def tiles(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Latest tile of each place from catalogue pages; ids of another form are skipped.

    A well-formed tile without the wanted asset is an error, or with ``strict=False`` a NULL address.
    """
    f = read_json(spark, path, STAC).select(F.explode("features").alias("f")).select("f.*")
    part = lambda k: F.try_to_number(F.regexp_extract("id", r"^swissalti3d_(\d+)_(\d+)-(\d+)$", k), F.lit("999999")).cast("int")
    wanted = F.map_filter("assets", lambda k, _: k.endswith(".xyz.zip") & k.contains("_2_2056_"))
    href = F.map_values(wanted)[0]["href"] if not strict else F.when(F.size(wanted) > 0, F.element_at(F.map_values(wanted), 1)["href"]).otherwise(F.raise_error(F.concat(F.lit("no asset for "), F.col("id"))))
    rows = f.filter(F.col("id").rlike(r"^swissalti3d_\d+_\d+-\d+$")).select(part(1).alias("year"), part(2).alias("e_km"), part(3).alias("n_km"), (href if strict else F.try_element_at(F.map_values(wanted), F.lit(1))["href"]).alias("href"))
    latest = Window.partitionBy("e_km", "n_km").orderBy(F.desc("year"))
    return rows.withColumn("_k", F.row_number().over(latest)).filter("_k = 1").drop("_k")


def xyz_pixels(text: str, e_km: int, n_km: int, size: int = 500, step: float = 2.0) -> np.ndarray:
    """A tile's heights, north first; lines that aren't three numbers or lie outside are skipped, the last of a place counts."""
    out = np.full((size, size), np.nan)
    for line in text.splitlines():
        try:
            e, n, z = map(float, line.split()[:3])
        except ValueError:
            continue
        col, south = int(np.floor((e - e_km * 1000) / step + 0.5)), int(np.floor((n - n_km * 1000) / step + 0.5))
        if 0 <= col < size and 0 <= south < size:
            out[size - 1 - south, col] = z
    if np.isnan(out).all():
        raise ValueError(f"tile {e_km}-{n_km} has no usable row")
    return out


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """``e_km, n_km, prow, pcol, z`` of zipped tiles; the place is read from the file's name ``..._<e>-<n>_...``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e, n, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    name = next(x for x in z.namelist() if x.endswith(".xyz"))
                    grid = xyz_pixels(z.read(name).decode(errors="replace"), e, n)
                row, col = np.nonzero(~np.isnan(grid))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), e, np.int32)), pa.array(np.full(len(row), n, np.int32)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(grid[row, col])], names=["e_km", "n_km", "prow", "pcol", "z"])

    files = spark.read.format("binaryFile").load(path)
    part = lambda k: F.regexp_extract("path", r"(\d{4})-(\d{4})", k).cast("int")
    return files.select(part(1), part(2), "content").mapInArrow(run, "e_km int, n_km int, prow int, pcol int, z double")
