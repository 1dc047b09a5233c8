"""Behaviour of the terrain, reach and ranking operators on small rasters and hand-made rows."""

import json
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import classify, geo, render, scoring
from ridgeline.operators import components, discover, raster, reach, spatial, trails
from ridgeline.params import Discovery, Glide, Grid, Hike, Wind
from ridgeline.sources import feeds, raster_file

CELL = 25.0


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def grid_of(spark, n, z):
    return raster.from_function(spark, Grid(n, n), z)


def test_angles(spark):
    assert value(spark, geo.norm_deg(F.lit(-10.0)), geo.norm_deg(F.lit(370.0))) == (350, 10)
    assert value(spark, geo.angle_diff_deg(*lit(10, 350)), geo.angle_diff_deg(*lit(350, 10))) == (20, -20)
    assert value(spark, geo.angle_in_arc(*lit(180, 135, 225)), geo.angle_in_arc(*lit(0, 135, 225)), geo.angle_in_arc(*lit(120, 135, 225), 30.0)) == (True, False, True)
    assert value(spark, geo.angle_in_arc(*lit(0, 315, 45)), geo.angle_in_arc(*lit(0, 315, 45), strict_reference=False)) == (False, True)


def test_projection(spark):
    lon, lat = value(spark, *geo.lv95_to_wgs84(*lit(2627770, 1174610)))
    assert abs(lon - 7.797) < 0.01 and abs(lat - 46.722) < 0.01
    e, n = value(spark, *geo.wgs84_to_lv95(*lit(lon, lat)))
    assert math.hypot(e - 2627770, n - 1174610) < 2


def test_terrain(spark):
    flat = {(r["row"], r["col"]): r for r in raster.terrain(grid_of(spark, 5, F.lit(1000.0)), CELL).collect()}
    assert flat[2, 2]["slope"] == 0 and flat[2, 2]["aspect"] is None and flat[2, 2]["roughness"] < 1e-6 and flat[0, 0]["slope"] is None
    ramp = {(r["row"], r["col"]): r for r in raster.terrain(grid_of(spark, 5, 1000 + (4 - F.col("row")) * 25), CELL).collect()}
    assert abs(ramp[2, 2]["aspect"] - 180) < 1 and abs(ramp[2, 2]["slope"] - 45) < 1e-6 and ramp[2, 2]["roughness"] < 1e-6


def test_discovery(spark):
    far = F.sqrt((F.col("row") - 40.5) ** 2 + (F.col("col") - 40.5) ** 2) * CELL
    cone = raster.terrain(grid_of(spark, 81, F.greatest(F.lit(0.0), 1500 - far * 0.58)), CELL)
    found = discover.launches(cone, CELL, Discovery(dedupe_radius_m=500.0)).collect()
    assert 5 < len(found) < 20 and all(22 <= r["slope"] <= 38 and 85 <= r["aspect"] <= 275 for r in found)
    rows = sorted(((-r["score"], r["row"], r["col"]) for r in discover.candidates(cone).collect()))
    kept = []
    for s, r, c in rows:
        if all((r - a) ** 2 + (c - b) ** 2 >= 16 for _, a, b in kept):
            kept.append((s, r, c))
    assert {(r["row"], r["col"]) for r in discover.thin(discover.candidates(cone), 4.0).collect()} == {(r, c) for _, r, c in kept}
    assert discover.candidates(raster.terrain(grid_of(spark, 50, F.lit(1000.0)), CELL)).count() == 0


def reached(spark, dem, row, col, alt, glide):
    launch = spark.createDataFrame([(1, row, col, float(alt))], "launch_id long, row int, col int, alt_m double")
    flood = reach.floods(launch, dem, CELL, glide)
    return {(r["row"], r["col"]) for r in flood.collect()}, reach.flood_summary(flood, launch, CELL).first()


def test_floods(spark):
    flat = grid_of(spark, 81, F.lit(0.0)).cache()
    cells, summary = reached(spark, flat, 40, 40, 1000, Glide(buffer_m=0, takeoff_agl_m=0))
    assert summary["reached"] == 6560 and summary["max_distance_m"] > 1400 and summary["area_m2"] == 6560 * 625
    wall = grid_of(spark, 21, F.when(F.col("col") >= 12, 800.0).otherwise(0.0))
    cells, _ = reached(spark, wall, 10, 5, 500, Glide(buffer_m=30, takeoff_agl_m=0))
    assert (10, 0) in cells and (10, 18) not in cells
    still, s0 = reached(spark, flat, 40, 40, 100, Glide(buffer_m=0, takeoff_agl_m=0))
    tail, s1 = reached(spark, flat, 40, 40, 100, Glide(buffer_m=0, takeoff_agl_m=0, wind=Wind(180, 18)))
    assert s1["max_distance_m"] > s0["max_distance_m"] and s1["far_row"] < 40
    head, _ = reached(spark, flat, 40, 40, 100, Glide(buffer_m=0, takeoff_agl_m=0, wind=Wind(0, 50)))
    assert (35, 40) not in head and (45, 40) in head
    assert s0["reached"] > reached(spark, flat, 40, 40, 100, Glide(ratio=5, buffer_m=0, takeoff_agl_m=0))[1]["reached"]


def test_hiking(spark):
    assert abs(value(spark, scoring.tobler_kmh(F.lit(-0.05)))[0] - 6) < 1e-3
    seed = lambda *rows: spark.createDataFrame(list(rows), "row int, col int, seconds double")
    at = lambda dem, seeds, **k: {(r["row"], r["col"]): r["seconds"] for r in reach.hike_field(dem, seeds, CELL, **k).collect()}
    flat, ramp = grid_of(spark, 21, F.lit(1000.0)), grid_of(spark, 21, 1000 + (20 - F.col("row")) * 25)
    level = at(flat, seed((10, 10, 0.0)))
    assert level[10, 20] > level[10, 11]
    climb, far = at(ramp, seed((20, 10, 0.0))), at(flat, seed((20, 10, 0.0)))
    assert climb[0, 10] > 1.5 * far[0, 10]
    assert at(flat, seed((10, 0, 0.0), (10, 20, 1000.0)))[10, 10] < 500
    hills = raster.from_function(spark, Grid(21, 21), 900 + 80 * F.sin(F.col("row") / 3) + 60 * F.cos(F.col("col") / 2))
    assert at(hills, seed((3, 4, 0.0)), tile=7) == pytest.approx(at(hills, seed((3, 4, 0.0)), tile=64))
    late = at(flat, seed((0, 0, 7 * 3600.0)), p=Hike())
    assert late == {(0, 0): 7 * 3600.0}


def test_scores(spark):
    full = lambda a, w: scoring.wind_factor(*lit(a, w))
    a, b, c = value(spark, full(180, 180), full(180, 0), full(180, 135))
    assert a == 1 and b < 0.01 and abs(c - math.cos(math.radians(30))) < 1e-9
    from ridgeline.params import Scoring

    inf = F.lit(float("inf"))
    scores = [scoring.launch_score(F.lit(5.0), F.lit(0.0), inf, F.lit(1.0), Scoring(alpha=x)) for x in (1.0, 0.0, -1.0)]
    assert value(spark, *scores) == (0, 5, 0)
    keys = [scoring.bucket(*lit(g, d, s)) for g, d, s in ((1, 0, 0), (7.74, 359.9, 0.6), (7.75, -1, 3.99), (25, 0, 2))]
    assert [value(spark, *k) for k in keys] == [(4, -1, -1), (15, 350, 0), (16, 350, 2), (40, 0, 2)]


def test_skyline(spark):
    rows = [(0, 3000.0, 5000.0), (1, 6000.0, 8000.0), (2, 6000.0, 4000.0), (3, 3000.0, 5000.0), (4, 7000.0, 8000.0), (5, float("inf"), 9000.0)]
    got = spatial.pareto(spark.createDataFrame(rows, "id int, hike double, glide double"), "hike", "glide")
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 3, 5]


def test_points_in_polygons(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
    polygons = spark.createDataFrame([(1, square, "High"), (2, square[:2], "High"), (3, square, "Low")], "polygon_id int, ring array<struct<x:double,y:double>>, severity string")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 0.0, 0.5), (4, 1.0, 0.5), (5, 0.5, 0.0), (6, 0.5, 1.0)], "point_id int, x double, y double")
    hits = spatial.in_polygons(points, polygons, 0.3)
    assert sorted(map(tuple, hits.collect())) == [(p, k) for p in (1, 3, 5) for k in (1, 3)]
    left = spatial.drop_restricted(points.withColumnRenamed("point_id", "launch_id"), hits, polygons)
    assert sorted(r["launch_id"] for r in left.collect()) == [2, 4, 6]


def test_snapping(spark):
    dem = grid_of(spark, 9, F.when((F.col("row") == 4) & (F.col("col") == 2), 5.0).when((F.col("row") == 2) & (F.col("col") == 4), 6.0))
    points = spark.createDataFrame([(1, 4, 4), (2, 4, 2), (3, 40, 4)], "point_id int, row int, col int")
    assert sorted(map(tuple, spatial.snap_to_cells(points, dem, 5).collect())) == [(1, 4, 2, 5.0), (2, 4, 2, 5.0)]


def test_trails(spark):
    grid = Grid(10, 10, CELL, 0.0, 0.0)
    dem = raster.from_function(spark, grid, F.col("col") * 10.0)
    points = [(1, 0, 0.0, 0.0), (1, 1, 100.0, 0.0), (2, 0, 100.3, 0.2), (2, 1, 100.4, -100.0), (2, 2, 100.4, -100.3), (3, 0, 9000.0, 0.0), (3, 1, 0.0, 0.0)]
    nodes, edges = trails.trail_graph(spark.createDataFrame(points, "line int, ordinal int, e double, n double"), dem, grid)
    assert sorted(r["node"] for r in nodes.collect()) == ["0:0", "100:-100", "100:0", "9000:0"]
    cost = {(r["src"], r["dst"]): r["seconds"] for r in edges.collect()}
    assert cost["0:0", "100:0"] == cost["100:0", "0:0"] == pytest.approx((0.1 + 0.0125) * 3600) and len(cost) == 6
    reachable = {r["node"]: r["seconds"] for r in reach.relax(edges, spark.createDataFrame([("0:0", 0.0)], "node string, seconds double")).collect()}
    assert len(reachable) == 4 and reachable["100:-100"] > reachable["100:0"]


def test_components(spark):
    z = F.when(F.col("col") < 10, 100 - F.col("col")).when(F.col("col") > 11, 50 + F.col("row"))
    found = trails.raster_components(grid_of(spark, 30, z))
    assert sorted((r["cells"], r["row"], r["col"]) for r in trails.trailheads(found, 200).collect()) == [(300, 0, 9), (540, 0, 12)]
    diagonal = trails.raster_components(grid_of(spark, 2, F.when(F.col("row") == F.col("col"), 1.0)))
    assert diagonal.select("component").distinct().count() == 2
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(chain).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert components.connected_components(chain.limit(0)).count() == 0
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4]), (5, [9, 8]), (7, [4, 11])], "way long, nodes array<long>")
    assert {r["way"]: r["cluster"] for r in trails.lift_clusters(ways).collect()} == {1: 1, 2: 1, 5: 5, 7: 1}


def test_lift_assembly(spark):
    rows = [(1, "Gondola", None, [1, 2]), (2, "ChairLift", "B", [2, 3]), (3, None, "x", [5, 6]), (4, "CableCar", None, [7]), (6, "CableCar", None, [8, 9]), (9, "CableCar", "y", [1, 77])]
    ways = spark.createDataFrame(rows, "way long, kind string, name string, nodes array<long>")
    nodes = spark.createDataFrame([(1, 46.0, 7.0), (2, 46.01, 7.0), (3, 46.02, 7.0), (8, 46.0, 7.1), (9, 46.00001, 7.1), (77, None, 7.0)], "node long, lat double, lon double")
    (row,) = trails.assemble_lifts(ways, nodes).collect()
    assert (row["cluster"], row["kind"], row["name"], row["human"], row["lower"]["lat"], row["upper"]["lat"]) == (1, "CableCar", "B", True, 46.0, 46.02)
    assert 2200 < row["length_m"] < 2250 and math.isclose(row["travel_seconds"], row["length_m"] / 8 + 180)
    assert trails.assemble_lifts(ways, nodes.filter("node <> 2")).count() == 0
    assert trails.assemble_lifts(ways.limit(0), nodes).count() == 0


def test_farthest():
    rng = np.random.default_rng(1)
    for n in (2, 3, 30):
        for high in (3, 1000):
            p = pd.DataFrame({"cluster": 1, "way": range(n), "ordinal": 0, "lat": 0.0, "lon": range(n), "e": rng.integers(0, high, n) * 1.0, "n": rng.integers(0, high, n) * 1.0})
            pairs = [(-math.hypot(p.e[i] - p.e[j], p.n[i] - p.n[j]), i, j) for i in range(n) for j in range(i + 1, n)]
            d, i, j = min(pairs)
            got = trails.farthest(p).iloc[0]
            assert (got["lower"]["lon"], got["upper"]["lon"]) == ((i, j) if d else (0, 0))


def test_many_small_lifts(spark, monkeypatch):
    """Small lifts are compared many at a time, without a call of ``farthest`` for each; large ones by their hulls, to the same ends."""
    rng = np.random.default_rng(2)
    sizes = np.array([1, 2, 2, 3, 1, 5, 3, 40])
    e, n = (rng.integers(0, 4, sizes.sum()) * 1.0 for _ in range(2))
    e[1:3] = n[1:3] = 1.0  # one place
    base = np.cumsum(sizes) - sizes
    for lower, upper, at, size in zip(*trails.farthest_pairs(sizes, e, n), base, sizes):
        pairs = [(-math.hypot(e[i] - e[j], n[i] - n[j]), i, j) for i in range(at, at + size) for j in range(i + 1, at + size)]
        d, i, j = min(pairs, default=(0, at, at))
        assert (lower, upper) == ((i, j) if d else (at, at))

    rows = [(k, "Gondola", None, list(range(9 * k, 9 * k + 2 + k % 7))) for k in range(20)]
    ways = spark.createDataFrame(rows, "way long, kind string, name string, nodes array<long>")
    nodes = spark.range(600).select(F.col("id").alias("node"), (46 + F.col("id") * 7 % 101 * 1e-4).alias("lat"), (7 + F.col("id") * 3 % 89 * 1e-4).alias("lon"))
    monkeypatch.setattr(trails, "PAIRED", 1)
    want = sorted(map(str, trails.assemble_lifts(ways, nodes).collect()))
    monkeypatch.setattr(trails, "PAIRED", 4)
    assert sorted(map(str, trails.assemble_lifts(ways, nodes).collect())) == want
    monkeypatch.undo()
    found = trails.assemble_lifts(ways, nodes)
    assert sorted(map(str, found.collect())) == want and len(want) > 12


def test_classes(spark):
    none = F.lit(None).cast("string")
    kinds = [classify.lift_kind(F.lit(a) if a else none, F.lit(r) if r else none, F.lit(k) if k else none) for a, r, k in (("drag_lift", "funicular", None), (None, "rail", "yes"), (None, "rail", None), ("zip_line", None, None))]
    assert value(spark, *kinds) == (None, "CogRailway", None, "GoodsLift")
    tags = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv))
    areas = [tags(aeroway="aerodrome", iata="BRN"), tags(aeroway="aerodrome"), tags(boundary="protected_area", name="Wildruhezone X"), tags(leisure="nature_reserve"), tags(landuse="farm")]
    assert value(spark, *(classify.restriction_kind(t) for t in areas)) == ("Airport", None, "Wildruhezone", "NatureReserve", "Other")
    assert classify.sac_regex(5) == "^(demanding_alpine_hiking|difficult_alpine_hiking)$"


def test_overlay(spark):
    pixels = spark.createDataFrame([(1, 12.0, 0.0, 10.0), (1, 0.0, 0.0, 20.0), (2, 1.0, 0.0, 40.0)], "tile int, e double, n double, z double")
    got = {(r["row"], r["col"]): r["z"] for r in raster.overlay(pixels, Grid(3, 3), 2.0).collect()}
    assert got == {(0, 0): (15.0 + 40.0) / 2, (0, 1): 10.0}


def test_raster_files(spark, tmp_path):
    grid, heights = Grid(3, 4, 25.0, 1.0, 2.0), np.arange(12, dtype=np.float32).reshape(3, 4)
    heights[1, 2] = np.nan
    (tmp_path / "a.bin").write_bytes(raster_file.encode(grid, (0, 0, 1, 1), heights))
    dem = raster_file.read_raster(spark, str(tmp_path / "a.bin"))
    assert {(r["row"], r["col"]): r["z"] for r in dem.collect()}[1, 2] is None and dem.count() == 12
    raster_file.write_raster(dem, grid, (0, 0, 1, 1), str(tmp_path / "b.bin"))
    assert (tmp_path / "b.bin").read_bytes() == (tmp_path / "a.bin").read_bytes()
    for bad in (b"NOPE", (2).to_bytes(4, "little")):
        raw = bytearray((tmp_path / "a.bin").read_bytes())
        raw[0 if bad == b"NOPE" else 4 :][: len(bad)] = bad
        raw[(at := 0 if bad == b"NOPE" else 4) : at + 4] = bad
        with pytest.raises(ValueError):
            raster_file.header(bytes(raw))


def test_feeds(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([{"kind": "Crane", "geom": {"type": "Point", "coords": [1, 2, 3]}}, {"kind": "Catenary", "geom": {"type": "Line", "coords": [[1, 2, 3], [4, 5, 6]]}}]))
    rows = feeds.obstacle_points(feeds.read_json(spark, str(tmp_path / "o.json"), feeds.OBSTACLES)).collect()
    assert [len(r["points"]) for r in rows] == [1, 2]
    assert feeds.load_or_empty(spark, str(tmp_path / "none.json"), feeds.LIFTS).count() == 0
    item = lambda year, asset: {"id": f"swissalti3d_{year}_2600-1200", "assets": {asset: {"href": f"http://x/{year}"}}}
    (tmp_path / "s.json").write_text(json.dumps({"features": [item(2019, "a_2_2056_5728.xyz.zip"), item(2022, "b_2_2056_5728.xyz.zip"), {"id": "other", "assets": {}}], "links": []}))
    assert [tuple(r) for r in feeds.tiles(spark, str(tmp_path / "s.json")).collect()] == [(2022, 2600, 1200, "http://x/2022")]
    with zipfile.ZipFile(tmp_path / "t_2600-1200_x.zip", "w") as z:
        z.writestr("a.xyz", "E N Z\n2600000 1200000 5\n2600002 1200998 7\n2600002 1200998 8\n2700000 1200000 1\n")
    pixels = feeds.read_xyz(spark, str(tmp_path / "t_2600-1200_x.zip")).collect()
    assert sorted((r["prow"], r["pcol"], r["z"]) for r in pixels) == [(0, 1, 8.0), (499, 0, 5.0)]


def test_pictures(spark):
    dem = raster.terrain(grid_of(spark, 6, F.when(F.col("col") > 0, F.col("col") * 20.0)), CELL)
    pixels = {(r["row"], r["col"]): r for r in render.hillshade_pixels(dem).collect()}
    assert pixels[0, 0]["a"] == 0 and pixels[2, 3]["a"] == 255
    assert render.png(6, 6, render.hillshade_pixels(dem)).startswith(b"\x89PNG")
