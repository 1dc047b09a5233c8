"""Queries over the driver's tables, and the same in DuckDB's SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import classify, geo, render, scoring
from ridgeline.operators import discover, raster, reach, spatial, trails
from ridgeline.params import Discovery, Glide, Grid, Scoring, Wind
from ridgeline.plans import rank
from ridgeline.scratch import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CELL = 25.0
DISCOVERY = Discovery(max_roughness_m=12.0)


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem_of(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    z = 1000 + F.col("o_totalprice") / 12000
    z = F.when(F.col("o_orderstatus") != "P", z) if holes else z
    return table(spark, sf_dir, "orders").select(F.expr("cast(o_orderkey div 100 as int)").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"), z.alias("z"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


DEM = "dem AS (SELECT CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col, 1000 + o_totalprice / 12000 AS z FROM orders)"
AROUND = f"""{DEM}, v AS (SELECT *, lag(z) OVER c AS n, lead(z) OVER c AS s FROM dem WINDOW c AS (PARTITION BY col ORDER BY row)),
a AS (SELECT *, lag(z) OVER r AS w, lead(z) OVER r AS e, lag(n) OVER r AS nw, lead(n) OVER r AS ne, lag(s) OVER r AS sw, lead(s) OVER r AS se FROM v WINDOW r AS (PARTITION BY row ORDER BY col)),
g AS (SELECT *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 200.0 AS dx, ((nw + 2 * n + ne) - (sw + 2 * s + se)) / 200.0 AS dn,
      (nw + n + ne + w + z + e + sw + s + se) / 9 AS m, ((ne + e + se) - (nw + w + sw)) / 6 AS b, ((sw + s + se) - (nw + n + ne)) / 6 AS c FROM a),
t AS (SELECT row, col, z, degrees(atan(sqrt(dx * dx + dn * dn))) AS slope,
      CASE WHEN sqrt(dx * dx + dn * dn) >= 1e-6 THEN CASE WHEN degrees(atan2(-dx, -dn)) < 0 THEN degrees(atan2(-dx, -dn)) + 360 ELSE degrees(atan2(-dx, -dn)) END END AS aspect,
      sqrt((power(nw - (m - b - c), 2) + power(n - (m - c), 2) + power(ne - (m + b - c), 2) + power(w - (m - b), 2) + power(z - m, 2) + power(e - (m + b), 2)
            + power(sw - (m - b + c), 2) + power(s - (m + c), 2) + power(se - (m + b + c), 2)) / 9) AS roughness FROM g)"""


@query(f"WITH {AROUND} SELECT row, col, round(slope, 6) AS slope, round(aspect, 6) AS aspect, round(roughness, 6) AS roughness FROM t")
def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(raster.terrain(dem_of(spark, sf_dir), CELL), "slope", "aspect", "roughness").drop("z")


@query(f"WITH {DEM} SELECT round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, count(z) AS n_cells FROM dem")
def elevation_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(raster.elevation_range(dem_of(spark, sf_dir)), "min_z", "max_z")


_LERP = lambda k: " ".join(["CASE"] + [f"WHEN h < {hi} THEN {a[k]} + ({b[k]} - {a[k]}) * ((h - {lo}) / ({hi} - {lo}))" for lo, hi, a, b in render.BANDS[:2]] + [f"ELSE {render.BANDS[2][2][k]} + ({render.BANDS[2][3][k]} - {render.BANDS[2][2][k]}) * ((h - 0.8) / (1.0 - 0.8)) END"])  # noqa: E731, E501
_PIXEL = lambda k: f"CAST(floor(round(least(255.0, greatest(0.0, ({_LERP(k)}) * (0.3 + 0.7 * shade))), 9)) AS INT)"


@query(f"""WITH {AROUND}, x AS (SELECT min(z) AS lo, greatest(max(z) - min(z), 1.0) AS span FROM dem),
p AS (SELECT row, col, least(1.0, greatest(0.0, (z - lo) / span)) AS h, CASE WHEN slope IS NOT NULL AND aspect IS NOT NULL THEN
  greatest(0.0, least(1.0, cos(radians(45)) * cos(radians(slope)) + sin(radians(45)) * sin(radians(slope)) * cos(radians(315 - aspect)))) ELSE cos(radians(45)) END AS shade FROM t, x)
SELECT row, col, {_PIXEL(0)} AS r, {_PIXEL(1)} AS g, {_PIXEL(2)} AS b, 255 AS a FROM p""")
def hillshade_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.hillshade_pixels(raster.terrain(dem_of(spark, sf_dir), CELL))


CANDIDATES = f"""{AROUND}, q AS (SELECT row, col, z, round(slope, 6) AS slope, round(aspect, 6) AS aspect, round(roughness, 6) AS roughness FROM t),
k AS (SELECT *, round(z - 50 * ((slope - 30) / 8) * ((slope - 30) / 8) - 50 * (roughness / 12.0) * (roughness / 12.0), 6) AS score FROM q
      WHERE slope BETWEEN 22 AND 38 AND roughness <= 12 AND aspect BETWEEN 90 AND 270)"""


@query(f"WITH {CANDIDATES} SELECT row, col, slope, aspect, roughness, score FROM k")
def discover_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.candidates(raster.terrain(dem_of(spark, sf_dir), CELL), DISCOVERY).drop("z")


@query()
def nms_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(discover.launches(raster.terrain(dem_of(spark, sf_dir), CELL), CELL, DISCOVERY), "alt_m", "window_lo", "window_hi")


_E, _N = "(2600000 + c_custkey * 13.0)", "(1200000 + c_acctbal * 7.0)"
_LONLAT = """(2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y) * 100 / 36 AS lon,
(16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x) * 100 / 36 AS lat"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (2_600_000 + F.col("c_custkey") * 13.0).alias("e"), (1_200_000 + F.col("c_acctbal") * 7.0).alias("n"))
    lon, lat = geo.lv95_to_wgs84(F.col("e"), F.col("n"))
    return rows.withColumns({"lon": lon, "lat": lat})


@query(f"""WITH a AS (SELECT c_custkey, ({_E} - 2600000) / 1e6 AS y, ({_N} - 1200000) / 1e6 AS x FROM customer), b AS (SELECT c_custkey, {_LONLAT} FROM a),
c AS (SELECT *, (lat * 3600 - 169028.66) / 1e4 AS p, (lon * 3600 - 26782.5) / 1e4 AS q FROM b)
SELECT c_custkey, round(lon, 6) AS lon, round(lat, 6) AS lat, round(2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q, 4) AS e2,
round(1200147.07 + 308807.95 * p + 3745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p, 4) AS n2 FROM c""")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = places(spark, sf_dir)
    e, n = geo.wgs84_to_lv95(F.col("lon"), F.col("lat"))
    return rows.select("c_custkey", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round(e, 4).alias("e2"), F.round(n, 4).alias("n2"))


_NORM = lambda x: f"(({x}) - 360 * floor(({x}) / 360))"


@query(f"""WITH a AS (SELECT event_id, value * 10 AS v, user_id % 360 AS u FROM events),
b AS (SELECT *, {_NORM('v')} AS norm, CASE WHEN {_NORM('v - u')} > 180 THEN {_NORM('v - u')} - 360 ELSE {_NORM('v - u')} END AS diff,
      abs(CASE WHEN {_NORM('v - 180.0')} > 180 THEN {_NORM('v - 180.0')} - 360 ELSE {_NORM('v - 180.0')} END) - 15 AS beyond FROM a)
SELECT event_id, round(norm, 6) AS norm, round(diff, 6) AS diff, norm >= 315 OR norm <= 45 AS north,
round(CASE WHEN beyond <= 0 THEN 1.0 WHEN beyond >= 90 THEN 0.0 ELSE greatest(0.0, cos(radians(beyond))) END, 6) AS factor FROM b""")
def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, u = F.col("value") * 10, F.col("user_id") % 360
    norm = geo.norm_deg(v)
    return table(spark, sf_dir, "events").select("event_id", F.round(norm, 6).alias("norm"), F.round(geo.angle_diff_deg(v, u), 6).alias("diff"), geo.aspect_in_arc(norm, 315, 45).alias("north"), F.round(scoring.wind_factor(v, F.lit(180.0)), 6).alias("factor"))


_HEX = [(1.0, 0.0), (0.5, 0.75), (-0.5, 0.75), (-1.0, 0.0), (-0.5, -0.75), (0.5, -0.75)]
POLYGONS = "poly AS (SELECT n_nationkey AS polygon_id, CASE n_regionkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity, [" + ", ".join(f"{{'x': 7.44 + n_nationkey * 0.01 + {x} * 0.03, 'y': 46.95 + n_nationkey * 0.025 + {y} * 0.04}}" for x, y in _HEX) + "] AS ring FROM nation)"
HITS = f"""{POLYGONS}, a AS (SELECT c_custkey, ({_E} - 2600000) / 1e6 AS y, ({_N} - 1200000) / 1e6 AS x FROM customer), pt AS (SELECT c_custkey AS point_id, round(lon, 6) AS x, round(lat, 6) AS y FROM (SELECT c_custkey, {_LONLAT} FROM a)),
ed AS (SELECT polygon_id, ring[i].x AS x1, ring[i].y AS y1, ring[CASE WHEN i = 1 THEN 6 ELSE i - 1 END].x AS x0, ring[CASE WHEN i = 1 THEN 6 ELSE i - 1 END].y AS y0 FROM poly, range(1, 7) r(i)),
hit AS (SELECT point_id, polygon_id FROM pt, ed WHERE (y1 > y) <> (y0 > y) AND x < (x0 - x1) * ((y - y1) / CASE WHEN y0 = y1 THEN 1 ELSE y0 - y1 END) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct((7.44 + F.col("n_nationkey") * 0.01 + x * 0.03).alias("x"), (46.95 + F.col("n_nationkey") * 0.025 + y * 0.04).alias("y"))
    severity = F.element_at(F.array(*(F.lit(x) for x in ("Critical", "High", "Medium", "Low"))), F.col("n_regionkey") % 4 + 1)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("polygon_id"), severity.alias("severity"), F.array(*(corner(x, y) for x, y in _HEX)).alias("ring"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = places(spark, sf_dir).select(F.col("c_custkey").alias("point_id"), F.round("lon", 6).alias("x"), F.round("lat", 6).alias("y"))
    return spatial.in_polygons(points, polygons(spark, sf_dir), 0.05)


@query(f"WITH {HITS} SELECT * FROM hit")
def pip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


@query(f"WITH {HITS} SELECT c_custkey AS launch_id FROM customer WHERE c_custkey NOT IN (SELECT point_id FROM hit JOIN poly USING (polygon_id) WHERE severity IN ('Critical', 'High'))")
def nofly_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.drop_restricted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("launch_id")), hits(spark, sf_dir), polygons(spark, sf_dir))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).filter("k = 1").select("user_id", "event_type", "event_id")


_PTS = "pt AS (SELECT s_suppkey AS point_id, 2600000 + round(s_acctbal, 0) AS e, 1200000 + s_suppkey * 40.0 AS n FROM supplier), nd AS (SELECT c_custkey AS node, 2600000 + round(c_acctbal, 0) AS e, 1200000 + c_custkey * 3.0 AS n FROM customer)"


@query(f"""WITH {_PTS}, d AS (SELECT point_id, node, (nd.e - pt.e) * (nd.e - pt.e) + (nd.n - pt.n) * (nd.n - pt.n) AS d2 FROM pt, nd WHERE abs(nd.e - pt.e) <= 250 AND abs(nd.n - pt.n) <= 250)
SELECT point_id, node, round(sqrt(d2), 6) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, node) AS k FROM d WHERE d2 <= 62500) WHERE k = 1""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (2_600_000 + F.round("s_acctbal", 0)).alias("e"), (1_200_000 + F.col("s_suppkey") * 40.0).alias("n"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (2_600_000 + F.round("c_acctbal", 0)).alias("e"), (1_200_000 + F.col("c_custkey") * 3.0).alias("n"))
    return r6(spatial.nearest(points, nodes, 250.0), "distance_m")


TRAIL_GRID = Grid(100, 200, 25.0, 2_600_000.0, 1_202_000.0)
TRAILS = f"""{DEM}, vx AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, 2600000 + round(value, 1) * 10 AS e, 1200000 + (event_id % 2000) * 1.0 AS n FROM events),
pl AS (SELECT line, ordinal, e, n, CAST(round(e) AS BIGINT) || ':' || CAST(round(n) AS BIGINT) AS node, coalesce(z, 0) AS z FROM vx LEFT JOIN dem ON row = floor((1202000 - n) / 25 + 0.5) AND col = floor((e - 2600000) / 25 + 0.5) AND col < 200 AND row < 100),
st AS (SELECT *, lead(node) OVER w AS node2, lead(e) OVER w AS e2, lead(n) OVER w AS n2, lead(z) OVER w AS z2 FROM pl WINDOW w AS (PARTITION BY line ORDER BY ordinal)),
sl AS (SELECT *, sqrt(power(e2 - e, 2) + power(n2 - n, 2)) AS length FROM st),
eg AS (SELECT node, node2, length / 4000 AS f, CASE WHEN z2 - z > 0 THEN (z2 - z) / 400 ELSE -(z2 - z) / 600 END AS v FROM sl WHERE node2 IS NOT NULL AND node <> node2 AND length >= 0.5),
tr AS (SELECT node, node2, (greatest(f, v) + least(f, v) / 2) * 3600 AS seconds FROM eg),
edge AS (SELECT node AS src, node2 AS dst, seconds FROM tr UNION ALL SELECT node2, node, seconds FROM tr)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), F.row_number().over(w).alias("ordinal"), (2_600_000 + F.round("value", 1) * 10).alias("e"), (1_200_000 + (F.col("event_id") % 2000) * 1.0).alias("n"))
    return trails.trail_graph(points, dem_of(spark, sf_dir), TRAIL_GRID)


@query(f"WITH {TRAILS} SELECT src, dst, round(seconds, 6) AS seconds FROM edge")
def trail_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(graph(spark, sf_dir)[1], "seconds")


@query()
def trail_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    first = nodes.select(F.min("node").alias("node"), F.lit(0.0).alias("seconds"))
    return r6(trails.project_costs(reach.relax(edges, first), nodes, TRAIL_GRID), "seconds")


@query(f"""WITH RECURSIVE {DEM.replace('1000 + o_totalprice / 12000', "CASE WHEN o_orderstatus <> 'P' THEN 1000 + o_totalprice / 12000 END")},
c AS (SELECT row, col, z, row::BIGINT * 2147483648 + col AS id FROM dem WHERE z IS NOT NULL),
g AS (SELECT *, CASE WHEN coalesce(col - lag(col) OVER (PARTITION BY row ORDER BY col) > 1, true) THEN col END AS f FROM c),
r AS (SELECT row, col, z, row::BIGINT * 2147483648 + max(f) OVER (PARTITION BY row ORDER BY col) AS run FROM g),
l AS (SELECT DISTINCT a.run AS a, b.run AS b FROM r a JOIN r b ON a.col = b.col AND a.row = b.row + 1), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k(node, label) USING KEY (node) AS (SELECT DISTINCT run, run FROM r UNION SELECT e.b, min(k.label) FROM k JOIN e ON e.a = k.node JOIN recurring.k AS o ON o.node = e.b WHERE k.label < o.label GROUP BY e.b),
s AS (SELECT label AS component, count(*) AS cells, min({{'z': z, 'row': row, 'col': col}}) AS low FROM r JOIN k ON run = node GROUP BY label)
SELECT component, cells, low.row AS row, low.col AS col, round(low.z, 6) AS z FROM s WHERE cells >= 20""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(trails.trailheads(trails.raster_components(dem_of(spark, sf_dir, holes=True)), 20), "z")


@query()
def lift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(F.array(F.min("l_partkey"), F.max("l_partkey")).alias("nodes"), F.count(F.lit(1)).alias("n_nodes"))
    return trails.lift_clusters(ways).groupBy("cluster").agg(F.count(F.lit(1)).alias("ways"), F.sum("n_nodes").alias("n_nodes"))


LIFT_WAYS = """w AS (SELECT o_orderkey AS way, CASE left(o_orderpriority, 1) WHEN '1' THEN 'CableCar' WHEN '2' THEN 'Gondola' WHEN '3' THEN 'ChairLift' WHEN '4' THEN 'GoodsLift' END AS kind,
CASE WHEN o_orderkey % 3 = 0 THEN 'line ' || o_custkey END AS name, o_orderkey AS a, o_orderkey + 1000000000 AS b, CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey + 2000000000 ELSE o_orderkey + 1 END AS c FROM orders)"""
LIFT_PLACE = "465e-1 + (node % 1000) * 4e-4 + (node % 7) * 1e-4 AS lat, 7e0 + (node % 777) * 5e-4 AS lon"


@query(f"""WITH {LIFT_WAYS}, k AS (SELECT * FROM w WHERE kind IS NOT NULL),
g AS (SELECT *, CASE WHEN way % 4 = 0 OR coalesce(lag(way) OVER (ORDER BY way), -9) <> way - 1 THEN way END AS f FROM k),
h AS (SELECT *, max(f) OVER (ORDER BY way) AS cluster FROM g),
s AS (SELECT cluster, way, 0 AS o, a AS node FROM h UNION ALL SELECT cluster, way, 1, b FROM h UNION ALL SELECT cluster, way, 2, c FROM h),
l AS (SELECT *, {LIFT_PLACE} FROM s WHERE node % 11 <> 5),
m AS (SELECT *, (lat * 3600 - 169028.66) / 1e4 AS p, (lon * 3600 - 26782.5) / 1e4 AS q FROM l),
x AS (SELECT cluster, way, o, node, lat, lon, 2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q AS e,
1200147.07 + 308807.95 * p + 3745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p AS n FROM m),
z AS (SELECT u.cluster, sum(sqrt((v.e - u.e) ** 2 + (v.n - u.n) ** 2)) AS length_m FROM x u JOIN x v ON u.way = v.way AND v.o = u.o + 1 GROUP BY u.cluster),
pt AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY cluster, node ORDER BY way, o) = 1),
far AS (SELECT i.cluster, i.lat AS lower_lat, i.lon AS lower_lon, j.lat AS upper_lat, j.lon AS upper_lon FROM pt i JOIN pt j ON i.cluster = j.cluster AND (i.way, i.o) < (j.way, j.o)
QUALIFY row_number() OVER (PARTITION BY i.cluster ORDER BY sqrt((i.e - j.e) ** 2 + (i.n - j.n) ** 2) DESC, i.way, i.o, j.way, j.o) = 1),
kd AS (SELECT cluster, kind FROM h GROUP BY cluster, kind QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, kind) = 1),
nm AS (SELECT cluster, min_by(name, way) FILTER (WHERE name IS NOT NULL) AS name FROM h GROUP BY cluster)
SELECT cluster, coalesce(name, kind) AS name, kind, kind <> 'GoodsLift' AS human, round(lower_lat, 6) AS lower_lat, round(lower_lon, 6) AS lower_lon, round(upper_lat, 6) AS upper_lat, round(upper_lon, 6) AS upper_lon,
round(length_m, 6) AS length_m, round(length_m / CASE kind WHEN 'CableCar' THEN 8.0 WHEN 'Gondola' THEN 5.0 WHEN 'ChairLift' THEN 2.5 ELSE 1.0 END + 180, 6) AS travel_seconds
FROM far JOIN z USING (cluster) JOIN kd USING (cluster) JOIN nm USING (cluster) WHERE length_m >= 100""")
def lift_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, first = F.col("o_orderkey"), F.left("o_orderpriority", F.lit(1))
    kind = F.when(first == "1", "CableCar").when(first == "2", "Gondola").when(first == "3", "ChairLift").when(first == "4", "GoodsLift")
    last = F.when(key % 4 == 3, key + 2_000_000_000).otherwise(key + 1)
    name = F.when(key % 3 == 0, F.concat(F.lit("line "), F.col("o_custkey").cast("string")))
    ways = table(spark, sf_dir, "orders").select(key.alias("way"), kind.alias("kind"), name.alias("name"), F.array(key, key + 1_000_000_000, last).alias("nodes"))
    nodes = ways.select(F.explode("nodes").alias("node")).distinct().filter("node % 11 <> 5").selectExpr("node", *LIFT_PLACE.split(", "))
    out = trails.assemble_lifts(ways, nodes)
    ends = [F.round(f"{a}.{b}", 6).alias(f"{a}_{b}") for a in ("lower", "upper") for b in ("lat", "lon")]
    return r6(out, "length_m", "travel_seconds").select("cluster", "name", "kind", "human", *ends, "length_m", "travel_seconds")


@query()
def hike_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderkey % 100 = 50").select(F.expr("cast(o_orderkey div 100 as int)").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"), F.lit(0.0).alias("seconds"))
    return r6(reach.hike_field(dem_of(spark, sf_dir), seeds, CELL), "seconds")


def top_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(discover.launches(raster.terrain(dem_of(spark, sf_dir), CELL), CELL, DISCOVERY), "launches")


@query()
def flood_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top_launches(spark, sf_dir)
    return r6(reach.flood_summary(reach.floods(rows, dem_of(spark, sf_dir), CELL, Glide(wind=Wind())), rows, CELL), "max_distance_m")


@query()
def rank_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem, rows = dem_of(spark, sf_dir), top_launches(spark, sf_dir)
    summary = reach.flood_summary(reach.floods(rows, dem, CELL, Glide()), rows, CELL)
    seeds = dem.filter("col = 50").select("row", "col", F.lit(0.0).alias("seconds"))
    out = rank.rank_launches(rows, summary, reach.hike_field(dem, seeds, CELL), Grid(1_000_000, 100, CELL, 2_600_000.0, 1_200_000.0))
    return r6(out, *(c for c, kind in out.dtypes if kind == "double"))


@query("""WITH a AS (SELECT event_id, value % 40 AS kmh, value * 10 AS dir, event_id % 7 AS h, (event_id % 50) * 100.0 AS dist FROM events),
b AS (SELECT *, abs(CASE WHEN (dir - 180.0) - 360 * floor((dir - 180.0) / 360) > 180 THEN (dir - 180.0) - 360 * floor((dir - 180.0) / 360) - 360 ELSE (dir - 180.0) - 360 * floor((dir - 180.0) / 360) END) - 15 AS beyond FROM a)
SELECT event_id, round(CASE WHEN h = 0 THEN 0 ELSE dist / greatest(h * 600.0, 1.0) * CASE WHEN beyond <= 0 THEN 1.0 WHEN beyond >= 90 THEN 0.0 ELSE greatest(0.0, cos(radians(beyond))) END END, 6) AS score FROM b""")
def wind_factor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("event_id") % 7
    factor = scoring.wind_factor(F.lit(180.0), F.col("value") * 10)
    score = scoring.launch_score((F.col("event_id") % 50) * 100.0, F.lit(0.0), F.when(h == 0, float("inf")).otherwise(h * 600.0), factor, Scoring())
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))")
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.pareto(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("""SELECT gr, dir, kmh, count(*) AS n FROM (SELECT CAST(round(least(greatest(value / 4, 2.0), 20.0) * 2) AS INT) AS gr,
CAST(CASE WHEN value % 40 > 0.5 THEN floor((value * 10 - 360 * floor(value * 10 / 360)) / 10) * 10 ELSE -1 END AS INT) AS dir, CAST(CASE WHEN value % 40 > 0.5 THEN floor((value % 40) / 2) * 2 ELSE -1 END AS INT) AS kmh FROM events) GROUP BY ALL""")
def bucket_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    gr, direction, kmh = scoring.bucket(F.col("value") / 4, F.col("value") * 10, F.col("value") % 40)
    return table(spark, sf_dir, "events").groupBy(gr.alias("gr"), direction.alias("dir"), kmh.alias("kmh")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DEM}, p AS (SELECT row // 500 AS tile, col * 2.0 AS e, -row * 2.0 AS n, z FROM dem),
x AS (SELECT *, unnest(range(CAST(floor((e - 1) / 25 + 0.5) AS BIGINT), CAST(ceil((e + 1) / 25 + 0.5) AS BIGINT))) AS col FROM p),
y AS (SELECT *, unnest(range(CAST(floor((-n - 1) / 25 + 0.5) AS BIGINT), CAST(ceil((-n + 1) / 25 + 0.5) AS BIGINT))) AS row FROM x),
m AS (SELECT row, col, tile, avg(z) AS z FROM y WHERE row >= 0 AND col >= 0 AND col < 1000 AND row < 100000 GROUP BY ALL),
l AS (SELECT row, col, list(z ORDER BY tile) AS zs FROM m GROUP BY ALL)
SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(list_reduce(zs, lambda a, b: (a + b) / 2), 6) AS z FROM l""")
def tile_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = dem_of(spark, sf_dir).select(F.expr("row div 500").alias("tile"), (F.col("col") * 2.0).alias("e"), (-F.col("row") * 2.0).alias("n"), "z")
    return r6(raster.overlay(pixels, Grid(100_000, 1000, 25.0), 2.0), "z")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Funicular' WHEN 1 THEN 'CogRailway' WHEN 2 THEN NULL WHEN 3 THEN 'Gondola' ELSE 'GoodsLift' END AS kind,
CASE p_size % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'T4' WHEN 2 THEN 'T6' END AS sac, CASE p_size % 3 WHEN 0 THEN 'WindTurbine' WHEN 1 THEN 'Crane' ELSE 'Other' END AS obstacle,
round(p_retailprice / 5.0 + 180, 6) AS gondola_s FROM part""")
def feature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    way = F.when(s % 5 == 2, "drag_lift").when(s % 5 == 3, "mixed_lift").when(s % 5 == 4, "zip_line")
    rail = F.when(s % 5 == 0, "funicular").when(s % 5 == 1, "narrow_gauge").otherwise("funicular")
    sac = F.when(s % 4 == 0, "hiking").when(s % 4 == 1, "T4").when(s % 4 == 2, "difficult_alpine_hiking").otherwise("stroll")
    name = F.when(s % 3 == 0, "WINDTURBINE").when(s % 3 == 1, "CRANE").otherwise("KITE")
    return table(spark, sf_dir, "part").select("p_partkey", classify.lift_kind(way, rail, F.lit("yes")).alias("kind"), classify.sac_of(sac).alias("sac"), classify.obstacle_kind(name).alias("obstacle"), F.round(classify.lift_seconds(F.lit("Gondola"), F.col("p_retailprice")), 6).alias("gondola_s"))


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::BIGINT AS large FROM events GROUP BY event_type ORDER BY event_type")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("large")).orderBy("event_type")


@query("""SELECT row, col, round(min(seconds), 6) AS seconds FROM (SELECT c_custkey // 30 AS row, c_custkey % 30 AS col, 0.0 AS seconds FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT s_suppkey % 20, s_suppkey % 30, s_acctbal FROM supplier UNION ALL SELECT o_orderkey % 50, o_orderkey % 30, o_totalprice / 100 FROM orders) GROUP BY row, col""")
def seed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.expr("c_custkey div 30").alias("row"), F.expr("c_custkey % 30").alias("col"), F.lit(0.0).alias("seconds"))
    b = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey % 20").alias("row"), F.expr("s_suppkey % 30").alias("col"), F.col("s_acctbal").alias("seconds"))
    c = table(spark, sf_dir, "orders").select(F.expr("o_orderkey % 50").alias("row"), F.expr("o_orderkey % 30").alias("col"), (F.col("o_totalprice") / 100).alias("seconds"))
    return r6(a.unionByName(b).unionByName(c).groupBy("row", "col").agg(F.min("seconds").alias("seconds")), "seconds")


@query(f"WITH {DEM}, h AS (SELECT row, col, z, lead(z) OVER (PARTITION BY row ORDER BY col) AS z2 FROM dem) SELECT row, col, round(25.0 / (greatest(6 * exp(-3.5 * abs((z2 - z) / 25.0 + 0.05)), 0.05) / 3.6) * 1.2, 6) AS seconds FROM h WHERE z2 IS NOT NULL")
def hike_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("row").orderBy("col")
    steps = dem_of(spark, sf_dir).withColumn("z2", F.lead("z").over(w)).filter("z2 IS NOT NULL")
    return steps.select("row", "col", F.round(scoring.edge_seconds(F.col("z"), F.col("z2"), F.lit(25.0), 1.2), 6).alias("seconds"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked launches of the table's raster."""
    return rank_launches(spark, sf_dir)
