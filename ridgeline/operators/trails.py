"""Trail graphs from polylines, lifts from ways, and components of rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.classify import human_transport, lift_seconds
from ridgeline.functions.geo import cell_of, wgs84_to_lv95
from ridgeline.functions.scoring import signpost_seconds
from ridgeline.operators.components import connected_components
from ridgeline.operators.skew import lookup_join
from ridgeline.params import Grid
from ridgeline.scratch import materialise

#: Points of a lift looked at together; more are thinned to their hulls part by part.
HULL_POINTS = 20_000
#: Points of a lift all of whose pairs are compared, those of many lifts at a time; larger lifts are thinned to their hulls first.
PAIRED = 200
#: Pairs of points compared at a time, about.
PAIRS = 1_000_000


def vertices_of(polylines: DataFrame) -> DataFrame:
    """``line, ordinal, e, n`` from ``line, points array<struct<e,n>>``."""
    return polylines.select("line", F.posexplode("points").alias("ordinal", "p")).select("line", "ordinal", "p.e", "p.n")


def trail_graph(vertices: DataFrame, dem: DataFrame, grid: Grid, strict_reference: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, e, n)`` and edges ``(src, dst, seconds)``, both directions at the cost of the drawn one.

    Vertices that round to one metre are one node, placed by the first.  A vertex without a height counts as 0 m;
    ``strict_reference=False`` leaves its edges out instead.  A node is named by its rounded place, so no global
    numbering is needed.
    """
    key = F.concat_ws(":", F.round("e").cast("long"), F.round("n").cast("long"))
    row, col = cell_of(F.col("e"), F.col("n"), grid)
    placed = vertices.withColumns({"node": key, "row": row, "col": col}).join(dem.select("row", "col", "z"), ["row", "col"], "left")
    placed = placed.withColumn("z", F.coalesce("z", F.lit(0.0))) if strict_reference else placed
    nodes = placed.groupBy("node").agg(F.min_by(F.struct("e", "n"), F.struct("line", "ordinal")).alias("p")).select("node", "p.*")
    w = Window.partitionBy("line").orderBy("ordinal")
    steps = placed.select("node", "e", "n", "z", *(F.lead(c).over(w).alias(f"{c}2") for c in ("node", "e", "n", "z")))
    length = F.sqrt((F.col("e2") - F.col("e")) ** 2 + (F.col("n2") - F.col("n")) ** 2)
    steps = steps.withColumn("length", length).filter("node2 IS NOT NULL AND node <> node2 AND length >= 0.5 AND z IS NOT NULL AND z2 IS NOT NULL")
    steps = steps.select("node", "node2", signpost_seconds(F.col("length"), F.col("z2") - F.col("z")).alias("seconds"))
    ends = lambda a, b: steps.select(F.col(a).alias("src"), F.col(b).alias("dst"), "seconds")
    return nodes, ends("node", "node2").unionByName(ends("node2", "node"))


def project_costs(costs: DataFrame, nodes: DataFrame, grid: Grid) -> DataFrame:
    """Least cost of the nodes in each cell: ``row, col, seconds``."""
    row, col = cell_of(F.col("e"), F.col("n"), grid)
    return costs.join(nodes, "node").select(row.alias("row"), col.alias("col"), "seconds").filter("row IS NOT NULL AND col IS NOT NULL").groupBy("row", "col").agg(F.min("seconds").alias("seconds"))


def raster_components(dem: DataFrame) -> DataFrame:
    """``row, col, z, component`` of cells with heights, joined over their sides.

    Runs within rows come first (a window), so the graph has as many nodes as runs; a component is named by the least
    ``row * 2**31 + col`` of its runs.
    """
    w = Window.partitionBy("row").orderBy("col")
    cells = dem.filter("z IS NOT NULL").withColumn("gap", F.coalesce(F.col("col") - F.lag("col").over(w) > 1, F.lit(True)))
    cells = cells.withColumn("first", F.max(F.when(F.col("gap"), F.col("col"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.withColumn("run", F.col("row").cast("long") * (1 << 31) + F.col("first")).drop("gap", "first")
    below = cells.select((F.col("row") - 1).alias("row"), "col", F.col("run").alias("other"))
    found = connected_components(cells.join(below, ["row", "col"]).select("run", "other").distinct())
    return cells.join(found, F.col("run") == F.col("node"), "left").select("row", "col", "z", F.coalesce("component", "run").alias("component"))


def trailheads(components: DataFrame, min_cells: int = 200) -> DataFrame:
    """The lowest cell (ties: row, column) of each component of at least so many cells."""
    low = components.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.min(F.struct("z", "row", "col")).alias("low"))
    return low.filter(F.col("cells") >= min_cells).select("component", "cells", "low.row", "low.col", "low.z")


def lift_clusters(ways: DataFrame) -> DataFrame:
    """``way, cluster`` from ``ways(way, nodes)``: ways that share an end node are one lift, named by its least way."""
    ends = ways.select("way", F.explode(F.array_distinct(F.array(F.element_at("nodes", 1), F.element_at("nodes", -1)))).alias("node"))
    hub = ends.groupBy("node").agg(F.min("way").alias("least"))
    found = connected_components(ends.join(hub, "node").select("way", "least"))
    return ways.join(found, F.col("way") == F.col("node"), "left").select(ways["*"], F.coalesce("component", "way").alias("cluster"))


def hull(points: pd.DataFrame) -> pd.DataFrame:
    """The corners of the convex hull of ``e, n``; of points in one place the first by ``way, ordinal``."""
    points = points.sort_values(["e", "n", "way", "ordinal"]).drop_duplicates(["e", "n"])
    e, n = points["e"].to_numpy(), points["n"].to_numpy()

    def chain(order: range) -> list[int]:
        out: list[int] = []
        for k in order:
            while len(out) > 1 and (e[out[-1]] - e[out[-2]]) * (n[k] - n[out[-2]]) <= (n[out[-1]] - n[out[-2]]) * (e[k] - e[out[-2]]):
                out.pop()
            out.append(k)
        return out

    return points.iloc[sorted({*chain(range(len(e))), *chain(range(len(e) - 1, -1, -1))})]


def farthest(points: pd.DataFrame) -> pd.DataFrame:
    """The two points of a lift that lie farthest apart, in order of ``way, ordinal``; of equal pairs the first."""
    points = hull(points).sort_values(["way", "ordinal"], ignore_index=True)
    e, n = points["e"].to_numpy(), points["n"].to_numpy()
    best = (0, 0, 0.0)
    for i in range(len(e) - 1):
        d = np.sqrt((e[i + 1 :] - e[i]) ** 2 + (n[i + 1 :] - n[i]) ** 2)
        if d.max() > best[2]:
            best = (i, i + 1 + int(d.argmax()), float(d.max()))
    a, b = (points.loc[k, ["lat", "lon", "e", "n"]].to_dict() for k in best[:2])
    return pd.DataFrame({"cluster": points["cluster"][:1], "lower": [a], "upper": [b]})


def farthest_pairs(sizes: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two points of each lift that lie farthest apart, of equal pairs the first; lifts have ``sizes`` points, 1 at least, one lift after another."""
    base = np.cumsum(sizes) - sizes
    lower, upper = base.copy(), base.copy()
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        lifts = np.flatnonzero(sizes == size)
        for some in np.array_split(lifts, -(-len(lifts) * len(i) // PAIRS)):
            at = base[some][:, None]
            d = np.nan_to_num(np.sqrt((e[at + j] - e[at + i]) ** 2 + (n[at + j] - n[at + i]) ** 2))
            best = d.argmax(axis=1)
            apart = d[np.arange(len(some)), best] > 0
            lower[some] += np.where(apart, i[best], 0)
            upper[some] += np.where(apart, j[best], 0)
    return lower, upper


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cluster, lower, upper`` from ``cluster, points``."""
    for batch in batches:
        lists = batch.column(1)
        points = lists.flatten()
        places = [points.field(name) for name in ("lat", "lon", "e", "n")]
        found = farthest_pairs(np.diff(lists.offsets.to_numpy()), *(x.to_numpy() for x in places[2:]))
        ends = [pa.StructArray.from_arrays([x.take(pa.array(at)) for x in places], names=["lat", "lon", "e", "n"]) for at in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), *ends], names=["cluster", "lower", "upper"])


def assemble_lifts(ways: DataFrame, nodes: DataFrame, min_length_m: float = 100.0) -> DataFrame:
    """``cluster, name, kind, human, lower, upper, length_m, travel_seconds`` from ``ways(way, kind, name, nodes)`` and ``nodes(node, lat, lon)``.

    Ways of no kind or with fewer than two nodes are left out; those that share an end node are one lift, of the most
    frequent kind (ties: by name), called by its first way's name that there is, else by its kind.  Nodes without a
    place are skipped, with the steps to and from them.  The ends are the two places farthest apart, not ordered by
    height.  Lifts with fewer than two placed nodes or shorter than ``min_length_m`` are left out.  Of lifts of more than
    ``PAIRED`` points only hulls of parts of them meet in one task.
    """
    end = "struct<lat:double,lon:double,e:double,n:double>"
    ways = materialise(lift_clusters(ways.filter("kind IS NOT NULL AND size(nodes) >= 2")).select("cluster", "way", "kind", "name", "nodes"), "ways")
    e, n = wgs84_to_lv95(F.col("lon"), F.col("lat"))
    places = nodes.filter("lat IS NOT NULL AND lon IS NOT NULL").dropDuplicates(["node"]).select("node", F.struct("lat", "lon", e.alias("e"), n.alias("n")).alias("p"))
    kinds = ways.groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.min(F.struct(-F.col("n"), "kind"))["kind"].alias("kind"))
    names = ways.groupBy("cluster").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("way"))).alias("name"))

    steps = ways.select("cluster", "way", F.posexplode("nodes").alias("ordinal", "node"))
    placed = materialise(lookup_join(materialise(steps, "steps"), places, "node", "left"), "placed")
    w = Window.partitionBy("cluster", "way").orderBy("ordinal")
    step = F.sqrt((F.lead("p.e").over(w) - F.col("p.e")) ** 2 + (F.lead("p.n").over(w) - F.col("p.n")) ** 2)
    lengths = placed.select("cluster", step.alias("step")).groupBy("cluster").agg(F.sum("step").alias("length_m"))

    points = placed.filter("p IS NOT NULL").groupBy("cluster", "node").agg(F.min(F.struct("way", "ordinal")).alias("at"), F.first("p").alias("p"))
    points = materialise(points.select("cluster", "node", "at.way", "at.ordinal", "p.*"), "points")
    large = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") > PAIRED)
    sized = lookup_join(points, materialise(large, "large"), "cluster", "left")
    listed = sized.filter("points IS NULL").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("way", "ordinal", "lat", "lon", "e", "n"))).alias("points"))
    schema = f"cluster {dict(ways.dtypes)['cluster']}, lower {end}, upper {end}"
    small = listed.filter("size(points) >= 2").mapInArrow(_ends, schema)
    salted = sized.filter("points IS NOT NULL")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("points") / HULL_POINTS)).cast("int")
    corners = salted.withColumn("part", part).drop("points", "node")
    corners = corners.groupBy("cluster", "part").applyInPandas(hull, corners.schema)
    ends = small.unionByName(corners.groupBy("cluster").applyInPandas(farthest, schema))
    out = ends.join(lengths.filter(F.col("length_m") >= min_length_m), "cluster").join(kinds, "cluster").join(names, "cluster")
    return out.select("cluster", F.coalesce("name", "kind").alias("name"), "kind", human_transport(F.col("kind")).alias("human"), "lower", "upper", "length_m", lift_seconds(F.col("kind"), F.col("length_m")).alias("travel_seconds"))
