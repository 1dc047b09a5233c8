"""The binary raster format: a header of 68 bytes, then heights row by row, NaN where there is none."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ridgeline.params import Grid

# Fixed values of the format.
MAGIC, VERSION = b"HFLY", 1
_HEADER = "<4sIddfIIdddd"
_SIZE = struct.calcsize(_HEADER)


def header(data: bytes) -> tuple[Grid, tuple[float, float, float, float]]:
    magic, version, e, n, cell, rows, cols, *box = struct.unpack_from(_HEADER, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a raster of version {VERSION}: {magic!r}, {version}")
    return Grid(rows, cols, cell, e, n), tuple(box)


def encode(grid: Grid, box: tuple[float, float, float, float], heights: np.ndarray) -> bytes:
    return struct.pack(_HEADER, MAGIC, VERSION, grid.origin_e, grid.origin_n, grid.cell_m, grid.rows, grid.cols, *box) + heights.astype("<f4").tobytes()


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """``path, row, col, z`` of raster files; NaN and infinities become NULL. One file is one record of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                raw = data.as_py()
                grid, _ = header(raw)
                z = np.frombuffer(raw, "<f4", grid.rows * grid.cols, _SIZE)
                for at in range(0, grid.rows, band := max(1, 1_000_000 // max(1, grid.cols))):
                    part = z[at * grid.cols : (at + band) * grid.cols].astype(np.float64)
                    cells = np.arange(at * grid.cols, at * grid.cols + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array((cells // grid.cols).astype(np.int32)), pa.array((cells % grid.cols).astype(np.int32)), pa.array(part, mask=~np.isfinite(part))], names=["path", "row", "col", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row int, col int, z double")


def write_raster(dem: DataFrame, grid: Grid, box: tuple[float, float, float, float], path: str) -> None:
    """One file, by the driver: the raster is held there whole, as the format demands, and partitions come one at a time."""
    heights = np.full((grid.rows, grid.cols), np.nan, np.float32)
    for r in dem.toLocalIterator():
        if r["z"] is not None:
            heights[r["row"], r["col"]] = r["z"]
    with open(path, "wb") as out:
        out.write(encode(grid, box, heights))
