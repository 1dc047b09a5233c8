"""Intermediate tables in the folder that driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``.  Only where that setting is absent (single-process
tests) a local folder is made and set.  A written table cuts the lineage: a lost executor costs a re-read, not a
re-run of everything before it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_PATH = "_scratch_path"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one of its own only if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="ridgeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for one table that nothing else uses; it is deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(remove_all)
    _MADE.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing that is still to run reads them; others are left alone.

    The driver's JVM is asked to collect garbage, upon which Spark deletes the shuffle files of ended jobs too.
    """
    for df in tables:
        if path := df.__dict__.get(_PATH):
            _delete(df.sparkSession, path)
            with contextlib.suppress(ValueError):
                _MADE.remove((df.sparkSession, path))
    if tables:
        collect_garbage(tables[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    """Ask the driver's JVM for it, upon which Spark deletes the shuffle files of ended jobs."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_all() -> None:
    """Delete the tables made by this process."""
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):
            _delete(spark, path)
