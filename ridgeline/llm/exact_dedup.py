"""Exact duplicates by a log-structured merge index of digests, with DataFrame functions only.

* Memtable and flush: each scan task digests its rows, sorts them and writes one run (a Parquet file with a Bloom
  filter on the digest).  Nothing is shuffled and texts aren't carried.
* Compaction merges the runs: per digest the number of rows and the least and greatest identifier.  A digest met once
  needs nothing more.
* Filter: digests met more than once set bits in bitmap blocks of a fixed total size.  Only rows that hit the filter
  go on with their text.
* Verification: hits are grouped by digest *and* text, so equality is that of the bytes; a task sends one row for
  all its copies of a text, and a group of any size stays small.

Defined results: a NULL text equals an empty one; rows that repeat both identifier and text all name that identifier
and are all kept by ``kept`` (``drop_copies`` leaves one of them); a NULL identifier is less than any other, and stays
only where a group has no other; texts of any length are handled alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.skew import lookup_join
from ridgeline.scratch import fresh_path, materialise

#: Bits of the filter: 1024 blocks of 4 KB, whatever the size of the input. Beyond some ten million repeated texts it
#: lets more rows through, which costs time only.
FILTER_BLOCKS = 1024
_BLOCK_BITS = 32_768


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def write_runs(docs: DataFrame, path: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Add a sorted run of digests for each input split to the index at ``path``."""
    text = F.coalesce("text", F.lit(""))
    runs = docs.select(digest(text).alias("digest"), F.col("doc_id"), F.octet_length(text).cast("long").alias("n_bytes")).sortWithinPartitions("digest", "doc_id")
    runs.write.mode("append").option("parquet.bloom.filter.enabled#digest", "true").parquet(path)


def compact(runs: DataFrame, name: str = "digests") -> DataFrame:
    """Merged runs: per digest its rows, least and greatest identifier."""
    return runs.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("least_id"), F.max("doc_id").alias("greatest_id"))


def lookup(spark: SparkSession, path: str, digests: list[bytes]) -> DataFrame:
    """Rows of the index with one of a few digests; runs whose Bloom filter or range excludes them aren't read."""
    return spark.read.parquet(path).filter(F.col("digest").isin(*[F.lit(x) for x in digests]))


def _place(digest: Column) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(digest), F.lit(FILTER_BLOCKS * _BLOCK_BITS))
    return (at / _BLOCK_BITS).cast("int"), (at % _BLOCK_BITS).cast("int")


def _filtered(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` whose digest may be among ``digests``."""
    block, bit = _place(F.col("digest"))
    bits = digests.select(block.alias("_block"), bit.cast("long").alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_bit / 8) + 1, 1)")), 16, 10).cast("int")
    hit = rows.withColumns({"_block": block, "_bit": bit}).join(F.broadcast(bits), "_block")
    return hit.filter(F.getbit(byte, F.col("_bit") % 8) == 1).drop("_block", "_bit", "_bits")


def equal_texts(docs: DataFrame, digest: Callable[[Column], Column] = sha256, keep: str = "max") -> DataFrame:
    """One row per document: ``doc_id, digest, n_bytes, keep_id, group_size, kept``.

    ``keep`` says whether the greatest or the least identifier of equal texts stays.  ``digest`` may be any function;
    a weak one costs time but changes no group.
    """
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    path = fresh_path(spark, "runs")
    write_runs(docs, path, digest)
    runs = spark.read.parquet(path)
    repeated = materialise(compact(runs).filter("n_rows > 1").sortWithinPartitions("digest"), "repeated")
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    hits = _filtered(docs.select(digest(text).alias("digest"), text.alias("text"), "doc_id"), repeated)
    groups = hits.groupBy("digest", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # texts stay in the table only where a digest stands for more than one
    groups = materialise(groups.filter("group_size > 1").select("digest", "keep_id", "group_size", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32("text").alias("crc")), "groups")
    sizes = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("group_size").alias("n")).join(repeated, "digest", "right")
    clash = sizes.filter(F.coalesce("texts", F.lit(0)) != 1).unionByName(sizes.filter("texts = 1 AND n <> n_rows")).select("digest")
    clash = materialise(clash, "clash")
    single = F.col("keep_id").isNull() & F.col("group_size").isNull()
    found = lookup_join(runs, groups.drop("n_bytes", "crc").join(clash, "digest", "left_anti"), "digest")
    if not clash.isEmpty():  # one digest, several texts: these rows are told apart by their texts
        apart = docs.select(digest(text).alias("digest"), "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).join(clash, "digest", "left_semi")
        own = apart.groupBy("digest", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = apart.join(own, ["digest", "text"]).select("digest", "doc_id", "n_bytes", "keep_id", "group_size")
        found = found.join(clash, "digest", "left_anti").unionByName(apart)
    found = found.withColumns({"keep_id": F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1))})
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest", "n_bytes", "keep_id", "group_size", "kept")


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row for each text, all columns as they are.

    A row with a NULL identifier can't be named and stays only if its text is its own or its group has no identifier;
    of rows that repeat identifier and text, one stays.
    """
    out = materialise(equal_texts(docs, keep=keep), "equal")
    taken = {c.lower() for c in docs.columns}
    own, of, gone_id = (next(x for k in range(len(taken) + 1) if (x := f"{name}{'_' * k}") not in taken) for name in ("_digest", "_of", "_gone"))
    gone = out.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(gone_id), F.col("digest").alias(of))
    mine = docs.withColumn(own, sha256(F.coalesce("text", F.lit(""))))
    left = mine.join(gone, (mine["doc_id"] == gone[gone_id]) & (mine[own] == gone[of]), "left_anti")
    again = out.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1")
    nulls = out.filter("doc_id IS NULL AND keep_id IS NOT NULL").select(F.col("digest").alias(of)).distinct()
    if not nulls.isEmpty():
        left = left.join(nulls, left["doc_id"].isNull() & (left[own] == nulls[of]), "left_anti")
    if not again.isEmpty():
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)
