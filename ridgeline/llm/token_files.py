"""Token ids as Parquet files: one row per document, ids as a list column, readable by column, page and document.

Rows lie in ascending ``doc_id`` order across and within files (NULL first; rows that tie are ordered by text), so
row groups and pages have narrow ``doc_id`` ranges and their statistics and page indexes skip what a read doesn't
need.  The ids are dictionary encoded (about 16 bits an id before compression) or delta encoded.

Defined results: a NULL text counts as empty and gives the end id alone; a repeated row gives a row each time; very
long texts make one row; an empty table makes files without rows; of other columns only those named as metadata are
kept, under their own names, or with underscores after them where the files' own columns have the name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.encoding import encoder

#: ids sent to Spark at a time.
BATCH_IDS = 2_000_000


def _lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in encoded)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(encoded))]))


#: Columns of the files that aren't metadata, and those made in writing and reading.
OWN_COLUMNS = frozenset({"doc_id", "part", "start_in_part", "n_tokens", "ids", "start", "_before", "_text_"})


def metadata_names(metadata: tuple[str, ...]) -> dict[str, str]:
    """The files' names for metadata columns."""
    out: dict[str, str] = {}
    for c in metadata:
        name = c
        while name.lower() in OWN_COLUMNS | {x.lower() for x in out.values()}:
            name += "_"
        out[c] = name
    return out


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, metadata: tuple[str, ...] = (), encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, compression: str = "zstd"
) -> None:
    """Encode ``docs(doc_id, text)`` and write the files.

    Texts are dealt by ``doc_id`` range and sorted, then encoded where they lie; each task adds up its own ids, so
    no pass over the ids is needed for positions.  The write commits by task, so a lost executor repeats its tasks only.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    tail = "part int, start_in_part long, n_tokens long, ids array<int>"
    named = metadata_names(metadata)
    docs = docs.select("doc_id", *(F.col(f"`{c}`").alias(n) for c, n in named.items()), F.col("text").alias("_text_"))
    columns = ["doc_id", *named.values()]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", " + tail
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            at, ids = 0, tool.encode_column(batch.column("_text_"))
            while at < batch.num_rows:
                encoded, size, first = [], 0, at
                while at < batch.num_rows and size < 4 * BATCH_IDS:
                    encoded.append(next(ids) + end)
                    size, at = size + len(encoded[-1]), at + 1
                n = np.asarray([len(x) // 4 for x in encoded], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[first:at] for c in columns), pa.array(np.full(len(n), part), pa.int32()), pa.array(starts), pa.array(n), _lists(encoded)],
                    names=[*columns, "part", "start_in_part", "n_tokens", "ids"],
                )

    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text_")
    options = {
        "compression": compression, "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }
    dealt.mapInArrow(encode, schema).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids before the document.

    Selecting a column reads that column only, and a filter on ``doc_id`` skips row groups and pages.  The totals of
    the parts (as many rows as the write had tasks) are broadcast.
    """
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("_before") + F.col("start_in_part")).drop("_before", "part", "start_in_part")


def digest_ids(rows: DataFrame) -> DataFrame:
    """``ids_crc32``, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers, in place of ``ids``."""
    keep = [c for c in rows.columns if c != "ids"]
    kinds = dict(rows.dtypes)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    return rows.select(*keep, "ids").mapInArrow(digest, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids_crc32 long")
