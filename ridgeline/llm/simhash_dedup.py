"""Near-duplicates by SimHash fingerprints, found by anchor-point covering.

The 64 bits are cut into parts; if two fingerprints differ in at most ``threshold`` bits, they differ in at most
``threshold // parts`` bits of some part.  In each part the anchors are the words of a covering code: a Hamming code on
``2**m - 1`` bits beside all words on the bits left over, so every value is within distance 1 of an anchor.
A fingerprint is copied to every anchor within ``1 + threshold // parts``; then two linked fingerprints meet at an
anchor next to either.  Which anchors those are is read off a table by syndrome.  At an anchor, the fingerprints next
to it are compared with all that were copied there, and only as many links go on as it takes to connect them.
Nothing is missed at any size; finer parts are taken where there are more fingerprints (``choose_code``).

Equal fingerprints are one node, so copies of a text add nothing.  Links become classes by connected components.

Defined results: a NULL text counts as empty and an empty one has fingerprint zero, which is linked like any other;
repeated rows get equal answers; a NULL identifier never is a class's identifier unless the class has no other, when
that is NULL; texts of any length are handled whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.workers import tidy
from ridgeline.operators.components import connected_components
from ridgeline.operators.skew import lookup_join
from ridgeline.scratch import materialise

BITS = 64
#: From so many fingerprints on, two parts are cheaper than three.
TWO_PARTS_FROM = 50_000_000
#: Pairs compared at a time by one task.
PAIRS = 2_000_000


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """SimHash of a text's shingles of ``width`` words, each hashed by XXH64."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = np.cumsum([0, *(len(x) + 1 for x in words)]).tolist()
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    ends = [*starts[width:-1], len(line) + 1] if len(words) >= width else [len(line) + 1]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(line[a : b - 1], seed) for a, b in zip(starts[at : min(n, at + (1 << 15))], ends[at : at + (1 << 15)])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(x.as_py() or "", width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, bits long")


@dataclass(frozen=True)
class Part:
    """Bits ``shift`` to ``shift + width - 1``; anchors are code words within ``reach`` of a value."""

    shift: int
    width: int
    m: int  # the Hamming code's check bits
    reach: int

    def syndromes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for k in range(2**self.m - 1):
            out ^= ((values >> np.uint64(k)) & np.uint64(1)).astype(np.int64) * (k + 1)
        return out

    def patterns(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By syndrome: the error words that lead from a value to its anchors, and whether each has weight 0 or 1."""
        found: list[list[tuple[int, int]]] = [[] for _ in range(2**self.m)]
        for weight in range(self.reach + 1):
            for bits in combinations(range(self.width), weight):
                s = 0
                for b in bits:
                    s ^= b + 1 if b < 2**self.m - 1 else 0
                found[s].append((sum(1 << b for b in bits), weight))
        return [(np.array([e for e, _ in x], np.uint64), np.array([w <= 1 for _, w in x])) for x in found]


def choose_code(fingerprints: int, threshold: int) -> list[Part]:
    """Anchors for so many distinct fingerprints; any choice finds all links."""
    if fingerprints >= TWO_PARTS_FROM:
        widths = [(32, 5)] * 2
    else:
        widths = [(22, 4), (21, 4), (21, 4)]
    reach = 1 + threshold // len(widths)
    shifts = np.cumsum([0, *(w for w, _ in widths)])
    return [Part(int(s), w, m, reach) for s, (w, m) in zip(shifts, widths)]


def copies(values: np.ndarray, code: list[Part]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, fingerprint, is the anchor next to it) for each fingerprint and anchor in reach."""
    for number, part in enumerate(code):
        own = (values >> np.uint64(part.shift)) & np.uint64((1 << part.width) - 1)
        syndrome = part.syndromes(own)
        for s, (errors, near) in enumerate(part.patterns()):
            at = np.flatnonzero(syndrome == s)
            if len(at) and len(errors):
                cells = (own[at, None] ^ errors[None, :]) | np.uint64(number << 56)
                yield cells.ravel(), np.repeat(values[at], len(errors)), np.tile(near, len(at))


def _ties(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 the least node connected to each."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
    return label


def compare(cells: np.ndarray, values: np.ndarray, near: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each cell, all that differ in at most ``threshold`` bits; ``cells`` is sorted."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(cells)])
    group = np.repeat(np.arange(len(starts)), sizes)
    home = np.flatnonzero(near & (sizes[group] > 1))
    label = np.arange(len(cells))
    work = np.cumsum(sizes[group[home]])
    at = 0
    while at < len(home):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, "right")))
        some = home[at:to]
        m = sizes[group[some]]
        left = np.repeat(some, m)
        right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[group[some]], m)
        linked = (np.bitwise_count(values[left] ^ values[right]) <= threshold) & (label[left] != label[right])
        if linked.any():
            label = _ties(len(cells), np.r_[left[linked], np.arange(len(cells))], np.r_[right[linked], label])
        at = to
    moved = np.flatnonzero(label != np.arange(len(cells)))
    pairs = np.unique(np.stack([values[moved], values[label[moved]]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame, threshold: int, count: int) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``bits`` which a chain of links connects."""
    code = choose_code(count, threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 4096):
                for cells, own, near in copies(values[at : at + 4096], code):
                    yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(own.view(np.int64)), pa.array(near)], names=["cell", "bits", "near"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            kept = [np.concatenate(x) for x in zip(kept, new)] if kept else new
            cut = int(np.searchsorted(kept[0].view(np.int64), kept[0].view(np.int64)[-1]))  # the last cell may go on
            if cut:
                a, b = compare(*(x[:cut] for x in kept), threshold)
                kept = [x[cut:] for x in kept]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        if kept:
            a, b = compare(*kept, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = distinct.select("bits").repartition(max(1, count // 16_384)).mapInArrow(tidy(spread), "cell long, bits long, near boolean").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(tidy(meet), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 4, width: int = 4) -> DataFrame:
    """One row per document: ``doc_id, bits, component_id``, the least identifier that chains of links reach."""
    rows = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(rows.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "distinct")
    found = connected_components(links(distinct, threshold, distinct.count())).withColumnsRenamed({"node": "bits"})
    nodes = distinct.join(found, "bits", "left").withColumn("root", F.coalesce("component", "bits"))
    nodes = materialise(nodes.select("bits", "root", "least_id"), "nodes")
    least = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(lookup_join(nodes.select("bits", "root"), least, "root").select("bits", "component_id"), "named")
    return lookup_join(rows, named, "bits").select("doc_id", "bits", "component_id")


def drop_near_copies(docs: DataFrame, threshold: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with the document of least identifier of each class, all columns as they are.

    Rows without an identifier stay, as they can't be told apart; of rows that share an identifier, one stays.
    """
    found = materialise(near_duplicates(docs, threshold, width), "near")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    single = left.join(again, "doc_id", "left_anti")
    return single.unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
