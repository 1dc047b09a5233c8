"""Bytes covered by long strings that start at more than one place in a corpus, by hash-compared suffix sorting.

A corpus doesn't fit one suffix array, so its strings are dealt out by content before they are sorted:

* Anchors.  Of the hashes of all ``KGRAM``-byte strings within a window of ``length`` bytes the least marks the
  window's anchor, so equal windows have equal anchors at equal places.  Runs of windows with one anchor are a *piece*.
  Windows that are equal lie in pieces with the same anchor hash, their *key*: only pieces of a key need be compared.
* Pieces whose key occurs once can't hold a repeated string and go no further; a bitmap sent to all tasks tells most of
  them.  Of the others the bytes are sent, equal ones grouped by their bytes, not by a hash: what occurs twice is
  covered whole.
* Different pieces of a key meet in one task, which sorts the suffixes that start at their windows by prefix polynomial
  hashes: a binary search over prefix lengths finds where two suffixes part, so a comparison takes a logarithmic
  number of steps, and a merge sort orders them (``sort_suffixes``).  Neighbours that agree in ``length`` bytes
  are one string; they are compared byte by byte.
* A key with more than ``HOT`` different pieces, as at the edges of a passage that very many texts quote, isn't sorted
  in one task.  Its pieces are divided into short runs of windows, dealt out anew by a hash of the bytes that all windows of
  a run share, and then to single windows, which are grouped by their bytes.

A text is known by its SHA-256, so equal texts are looked at once in a task, and texts that occur twice are covered whole.

Defined results: a NULL text counts as empty; texts shorter than ``length`` lose nothing; a repeated row is a copy of
the text; a NULL identifier is carried along; texts of any length are handled whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.bitmaps import bitmap, bitmap_bits, noted
from ridgeline.llm.workers import cache
from ridgeline.operators.skew import lookup_join
from ridgeline.scratch import collect_garbage, materialise, release

LENGTH = 200
KGRAM = 48
#: Different pieces of a key that are sorted in one task; keys with more are divided.
HOT = 2000
#: Windows of a run into which pieces of such keys are divided first.
RUN = 20
#: Bytes of text looked at together, and suffixes sorted together, about.
TOGETHER = 1 << 20
SORTED = 250_000
#: Different pieces whose bytes a task remembers having sent.
SENT = 50_000
#: Base of the polynomial hashes modulo 2**64 (odd, so it has an inverse), and a mixing multiplier.
BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bits of a place within texts that are looked at together.
_PLACE = np.uint64(24)
_MASK = (1 << 64) - 1

SPANS = "array<struct<start:int,end:int>>"


#: Of each base the most powers that this worker has needed for texts up to a bound.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = cache("powers")
_KEPT_POWERS = 1 << 22


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, ``size`` at least, which is a power of two."""
    if base in _POWERS and len(_POWERS[base][0]) >= size:
        return _POWERS[base]
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
        out.append(p)
    if size <= _KEPT_POWERS:
        _POWERS[base] = (out[0], out[1])
    return out[0], out[1]


class Hashes:
    """Prefix polynomial hashes of a byte string: the hash of any part takes two look-ups."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        self.power, self.inverse = _powers(base, 1 << max(8, (n + 1).bit_length()))
        self.prefix = np.zeros(n + 1, np.uint64)
        # bytes are spread over 64 bits first, or low bits would follow the bytes' own low bits
        np.cumsum((_TABLE[data] * self.power[:n]), out=self.prefix[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of the parts, whatever their place."""
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def windows(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:n]) * self.inverse[:n]


_TABLE = np.frombuffer(hashlib.shake_256(b"bytes").digest(2048), np.uint64).copy()


def extension(h: Hashes, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``a`` and ``b`` have in common, up to ``limit``: binary search by hash."""
    low, high = np.zeros(len(a), np.int64), limit.astype(np.int64)
    # the whole first: what is equal, as most of a repeated passage is, needs no search
    same = h.of(a, high) == h.of(b, high)
    low[same] = high[same]
    high[~same] -= 1
    at = np.flatnonzero(low < high)
    while len(at):
        middle = (low[at] + high[at] + 1) // 2
        same = h.of(a[at], middle) == h.of(b[at], middle)
        low[at[same]] = middle[same]
        high[at[~same]] = middle[~same] - 1
        at = at[low[at] < high[at]]
    return low


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int, h: Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts``, cut at ``length`` bytes, and what each has in common with the one before.

    Runs of doubling width are merged; all merges of a width are done together, each suffix finding its place in the
    other run by binary search with hash comparisons.  First come sixteen bytes as numbers, so comparisons are only
    made among suffixes that agree in those.
    """
    h = h or Hashes(data)
    n = len(starts)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    heads = [word[np.minimum(starts + k, len(data))].astype(np.uint64) for k in (0, 8)]
    left = np.minimum(len(data) - starts, length)
    order = np.lexsort((heads[1], heads[0]))
    starts, left = starts[order], left[order]
    new = np.zeros(n, bool)
    for head in heads:
        head = head[order]
        new[1:] |= head[1:] != head[:-1]
    group = np.cumsum(new)

    def before(x: np.ndarray, y: np.ndarray, tie: np.ndarray) -> np.ndarray:
        limit = np.minimum(left[x], left[y])
        same = extension(h, starts[x], starts[y], limit)
        ends = same >= limit
        less = np.where(ends, left[x] < left[y], padded[np.minimum(starts[x] + same, len(data))] < padded[np.minimum(starts[y] + same, len(data))])
        return less | (tie & ends & (left[x] == left[y]))

    first = np.r_[0, np.flatnonzero(np.diff(group)) + 1] if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, n])
    rank = np.arange(n)  # the suffix at each place
    offset = np.arange(n) - np.repeat(first, sizes)
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    width = 1
    todo = np.flatnonzero(size > 1)
    while len(todo):
        run = offset[todo] // width
        own = base[todo] + run * width
        second = run % 2 == 1
        other = np.where(second, own - width, own + width)
        low = np.minimum(other, base[todo] + size[todo])
        high = np.minimum(other + width, base[todo] + size[todo])
        start = low.copy()
        at = np.flatnonzero(low < high)
        while len(at):
            middle = (low[at] + high[at]) // 2
            goes = before(rank[middle], rank[todo[at]], second[at])  # equal suffixes of the first run stay before those of the second
            low[at[goes]] = middle[goes] + 1
            high[at[~goes]] = middle[~goes]
            at = at[low[at] < high[at]]
        place = np.where(second, other, own) + (todo - own) + (low - start)
        merged = rank.copy()
        merged[place] = rank[todo]
        rank, width = merged, 2 * width
        todo = todo[size[todo] > width]
    common = np.zeros(n, np.int64)
    if n > 1:
        common[1:] = extension(h, starts[rank[1:]], starts[rank[:-1]], np.minimum(left[rank[1:]], left[rank[:-1]]))
    return order[rank], common


def anchors(data: np.ndarray, length: int, kgram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes the place of its anchor, and the hashes of all k-grams; of equal hashes the first is the anchor."""
    grams = Hashes(data).windows(kgram) * _MIX
    grams ^= grams >> np.uint64(29)
    w = length - kgram + 1
    n = len(grams) - w + 1
    # the place in the low bits, so that the least value tells it
    low = np.uint64((1 << int(_PLACE)) - 1)
    marked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    padded = np.concatenate([marked, np.full(-len(grams) % w, ~np.uint64(0), np.uint64)]).reshape(-1, w)
    # window minima: least up to each place from the block's start, and from each place to the block's end
    upto = np.minimum.accumulate(padded, axis=1).ravel()
    onward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(onward[:n], upto[w - 1 : w - 1 + n]) & low).astype(np.int64), grams


def cut_pieces(texts: list[bytes], length: int, kgram: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``data, text, first, start, n, anchor, key`` for some texts at a time: the bytes together, and of each piece its text, its first window's place in it and in the bytes, how many windows it has, its anchor's place in it and its key.

    A text longer than ``TOGETHER`` comes in parts that overlap, each window in one of them.
    """
    parts: list[tuple[int, int, bytes]] = []

    def done() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = b"".join(x for _, _, x in parts)
        ends = np.cumsum([len(x) for _, _, x in parts])
        windows = np.array([len(x) - length + 1 for _, _, x in parts])
        base = ends - windows - length + 1
        start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(base, windows)
        at, grams = anchors(np.frombuffer(data, np.uint8), length, kgram)
        at = at[start]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        own = np.searchsorted(ends, start[new], "right")
        offset = np.array([k for _, k, _ in parts]) - base
        text = np.array([k for k, _, _ in parts])
        return data, text[own], start[new] + offset[own], start[new], np.diff(np.r_[new, len(start)]), at[new] - start[new], grams[at[new]]

    size = 0
    for k, x in enumerate(texts):
        for a in range(0, max(1, len(x) - length + 1), TOGETHER):
            part = x if len(x) <= TOGETHER else x[a : a + TOGETHER + length - 1]
            if len(part) >= length:
                parts.append((k, a, part))
                size += len(part)
            if size >= TOGETHER:
                yield done()
                parts, size = [], 0
            if len(x) <= TOGETHER:
                break
    if parts:
        yield done()


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Of each of some different pieces the windows that occur again in any of them, by sorting all suffixes that start at windows."""
    ends = np.cumsum([len(x) for x in pieces])
    windows = np.array([len(x) - length + 1 for x in pieces])
    cut = np.cumsum(windows)
    starts = np.arange(cut[-1]) - np.repeat(cut - windows, windows) + np.repeat(ends - windows - length + 1, windows)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    order, common = sort_suffixes(data, starts, length)
    equal = np.flatnonzero(common >= length)
    step = np.arange(length)
    for k in range(0, len(equal), 20_000):
        some = equal[k : k + 20_000]
        if not (data[starts[order[some]][:, None] + step] == data[starts[order[some - 1]][:, None] + step]).all():
            raise ArithmeticError("two strings have one hash")  # mends by another base
    again = np.zeros(len(starts), bool)
    again[order[equal]] = again[order[equal - 1]] = True
    return np.split(again, cut[:-1])


def _runs(hit: np.ndarray, length: int) -> list[dict[str, int]]:
    """The bytes covered by the windows that are hit, as maximal runs."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at) > length)
    return [{"start": int(a), "end": int(b) + length} for a, b in zip(at[np.r_[0, new + 1]], at[np.r_[new, len(at) - 1]])]


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keys(texts: DataFrame, length: int, kgram: int) -> DataFrame:
    """Keys that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, key in cut_pieces([x.as_py().encode("utf-8", "surrogatepass") for x in batch.column(0)], length, kgram):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return texts.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")


def _candidates(texts: DataFrame, keys: DataFrame, length: int, kgram: int) -> DataFrame:
    """``digest, first, key, one, two, anchor, piece``: the pieces whose key may be among ``keys``; their bytes where a task sends them first."""
    bits = bitmap_bits(keys.count())
    place = lambda shift: F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(bits - 1))
    held = bitmap(keys.select(F.explode(F.array(place(0), place(24))).alias("place")), bits)
    sent = keys.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known: dict[tuple[int, int], bytes] = {}
        for batch in batches:
            digests, own = [], []
            for d, x in zip(batch.column(0), batch.column(1)):
                if (digest := d.as_py()) not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    own.append(x.as_py().encode("utf-8", "surrogatepass"))
            for data, text, first, start, n, anchor, key in cut_pieces(own, length, kgram):
                hit = np.ones(len(key), bool)
                for shift in (0, 24):
                    hit &= noted(sent.value, ((key >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64))
                at = np.flatnonzero(hit)
                names, pieces = [], []
                for a, z in zip(start[at].tolist(), (start[at] + n[at] + length - 1).tolist()):
                    piece = data[a:z]
                    name = xxhash.xxh3_128_intdigest(piece)
                    name = (name >> 64, name & _MASK)
                    names.append(name)
                    if known.get(name) == piece:
                        pieces.append(None)
                    else:
                        if len(known) >= SENT:
                            known.clear()
                        known[name] = piece
                        pieces.append(piece)
                one, two = (pa.array(np.array([x[k] for x in names], np.uint64).view(np.int64)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[k] for k in text[at].tolist()], pa.binary()), pa.array(first[at].astype(np.int32)), pa.array(key[at].view(np.int64)), one, two, pa.array(anchor[at].astype(np.int32)), pa.array(pieces, pa.binary())],
                    names=["digest", "first", "key", "one", "two", "anchor", "piece"],
                )

    return texts.mapInArrow(run, "digest binary, first int, key long, one long, two long, anchor int, piece binary")


def _sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """``key, one, two, spans`` of the different pieces ``key, one, two, piece`` of keys with several, but a bounded number of them."""

    def sort(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        spans = [_runs(x, length) for x in repeated_windows([r[3] for r in rows], length)]
        at = [k for k, x in enumerate(spans) if x]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([*(pa.array([rows[k][c] for k in at], pa.int64()) for c in range(3)), pa.array([spans[k] for k in at], kind)], names=["key", "one", "two", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        size = 0
        first = None  # a key's first piece waits for another
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if first and first[0] == row[0]:
                    rows.append(first)
                    size += len(first[3]) - length + 1
                    first = None
                if not rows or rows[-1][0] != row[0]:
                    if size >= SORTED:
                        yield sort(rows)
                        rows, size = [], 0
                    first = row
                    continue
                rows.append(row)
                size += len(row[3]) - length + 1
        if rows:
            yield sort(rows)

    return pieces.select("key", "one", "two", "piece").repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key long, one long, two long, spans {SPANS}")


def _divided(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """Pieces as runs of ``width`` windows: ``of`` is the piece, ``at`` the run's place in it, and the new key hashes what is common to all windows of such a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("of", of := pa.struct([("key", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])), ("at", pa.int32()), *of, ("anchor", pa.int32()), ("piece", pa.binary())])
        for batch in batches:
            for rows in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                out = []
                for key, one, two, anchor, x in zip(*(c.to_pylist() for c in rows.columns)):
                    n = len(x) - length + 1
                    # a window's distance from the anchor says which run it is in, so equal windows are in runs alike
                    for k in range((anchor - n + 1) // width, anchor // width + 1):
                        first, end = max(0, anchor - (k + 1) * width + 1), min(n, anchor - k * width + 1)
                        core, part = x[anchor - k * width : anchor - (k + 1) * width + 1 + length], x[first : end + length - 1]
                        own = xxhash.xxh3_64_intdigest(core, seed=xxhash.xxh3_64_intdigest(f"{key} {k}"))
                        name = xxhash.xxh3_128_intdigest(part)
                        signed = [v - (1 << 64) if v >> 63 else v for v in (own, name >> 64, name & _MASK)]
                        out.append(({"key": key, "one": one, "two": two}, first, *signed, anchor - first, part))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    schema = "of struct<key:long,one:long,two:long>, at int, key long, one long, two long, anchor int, piece binary"
    return pieces.select("key", "one", "two", "anchor", "piece").mapInArrow(run, schema)


def _kinds(pieces: DataFrame) -> DataFrame:
    """Different pieces, by their bytes."""
    kinds = materialise(pieces.groupBy("key", "one", "two", "piece").agg(F.max("anchor").alias("anchor")), "kinds", compression="zstd")
    if kinds.count() != kinds.select("key", "one", "two").distinct().count():
        raise ArithmeticError("two pieces have one name of 128 bits")
    return kinds


def _covered(kinds: DataFrame, counts: DataFrame, length: int, hot: int, widths: tuple[int, ...]) -> DataFrame:
    """``kind, start, end``: what is covered of the different pieces ``key, one, two, piece, anchor`` that occur so many ``times``."""
    kind = F.struct("key", "one", "two").alias("kind")
    ends = kinds.select("key", "one", "two", F.octet_length("piece").alias("end"))
    out = ends.join(counts.filter("times > 1"), ["key", "one", "two"]).select(kind, F.lit(0).alias("start"), "end")
    if not widths:  # single windows
        return out
    many = materialise(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key"), "keys")
    none = many.isEmpty()
    # fewer keys than one in ``hot`` pieces
    few = kinds if none else kinds.join(F.broadcast(many), "key", "left_anti")
    found = _sorted_spans(few, length).select(kind, F.explode("spans").alias("span"))
    out = out.unionByName(found.select("kind", "span.start", "span.end"))
    if none:
        return out
    runs = materialise(_divided(lookup_join(kinds, many, "key", "inner"), length, widths[0]), "runs", compression="zstd")
    counts = runs.groupBy("key", "one", "two").agg(F.count(F.lit(1)).alias("times"))
    inner = _covered(_kinds(runs), counts, length, hot, widths[1:]).groupBy("kind").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    back = lookup_join(runs.select("of", "at", kind), materialise(inner, "spans"), "kind", "inner").select(F.col("of").alias("kind"), "at", F.explode("spans").alias("span"))
    return out.unionByName(back.select("kind", (F.col("at") + F.col("span.start")).alias("start"), (F.col("at") + F.col("span.end")).alias("end")))


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of texts as maximal runs."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                a, b = (x.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                cut = np.flatnonzero(a[1:] > b[:-1]) + 1
                out.append([{"start": int(i), "end": int(j)} for i, j in zip(a[np.r_[0, cut]], b[np.r_[cut - 1, len(b) - 1]])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["digest", "spans"])

    parts = spans.groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("parts"))
    return parts.mapInArrow(run, f"digest binary, spans {SPANS}")


def repeated_spans(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, text, spans`` where ``spans`` are the maximal runs ``(start, end)`` of covered bytes, for every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", _digest(F.col("text")).alias("digest"))
    texts = rows.filter(F.octet_length("text") >= length)
    keys = materialise(_keys(texts, length, kgram), "keys")
    candidates = materialise(_candidates(texts.select("digest", "text"), keys, length, kgram), "candidates", compression="zstd")
    counts = candidates.groupBy("key", "one", "two").agg(F.count(F.lit(1)).alias("times"))
    collect_garbage(docs.sparkSession)
    kinds = _kinds(candidates.filter("piece IS NOT NULL"))
    collect_garbage(docs.sparkSession)
    covered = _covered(kinds, counts, length, hot, (min(RUN, length // 4), 1)).groupBy("kind").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    covered = materialise(covered, "covered")
    release(kinds)
    places = candidates.select("digest", "first", F.struct("key", "one", "two").alias("kind"))
    hit = lookup_join(places, covered, "kind", "inner").select("digest", "first", F.explode("spans").alias("span"))
    copied = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("end")).filter("n > 1")
    spans = hit.select("digest", (F.col("first") + F.col("span.start")).alias("start"), (F.col("first") + F.col("span.end")).alias("end"))
    spans = materialise(_merged(spans.unionByName(copied.select("digest", F.lit(0).alias("start"), "end"))), "spans")
    release(candidates, covered)
    out = lookup_join(rows, spans, "digest", "left")
    return out.select("doc_id", "text", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``repeated_spans`` found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, x, spans in zip(batch.column(0), batch.column(1), batch.column(2)):
                text, kept, at, gone = x.as_py().encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, 0
                for s in sorted((p["start"], p["end"]) for p in spans.as_py()):
                    kept.update(text[at : s[0]])
                    at, gone = s[1], gone + s[1] - s[0]
                kept.update(text[at:])
                out.append((i.as_py(), len(text), gone, len(spans), kept.hexdigest()))
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
