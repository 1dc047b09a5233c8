"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The index holds items cut into segments of at most ``SEGMENT`` words.  Contributions are divided by the segment's own
score, so a passage that holds a whole segment scores 1 and one threshold serves all items.  Every document is cut into
overlapping passages of two segments' length, so a segment lies whole in one of them, and every passage is a query.
Postings have block maxima: a passage whose words' upper bounds don't reach the threshold is passed over, so is a block
of segments whose maxima don't reach it, and in the others pivots lead to all segments above the threshold.

What is retrieved is verified on words: shares of the question's and of the answer's five-word shingles in the
passage.  An item's answer is its last sentence or line, its question what comes before.

The index is sent to all tasks.  Items are taken in blocks of at most ``BLOCK_BYTES`` of text, one pass over the
documents for each, so a table of any size is searched whole with bounded memory.  BM25's statistics (segments, their mean
length, in how many of them a word is) are those of all items, so scores don't depend on the blocks.

Defined results: a NULL or empty text or item, and an item without words, matches nothing; equal items are all
reported; repeated rows are reported each time; a NULL identifier is carried along; very long texts are searched whole;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.workers import cache, parts, tidy
from ridgeline.scratch import materialise

SEGMENT = 96
K1, B = 1.2, 0.75
#: Segments that share a block maximum.
BLOCK = 4
THRESHOLD = 0.6
SHINGLE = 5
OVERLAP = 0.8
BLOCK_BYTES = 16 << 20
#: Bytes of text that go back to Spark together.
TOGETHER = 1 << 20

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def segments_of(text: str) -> list[list[str]]:
    """The words of an item in segments of at most ``SEGMENT``, about equally long."""
    words = words_of(text)
    parts = max(1, -(-len(words) // SEGMENT))
    return [own for p in range(parts) if (own := words[len(words) * p // parts : len(words) * (p + 1) // parts])]


@dataclass
class Statistics:
    """Of all items: segments, their mean length, and in how many each word is."""

    segments: int
    mean: float
    containing: dict[str, int]

    @staticmethod
    def of(texts: Iterable[str]) -> Statistics:
        own = [s for t in texts for s in segments_of(t)]
        return Statistics(len(own), sum(map(len, own)) / max(1, len(own)), Counter(w for s in own for w in set(s)))


class Index:
    """Inverted index of items; ``search`` retrieves all segments that score the threshold or more."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, statistics: Statistics | None = None):
        self.threshold = threshold
        self.item: list[int] = []
        self.text: list[tuple[int, str]] = items
        segments: list[list[str]] = []
        for k, (_, text) in enumerate(items):
            own = segments_of(text)
            segments += own
            self.item += [k] * len(own)
        known = statistics or Statistics.of(text for _, text in items)
        n, mean = known.segments, known.mean
        idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in known.containing.items()}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, s in enumerate(segments):
            own = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(s) / mean)) for w, c in Counter(s).items()}
            total = sum(own.values())
            for w, x in own.items():
                postings[w].append((k, x / total))
        self.number = {w: i for i, w in enumerate(postings)}
        self.ids = [[k for k, _ in p] for p in postings.values()]
        self.weights = [[x for _, x in p] for p in postings.values()]
        self.bound = np.array([max(w) for w in self.weights] + [0.0])  # the last is for words that no item has
        self.maxima: list[dict[int, float]] = []
        for own, weights in zip(self.ids, self.weights):
            top: dict[int, float] = {}
            for k, x in zip(own, weights):
                top[k // BLOCK] = max(x, top.get(k // BLOCK, 0.0))
            self.maxima.append(top)
        self.first = np.cumsum([0, *map(len, self.maxima)])  # the blocks of all terms in one row
        self.block = np.array([b for m in self.maxima for b in m], np.int64)
        self.block_bound = np.array([x for m in self.maxima for x in m.values()])
        self._parts: dict[int, tuple[set, set]] = {}

    def blocks(self, terms: np.ndarray) -> list[int]:
        """Blocks of segments whose bound for distinct terms reaches the threshold."""
        first = self.first[terms]
        n = self.first[terms + 1] - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.flatnonzero(np.bincount(self.block[at], self.block_bound[at]) >= self.threshold - 1e-9).tolist()

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: within each block that can reach the threshold, segments by pivots in the term bounds."""
        found = []
        for block in self.blocks(terms):
            low, high = block * BLOCK, (block + 1) * BLOCK
            own = [(self.maxima[t][block], t) for t in terms.tolist() if block in self.maxima[t]]
            cursors = [[self.ids[t][at], t, at, top] for top, t in own if (at := bisect_left(self.ids[t], low)) < len(self.ids[t])]
            while cursors:
                cursors.sort()
                total, pivot = 0.0, -1
                for k, c in enumerate(cursors):
                    total += c[3]
                    if total >= self.threshold - 1e-9:
                        pivot = k
                        break
                if pivot < 0:
                    break
                segment = cursors[pivot][0]
                if cursors[0][0] == segment:
                    own = [c for c in cursors if c[0] == segment]
                    score = sum(self.weights[c[1]][c[2]] for c in own)
                    if score >= self.threshold - 1e-9:
                        found.append((segment, min(1.0, score)))
                    to = segment + 1
                else:
                    own, to = [c for c in cursors[:pivot] if c[0] < segment], segment
                for c in own:
                    at = bisect_left(self.ids[c[1]], to, c[2])
                    c[0], c[2] = (self.ids[c[1]][at], at) if at < len(self.ids[c[1]]) else (high, at)
                cursors = [c for c in cursors if c[0] < high]
        return found

    def parts(self, k: int) -> tuple[set, set]:
        """Shingles of an item's question and answer; where there is one sentence only it is both."""
        if k not in self._parts:
            pieces = [w for x in _SENTENCE.split(self.text[k][1]) if (w := words_of(x))]
            answer = pieces[-1]
            question = [w for x in pieces[:-1] for w in x] or answer
            self._parts[k] = shingles(question), shingles(answer)
        return self._parts[k]

    def matches(self, text: str) -> list[tuple[int, float, float, float]]:
        """(item number, best score, question overlap, answer overlap) of the items verified in a text."""
        words = words_of(text)
        get, none = self.number.get, len(self.number)
        if not words or not none:
            return []
        listed = [get(w, none) for w in words]
        terms = np.array(listed, np.int64)
        total = np.concatenate([[0.0], np.cumsum(self.bound[terms])])
        starts = np.arange(0, max(1, len(words) - SEGMENT), SEGMENT)
        ends = np.minimum(starts + 2 * SEGMENT, len(words))
        scores: dict[int, float] = {}
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, b in zip(starts.tolist(), ends.tolist()):
            if total[b] - total[a] < self.threshold - 1e-6:
                continue
            distinct = set(listed[a:b])
            distinct.discard(none)
            own = np.array(list(distinct), np.int64)
            if self.bound[own].sum() < self.threshold - 1e-6:
                continue
            for segment, score in self.search(own):
                k = self.item[segment]
                scores[k] = max(score, scores.get(k, 0.0))
                spans[k].append((a, b))
        out = []
        for k, score in scores.items():
            question, answer = self.parts(k)
            seen: set[tuple[str, ...]] = set()
            for a, b in spans[k]:
                part = words[max(0, a - SEGMENT) : b + SEGMENT]
                for n in {len(next(iter(question))), len(next(iter(answer)))}:
                    seen.update(zip(*(part[x:] for x in range(n))))
            q, r = len(question & seen) / len(question), len(answer & seen) / len(answer)
            whole = len((question | answer) & seen) / len(question | answer)
            if (q >= OVERLAP and r >= OVERLAP) or whole >= OVERLAP:
                out.append((k, score, q, r))
        return out


#: Indexes that this worker has built, by block; the last few are kept.
_BUILT: dict[str, Index] = cache("indexes")


@dataclass
class Block:
    """Some items with the statistics of all, sent to all tasks."""

    name: str
    items: list[tuple[int, str]]
    statistics: Statistics
    threshold: float

    def index(self) -> Index:
        if self.name not in _BUILT:
            while len(_BUILT) >= 2:
                del _BUILT[next(iter(_BUILT))]
            _BUILT[self.name] = Index(self.items, self.threshold, self.statistics)
        return _BUILT[self.name]


def _blocks(benchmark: DataFrame, threshold: float) -> Iterator[Block]:
    """Items in blocks of bounded size, read one partition at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Statistics.of(x.as_py() for x in batch.column(0))
            # no word is empty or has a space
            names, n = ["", " ", *own.containing], [own.segments, round(own.segments * own.mean), *own.containing.values()]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64())], names=["word", "n"])

    counts = materialise(items.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = {r["word"]: r["n"] for r in counts.filter("trim(word) = ''").collect()}
    if not total.get(""):
        return

    def made(block: list[tuple[int, str]]) -> Block:
        words = sorted({w for _, text in block for w in words_of(text)})
        known = counts.join(F.broadcast(spark.createDataFrame(pa.table({"word": words}))), "word")
        containing = {r["word"]: r["n"] for r in known.toLocalIterator()}
        return Block(uuid.uuid4().hex, block, Statistics(total[""], total[" "] / total[""], containing), threshold)

    block, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if words_of(r["text"]):
            block.append((r["item_id"], r["text"]))
            size += len(r["text"])
        if size >= BLOCK_BYTES:
            yield made(block)
            block, size = [], 0
    if block:
        yield made(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified pairs ``doc_id, item_id, score, question_overlap, answer_overlap``."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, threshold):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index, items = sent.value.index(), sent.value.items
            for batch in batches:
                rows = [(i.as_py(), items[k][0], s, q, r) for i, t in zip(batch.column(0), batch.column(1)) if t.is_valid for k, s, q, r in index.matches(t.as_py())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(tidy(run, "indexes"), schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold a test item, all columns as they are."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for block in _blocks(benchmark, threshold):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = sent.value.index()
            for batch in batches:
                for part in parts(batch, at, TOGETHER):
                    yield part.filter(pa.array([not (t.is_valid and index.matches(t.as_py())) for t in part.column(at)], pa.bool_()))

        docs = docs.mapInArrow(tidy(run, "indexes"), docs.schema)
    return docs
