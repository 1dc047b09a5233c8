"""Toxicity by two class-conditional Kneser-Ney models.

Each class has the two lower orders of an interpolated trigram model over all words of its labelled texts:

    P(w | v) = max(N(v, w) - D, 0) / N(v)  +  l(v) Q(w | v),   l(v) = sum over w of min(N(v, w), D) / N(v)
    Q(w | v) = max(C(v, w) - D, 0) / C(v)  +  m(v) P(w),       m(v) = sum over w of min(C(v, w), D) / C(v)
    P(w)     = max(N(w) - D, 0) / N        +  l S(w),          l    = sum over w of min(N(w), D) / N

where ``N(v, w)`` and ``N(w)`` are the distinct words before the pair and before the word in the class (continuations),
``N(v)`` and ``N`` their sums, ``C`` the sums of ``N`` over both classes, and ``S(w)`` the share of ``w`` among the words
of the whole corpus, labelled or not.  Both classes back off to ``C`` and ``S``: a passage that only texts of one class
happen to quote is as likely in the other.  The highest order, which counts occurrences, is left out, because copies of a text
would count there; copies repeat their contexts and so add nothing to continuations.
An expression that a class has ``D`` times or less adds nothing to that class: all its mass goes to the shared estimate.
So pairs and words that both classes have so rarely needn't be sent to the tasks, which changes no likelihood.

A text is scored by the greatest difference of the two length-normalised log-likelihoods over windows of ``WINDOW``
words, as many as a pair has, so one insult counts alike in short and long texts; a logistic curve makes it a probability.  The curve is fitted to labelled
texts that the models haven't seen, at the classes' own proportions.

Labels are learnt from at most ``MAX_LABELLED`` rows, half of them of either class, the least by a hash of the identifier;
corpus counts take in every document.  A word is a run of letters, in lower case, known by a 64-bit hash.

Defined results: a NULL text counts as empty and has the score of a text without evidence; repeated rows are scored
alike; a NULL identifier is never a training row and its ``held_out`` is false; texts of any length are scored whole;
no labels, or one class only, give every text the share of toxic labels (0.5 without any); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.encoding import byte_kinds, is_letter
from ridgeline.llm.suffix_dedup import Hashes
from ridgeline.llm.workers import parts, tidy
from ridgeline.scratch import materialise

#: Labelled rows to learn from, at most.
MAX_LABELLED = 60_000
WINDOW = 2
DISCOUNT = 4.0
#: One labelled text in so many is kept for the curve.
CURVE = 5
#: Bins of the window score for the logistic curve.
BINS = 2000
BIN_WIDTH = 0.002
#: Bytes of text looked at together, words whose counts a task holds before it sends them, and rows sent together.
TOGETHER = 1 << 20
HELD = 1 << 20
SENT = 1 << 16

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(words, ends)`` for some texts at a time: hashes of the words in order, and where each text's end."""
    for part in parts(pa.RecordBatch.from_arrays([texts.cast(pa.large_string())], names=["text"]), 0, TOGETHER):
        lower = pc.utf8_lower(pc.fill_null(part.column(0), ""))
        if not len(lower):
            return
        offsets = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, 8 * lower.offset)
        a, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        data = np.frombuffer(lower.buffers()[2], np.uint8, n, a) if n else np.zeros(0, np.uint8)
        letter = np.zeros(n + 2, bool)
        letter[1:-1] = is_letter(byte_kinds(data), data)
        # a word ends where its text does
        begin = letter[1:] & ~letter[:-1]
        end = letter[:-1] & ~letter[1:]
        edges = offsets[1:-1] - a
        edges = edges[(edges > 0) & (edges < n)]
        inside = edges[letter[edges] & letter[edges + 1]]
        begin[inside] = end[inside] = True
        start, stop = np.flatnonzero(begin), np.flatnonzero(end)
        words = _mixed(Hashes(data).of(start, stop - start) + (stop - start).astype(np.uint64))
        yield words, np.searchsorted(start, offsets[1:] - a)


def pair_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mixed(before * _B + words)


def pair_keys(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the word before it in its text, 0 where there is none, and a hash of both."""
    before = np.zeros(len(words), np.uint64)
    before[1:] = words[:-1]
    first = np.r_[0, ends[:-1]]
    before[first[first < len(words)]] = 0
    return before, pair_hash(before, words)


@dataclass
class Table:
    """Values by sorted keys; a row of zeros or ones stands for what isn't there."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    other: float = 0.0

    def __post_init__(self) -> None:
        order = np.argsort(self.keys)
        self.keys, self.values = np.r_[self.keys[order], ~np.uint64(0)], np.vstack([self.values[order], np.full((1, self.values.shape[1]), self.other)])

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[self.keys[at] != keys] = len(self.keys) - 1
        return self.values[at]


@dataclass
class Model:
    """Discounted shares: of pairs, by class, ordinary first, and of both; of words by class; what contexts leave, likewise; and the shared share of words."""

    pairs: Table = field(default_factory=lambda: Table(values=np.zeros((0, 3))))
    words: Table = field(default_factory=Table)
    contexts: Table = field(default_factory=lambda: Table(values=np.zeros((0, 3)), other=1.0))
    shared: Table = field(default_factory=lambda: Table(values=np.zeros((0, 1)), other=1.0))
    left: tuple[float, float] = (1.0, 1.0)
    curve: tuple[float, float] = (0.0, 0.0)

    def ratios(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Difference of the log-likelihoods of each word, toxic less ordinary.

        Where neither class has a share of its own the shared one cancels, so any value may stand for it.
        """
        before, pair = pair_keys(words, ends)
        lower = self.words.of(words) + np.array(self.left) * self.shared.of(words)
        pairs, contexts = self.pairs.of(pair), self.contexts.of(before)
        both = pairs[:, :2] + contexts[:, :2] * (pairs[:, 2:] + contexts[:, 2:] * lower)
        return np.log(both[:, 1] / both[:, 0])

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Of each text the greatest difference of length-normalised log-likelihoods over windows."""
        out = [np.zeros(0)]
        for words, ends in words_of(texts):
            total = np.r_[0.0, np.cumsum(self.ratios(words, ends))]
            first = np.r_[0, ends[:-1]]
            n = ends - first
            size = np.minimum(n, WINDOW)
            windows = np.where(n > 0, n - size + 1, 0)
            start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(first, windows)
            value = (total[start + np.repeat(size, windows)] - total[start]) / np.repeat(size, windows)
            found = np.zeros(len(ends))
            if len(value):
                own = np.flatnonzero(windows)
                found[own] = np.maximum.reduceat(value, (np.cumsum(windows) - windows)[own])
            out.append(found)
        return np.concatenate(out)

    def scores(self, texts: pa.Array) -> np.ndarray:
        a, b = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(a + b * self.evidence(texts), -500, 500)))


def _map(docs: DataFrame, columns: list[str], schema: str, f) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)

    return docs.select(*columns).mapInArrow(tidy(run, "powers"), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> tuple[DataFrame, int, int]:
    """``text, toxic, curve`` of the rows to learn from, and how many rows of either class there are, ordinary first.

    The identifiers sent to all tasks are at most ``max_rows``.
    """
    rows = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = materialise(rows.withColumn("_hash", F.xxhash64("_id")), "labels")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [rows.filter(F.col("toxic") == k).orderBy("_hash", "_id").limit(max_rows // 2) for k in (0, 1)]
    rows = some[0].unionByName(some[1])
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_id"))
    return found.select("text", "toxic", (F.pmod(F.shiftright("_hash", 7), F.lit(CURVE)) == 0).alias("curve")), n.get(0, 0), n.get(1, 0)


def _summed(columns: list[np.ndarray], counts: np.ndarray | None) -> list[np.ndarray]:
    """The distinct rows of ``columns``, in whose place each is put, and last their counts if there are any."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    at = np.flatnonzero(new)
    if counts is not None:
        counts = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    order = order[at]
    for k in range(len(columns)):
        columns[k] = columns[k][order]
    return columns if counts is None else [*columns, counts]


def _joined(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Lists of columns end to end; they are emptied, so that a column isn't held twice for long."""
    return [np.concatenate([x.pop(0) for x in held]) for _ in range(len(held[0]))]


def _rows(docs: DataFrame, columns: list[str], schema: str, rows, counted: bool = True) -> DataFrame:  # noqa: ANN001
    """The rows of numbers that ``rows`` gives for a batch, with ``counted`` their counts ``n``; tasks add up what they can hold."""
    schema += ", n long" if counted else ""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def together() -> list[np.ndarray]:
            found = _joined(held)
            held.clear()
            n = found.pop() if counted else None
            return _summed(found, n)

        def out(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(found[0]), SENT):
                some = [x[k : k + SENT] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.itemsize == 8 else x.astype(np.int64)) for x in some], names=names)

        for batch in batches:
            for x in rows(batch):
                held.append(_summed(x, np.ones(len(x[0]), np.int64) if counted else None))
                size += len(held[-1][0])
                if size >= HELD:
                    found = together()
                    size = len(found[0])
                    if size >= HELD // 2:
                        yield from out(found)
                        size = 0
                    else:
                        held.append(found)
                    del found
        if held:
            yield from out(together())

    return docs.select(*columns).mapInArrow(tidy(run, "powers"), schema)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``toxic, before, word, n``: of the word pairs of either class how many different words stand before them.

    Tasks send each triple once; those of a pair meet in one shuffle, at most as many as the labelled texts have.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for kind in (0, 1):
            own = batch.filter(pc.equal(batch.column(1), kind)).column(0)
            for words, ends in words_of(own):
                before, _ = pair_keys(words, ends)
                first = np.r_[0, ends[:-1]]
                second = np.r_[np.uint64(0), before[:-1]]
                second[first[first < len(words)]] = 0
                yield [np.full(len(words), kind, np.uint8), before, words, second]

    found = _rows(texts, ["text", "toxic"], "toxic long, before long, word long, second long", rows, counted=False).repartition("before", "word").distinct()
    return found.groupBy("toxic", "before", "word").agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: occurrences of every word in all documents."""
    found = _rows(docs, ["text"], "word long", lambda batch: ([words] for words, _ in words_of(batch.column(0))))
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _curve(bins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Logistic curve by Newton's method on (value, toxic, all), lightly held to zero."""
    x = np.array([b[0] for b in bins])
    y, n = np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float)
    design = np.stack([np.ones_like(x), x], axis=1)
    at = np.array([math.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5)), 0.0])
    hold = np.array([1e-6, 1e-3])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        gradient = design.T @ (y - n * p) - hold * at
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(hold)
        step = np.linalg.solve(hessian, gradient)
        at = at + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def _table(rows: DataFrame, key: list[str], columns: list[str], other: float) -> Table:
    """A table of bounded size: what the labelled rows have more than ``DISCOUNT`` times.  A key of two columns is a word pair."""
    found = rows.select(*key, *columns).toArrow()
    values = np.stack([found[c].to_numpy() for c in columns], axis=1) if len(found) else np.zeros((0, len(columns)))
    keys = [found[c].to_numpy().astype(np.int64).view(np.uint64) for c in key]
    return Table(keys[0] if len(key) == 1 else pair_hash(*keys), values.astype(float), other)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, discount: float = DISCOUNT) -> Model:
    """Learn from labelled rows outside the held-out fold and from all documents' counts."""
    texts, plain, toxic = labelled_texts(docs, labels, max_rows)
    model = Model(curve=(math.log((toxic + 0.5) / (plain + 0.5)), 0.0))
    if not plain or not toxic:
        return model
    texts = materialise(texts, "labelled", compression="zstd")
    counts = materialise(pair_counts(texts.filter("NOT curve").select("text", "toxic")), "pairs", compression="zstd")

    kept = F.least(F.col("n"), F.lit(discount))
    over = F.greatest(F.col("n") - discount, F.lit(0.0))
    both = counts.groupBy("before", "word").agg(F.sum("n").alias("n")).select(F.lit(2).cast("long").alias("toxic"), "before", "word", "n")
    every = counts.unionByName(both)
    contexts = every.groupBy("toxic", "before").agg(F.sum("n").alias("total"), F.sum(kept).alias("left"), F.max("n").alias("most"))
    contexts = materialise(contexts.filter(F.col("most") > discount), "contexts")
    pairs = materialise(every.filter(F.col("n") > discount).join(contexts, ["toxic", "before"]), "often")
    of = lambda k, share: F.sum(F.when(F.col("toxic") == k, share))
    left = [F.coalesce(of(k, F.col("left") / F.col("total")), F.lit(1.0)).alias(f"p{k}") for k in range(3)]
    share = [F.coalesce(of(k, over / F.col("total")), F.lit(0.0)).alias(f"p{k}") for k in range(3)]
    model.contexts = _table(contexts.groupBy("before").agg(*left), ["before"], ["p0", "p1", "p2"], 1.0)
    model.pairs = _table(pairs.groupBy("before", "word").agg(*share), ["before", "word"], ["p0", "p1", "p2"], 0.0)
    words = materialise(counts.groupBy("toxic", "word").agg(F.count(F.lit(1)).cast("double").alias("n")), "words")
    totals = {r["toxic"]: (r["total"], r["left"]) for r in words.groupBy("toxic").agg(F.sum("n").alias("total"), F.sum(kept).alias("left")).collect()}
    if len(totals) < 2:
        return model
    model.left = tuple(totals[k][1] / totals[k][0] for k in (0, 1))
    total = F.when(F.col("toxic") == 1, totals[1][0]).otherwise(totals[0][0])
    share = [F.coalesce(of(k, over / total), F.lit(0.0)).alias(f"p{k}") for k in (0, 1)]
    model.words = _table(words.filter(F.col("n") > discount).groupBy("word").agg(*share), ["word"], ["p0", "p1"], 0.0)
    # only of words that a class has a share of: the shared estimate of others cancels
    known = words.filter(F.col("n") > discount).select("word").unionByName(pairs.select("word")).distinct()
    corpus = materialise(corpus_counts(docs), "corpus", compression="zstd")
    size = corpus.agg(F.sum("n")).first()[0]
    model.shared = _table(corpus.join(known, "word").select("word", (F.col("n") / size).alias("share")), ["word"], ["share"], 1.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    top = BINS * BIN_WIDTH

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bins = np.clip(sent.value.evidence(batch.column(0)), -top, top) // BIN_WIDTH
        yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), batch.column(1)], names=["bin", "toxic"])

    bins = _map(texts.filter("curve"), ["text", "toxic"], "bin int, toxic int", place).groupBy("bin", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("bin", "toxic").collect()
    # either class at its own proportion
    weight = {k: n / min(n, max_rows // 2) for k, n in enumerate((plain, toxic))}
    if bins:
        model.curve = _curve([((r["bin"] + 0.5) * BIN_WIDTH, weight[1] * r["n"] * r["toxic"], weight[r["toxic"]] * r["n"]) for r in bins])
    return model


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``doc_id`` and the probability that a text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(batch.column(1)), pa.float64())], names=["doc_id", column])

    return _map(docs, ["doc_id", "text"], f"doc_id {dict(docs.dtypes)['doc_id']}, `{column}` double", run)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the texts that score ``threshold`` or more, all columns and rows otherwise as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, at, TOGETHER):
                yield part.filter(pa.array(sent.value.scores(part.column(at)) < threshold, pa.bool_()))

    return docs.mapInArrow(tidy(run, "powers"), docs.schema)
