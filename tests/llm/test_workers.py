"""Memory of the Python workers."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from ridgeline.llm import encoding, toxicity, workers


class Task:
    """Stands for a table: what is mapped over it is the task."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_a_task_adds_up_rows_in_little_more_memory_than_they_take():
    n = toxicity.HELD + 1000
    pieces = [np.arange(a, min(n, a + (1 << 17)), dtype=np.uint64) for a in range(0, n, 1 << 17)]
    task = toxicity._rows(Task(), ["text"], "kind long, a long, b long, c long", lambda _: ([np.zeros(len(p), np.uint8), p % np.uint64(7), p, p] for p in pieces), counted=False)
    tracemalloc.start()
    at, sizes, total = tracemalloc.get_traced_memory()[0], [], 0
    for batch in task(iter([None])):
        sizes.append(batch.num_rows)
        total += sum(batch.column("b").to_pylist()[:1])
    peak = tracemalloc.get_traced_memory()[1] - at
    tracemalloc.stop()
    assert sum(sizes) == n and max(sizes) <= toxicity.SENT
    assert peak < 80e6  # the rows take 26 MB


def test_counts_of_equal_rows_are_added_across_pieces(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 10)
    pieces = [np.array(x, np.uint64) for x in ([1, 2, 2], [2, 3], [], [1, 1, 1], [5, 6, 7, 8, 9, 10, 11], [1, 2])]
    got = {}
    for batch in toxicity._rows(Task(), ["text"], "word long", lambda _: ([p] for p in pieces))(iter([None])):
        for word, n in zip(*(c.to_pylist() for c in batch.columns)):
            got[word] = got.get(word, 0) + n
    assert got == {1: 5, 2: 4, 3: 1} | {k: 1 for k in range(5, 12)}


def test_caches_of_other_operators_are_let_go():
    texts = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a few words", None]})
    encoding.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    list(workers.tidy(lambda batches: batches, "encoders")(iter([texts])))
    assert encoding._ENCODERS
    words = toxicity._rows(Task(), ["text"], "word long", lambda batch: ([w] for w, _ in toxicity.words_of(batch.column(1))))
    assert sum(b.num_rows for b in words(iter([texts]))) == 3
    assert not encoding._ENCODERS and workers.cache("powers")


def test_parts_hold_all_rows_once():
    texts = ["", None, "x" * 50, "é" * 30, "y", "z" * 500, ""]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["?", *texts, "?"], kind)], names=["id", "text"]).slice(1, 7)
        found = list(workers.parts(batch, 1, 60))
        assert [x for p in found for x in p.column(1).to_pylist()] == texts and len(found) > 3
        assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= 60 for p in found)
        assert [p.num_rows for p in workers.parts(batch.slice(0, 0), 1, 60)] == [0]
