"""Block-max WAND against plain scores, leaks against brute force, and odd rows."""

import random

import numpy as np

from ridgeline.llm import decontamination as d

from .test_documents import ODD, rows_of


def test_search_equals_plain_scores():
    draw = random.Random(4)
    vocabulary = [f"w{int(draw.paretovariate(0.6))}" for _ in range(400)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.randint(1, 30)))) for k in range(300)]
    for threshold in (0.3, 0.5, 0.9):
        index = d.Index(items, threshold)
        for _ in range(60):
            own = np.array(sorted({index.number[w] for w in draw.choices(list(index.number), k=draw.randint(1, 60))}))
            scores = np.zeros(len(index.item))
            for t in own.tolist():
                scores[index.ids[t]] += index.weights[t]
            found = dict(index.search(own))
            assert sorted(found) == [k for k, s in enumerate(scores) if s >= threshold - 1e-9]
            assert all(abs(found[k] - scores[k]) < 1e-9 for k in found)


def test_leaks(spark, sf_dir):
    from ridgeline.llm.queries import op2_decontamination

    docs = {r["doc_id"]: d.words_of(r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: d.shingles(d.words_of(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    own = {i: d.shingles(w) for i, w in docs.items()}
    want = {(i, k) for i, s in own.items() for k, t in items.items() if t and len(s & t) >= 0.8 * len(t)}
    got = {(r["doc_id"], r["item_id"]) for r in op2_decontamination(spark, sf_dir).collect()}
    assert want and got == want


def test_leaks_of_odd_rows(spark):
    text = " ".join(f"token{k}" for k in range(300)) + ". The answer is forty two words long."
    items = spark.createDataFrame([(1, text, None), (2, None, None), (3, "", None), (4, "??", None), (5, text, "x"), (None, "one two three four five six. seven", None)], "item_id long, text string, doc_id string")
    docs = rows_of(spark, [*ODD, "filler " * 5000 + text + " filler" * 500, "one two three four five six. Seven", "one two three"])
    got = sorted((r["doc_id"], r["item_id"] or -1) for r in d.find_leaks(docs, items).collect())
    assert got == [(10, 1), (10, 5), (11, -1)]
    left = d.drop_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [*range(10), 12]
    assert d.find_leaks(docs, items.limit(0)).count() == 0 and d.find_leaks(rows_of(spark, []), items).count() == 0
    assert d.drop_leaks(docs, items.limit(0)).count() == 13


def test_scores_do_not_depend_on_the_blocks(spark, sf_dir, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted(tuple(r) for r in d.find_leaks(docs, benchmark).collect())
    kept = lambda: sorted(r["doc_id"] for r in d.drop_leaks(docs, benchmark).select("doc_id").collect())
    one, whole = rows(), kept()
    monkeypatch.setattr(d, "BLOCK_BYTES", 3000)
    assert rows() == one and len(one) and kept() == whole
