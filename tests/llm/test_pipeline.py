"""The pipeline's stages on odd rows and on an empty table."""

import corpus_pipeline

from .test_documents import ODD, rows_of


def test_stages_on_odd_rows(spark, sf_dir):
    docs = rows_of(spark, ODD, [5, 3, None, 1, 1, 0, 9, 8, 7, 6])
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        left[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == docs.columns and empty.count() == 0
    assert len(left["toxicity"]) == len(left["decontamination"]) == 10
    # NULL and empty texts are copies, as are the two words and the two long texts
    assert left["exact dedup"] == [*((False, i) for i in (1, 6, 7, 8, 9)), (True, 0)]


def test_packing_takes_what_is_left(spark, sf_dir):
    docs = rows_of(spark, ["a b", None, "c"], [1, 2, 3])
    got = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {(1, 3), (2, 1), (3, 2)}
    assert [sum(r["length"] for r in got if r["doc_id"] == i) for i in (1, 2, 3)] == [3, 1, 2]
