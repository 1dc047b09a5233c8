"""Suffix sorting against Python's, repeated bytes against brute force, and odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ridgeline.llm import suffix_dedup as s

from .test_documents import ODD, rows_of


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[k : k + length] for x in data for k in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_sort_suffixes():
    draw = random.Random(6)
    for alphabet in ("ab", "a", "abc \0", "abcdefgh"):
        for _ in range(20):
            data = "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 300))).encode()
            starts = np.array(draw.sample(range(len(data)), draw.randint(1, len(data))))
            order, common = s.sort_suffixes(np.frombuffer(data, np.uint8), starts, 40)
            cut = [data[k : k + 40] for k in starts[order].tolist()]
            assert cut == sorted(cut)
            for k in range(1, len(cut)):
                same = next((i for i, (a, b) in enumerate(zip(cut[k], cut[k - 1])) if a != b), min(len(cut[k]), len(cut[k - 1])))
                assert common[k] == same


@pytest.mark.parametrize(("length", "hot"), [(20, 2000), (200, 2000), (200, 3), (40, 0)])
def test_repeated_bytes(spark, length, hot):
    draw = random.Random(length)
    words = [f"w{k}é" for k in range(300)]
    shared = [" ".join(draw.choices(words, k=length // 3)) for _ in range(8)]
    texts = []
    for _ in range(150):
        parts = [" ".join(draw.choices(words, k=draw.randint(0, length // 2))) for _ in range(3)]
        parts += [draw.choice(shared)[draw.randint(0, 9) :] for _ in range(draw.randint(0, 2))]
        draw.shuffle(parts)
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "x" * (3 * length), "ab" * length + "c" + "ab" * length, "y" * length, "z" * (length + 1), *ODD]
    got = {r["doc_id"]: tuple(r)[1:] for r in s.digest(s.repeated_spans(rows_of(spark, texts), length, length // 4, hot)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_query(spark, sf_dir):
    from ridgeline.llm.queries import op5_suffix_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in op5_suffix_dedup(spark, sf_dir).collect()}
    assert [got[r["doc_id"]] for r in docs] == brute([r["text"] for r in docs], 200)


def test_the_edge_of_a_passage_that_many_texts_quote(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    quote = " ".join(draw.choices(words, k=60))
    texts = [" ".join(draw.choices(words, k=40)) + quote[draw.randint(0, 2) :] + " ".join(draw.choices(words, k=40)) for _ in range(300)]
    got = {r["doc_id"]: tuple(r)[1:] for r in s.digest(s.repeated_spans(rows_of(spark, texts), 200, 48, 20)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(s, "TOGETHER", 3000)
    draw = random.Random(2)
    texts = ["".join(draw.choices("abcdef ", k=n)).encode() for n in (10, 500, 20_000, 0, 200, 2999, 3199, 9000)]
    seen = [np.zeros(max(0, len(x) - 199), int) for x in texts]
    keys: dict[bytes, set[int]] = {}
    for data, text, first, start, n, anchor, key in s.cut_pieces(texts, 200, 48):
        for t, f, a, m, k, z in zip(text, first, start, n, anchor, key):
            seen[t][f : f + m] += 1
            assert data[a : a + m + 199] == texts[t][f : f + m + 199] and 0 <= k <= 152
            for j in range(m):
                keys.setdefault(texts[t][f + j : f + j + 200], set()).add((int(z), int(k) - j))
    assert all((x == 1).all() for x in seen) and all(len(x) == 1 for x in keys.values())


def test_empty(spark):
    assert s.digest(s.repeated_spans(rows_of(spark, []))).count() == 0


def test_keys_with_one_piece_are_not_sorted(spark):
    import random

    from ridgeline.llm import suffix_dedup

    draw = random.Random(4)
    a, b, c = (bytes(draw.choices(range(97, 123), k=40)) for _ in range(3))
    rows = [(1, 1, 1, bytearray(a * 3)), (2, 1, 2, bytearray(a + b)), (2, 1, 3, bytearray(c + b)), (3, 1, 4, bytearray(c)), (4, 1, 5, bytearray(b + a)), (4, 1, 6, bytearray(a + c))]
    pieces = spark.createDataFrame(rows, "key long, one long, two long, piece binary")
    assert {r["two"] for r in suffix_dedup._sorted_spans(pieces, 20).collect()} == {2, 3, 5, 6}
