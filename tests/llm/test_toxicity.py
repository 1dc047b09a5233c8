"""Kneser-Ney models against the definition in plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import toxicity

words_of = lambda text: re.findall(r"[a-zéß]+", (text or "").lower())


def twin(texts, corpus, discount):
    """Evidence of a text by dictionaries; ``texts`` are those of the ordinary and of the toxic class."""
    seen = [set(), set()]
    for k, own in enumerate(texts):
        for t in own:
            w = ["", "", *words_of(t)]
            seen[k].update(zip(w, w[1:], w[2:]))
    pair = [Counter((v, w) for _, v, w in s) for s in seen]
    shared = pair[0] + pair[1]
    word = [Counter(w for _, w in p) for p in pair]
    every = Counter(w for t in corpus for w in words_of(t))
    size = sum(every.values())

    def by_context(counts):
        out = defaultdict(list)
        for (v, _), n in counts.items():
            out[v].append(n)
        return out

    contexts, both = [by_context(p) for p in pair], by_context(shared)

    def share(counts, context, v, w):
        ns = context.get(v)
        if not ns:
            return 0.0, 1.0
        return max(counts[v, w] - discount, 0) / sum(ns), sum(min(n, discount) for n in ns) / sum(ns)

    def p(k, v, w):
        total = sum(word[k].values())
        low = max(word[k][w] - discount, 0) / total + sum(min(n, discount) for n in word[k].values()) / total * every[w] / size
        a, b = share(shared, both, v, w)
        c, d = share(pair[k], contexts[k], v, w)
        return c + d * (a + b * low)

    def evidence(text):
        w = words_of(text)
        r = [math.log(p(1, v, x) / p(0, v, x)) for v, x in zip(["", *w], w)]
        n = min(len(r), toxicity.WINDOW)
        return max(sum(r[k : k + n]) / n for k in range(len(r) - n + 1)) if r else 0.0

    return evidence


def corpus(seed, n):
    draw = random.Random(seed)
    plain, rude = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(60)], ["scum", "moron", "vile"]
    out = []
    for i in range(n):
        toxic = draw.random() < 0.4
        words = draw.choices(plain, [1 / (k + 1) for k in range(60)], k=draw.randint(0, 40))
        for _ in range(draw.randint(1, 3) * toxic):
            words.insert(draw.randint(0, len(words)), draw.choice(rude))
        out.append((i, draw.choice([" ", ", ", "\n1 "]).join(words).title(), int(toxic)))
    return out


@pytest.mark.parametrize("discount", [0.75, 2.0])
def test_models_equal_their_definition(spark, discount):
    rows = corpus(4, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    texts = toxicity.labelled_texts(docs, labels)[0].collect()
    own = [[r["text"] for r in texts if not r["curve"] and r["toxic"] == k] for k in (0, 1)]
    assert all(own) and any(r["curve"] for r in texts)
    assert not {r["text"] for r in texts} & ({t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1} - {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1})
    model = toxicity.fit(docs, labels, discount=discount)
    evidence = twin(own, [t for _, t, _ in rows], discount)
    some = [t for _, t, _ in rows] + ["", None, "unheard of words", "scum"]
    expected = [evidence(t) for t in some if t is None or set(words_of(t)) <= {w for _, x, _ in rows for w in words_of(x)}]
    got = model.evidence(pa.array([t for t in some if t is None or set(words_of(t)) <= {w for _, x, _ in rows for w in words_of(x)}], pa.string()))
    assert np.allclose(got, expected, rtol=0, atol=1e-9)


def test_toxic_texts_are_told_apart_and_clean_ones_kept(spark):
    rows = corpus(7, 1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(got[i], x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([s >= 0.7 for s, x in held if x]) > 0.95 and np.mean([s < 0.7 for s, x in held if not x]) > 0.95


def test_any_division_of_the_texts_scores_alike(monkeypatch):
    texts = pa.array([t for _, t, _ in corpus(2, 50)] + [None, "", "one"])
    whole = [(w.tolist(), e.tolist()) for w, e in toxicity.words_of(texts)]
    monkeypatch.setattr(toxicity, "TOGETHER", 100)
    parts = [(w.tolist(), e.tolist()) for w, e in toxicity.words_of(texts)]
    assert len(whole) == 1 and len(parts) > 1 and sum((w for w, _ in parts), []) == whole[0][0]
    assert np.diff([0, *whole[0][1]]).tolist() == [n for _, e in parts for n in np.diff([0, *e]).tolist()]
