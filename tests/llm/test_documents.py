"""Operators on whole documents against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from ridgeline.llm import encoding, exact_dedup, license_scan, packing, pii, queries, simhash_dedup, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, bits string"


def rows_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None, "x", 7, None) for i, t in zip(ids, texts)], SCHEMA)


ODD = [None, "", " ", "a", "a", "word " * 30_000, "word " * 30_000, "MIT License", "é\t☃ x@y.zz", None]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_equals_library(name, documents):
    tool = encoding.PieceEncoder(public_tokenizers.path(name))
    draw = random.Random(1)
    odd = [*"aB z\n  é'sÀɏ²½9.,!\x01\x85\t☃İΣ中 ͏%_И—は”1'‰x", "'ll", "'re", "'T", "'ve", "\n\n", "   ", "word", "ß"]
    texts = [t for _, t in documents[:60]] + ["".join(draw.choice(odd) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    texts += ["a<|endoftext|>b", "<|startoftext|> x", "<|EndOfText|>", "\0a", "", "x" * 60 + " " + "y" * 25, "\u0301a", "a\u0301"]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    expected = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(tool.encode_all(texts)) == expected
    assert [tool.encode(t) for t in texts[-300:]] == expected[-300:]


def test_token_files(spark, sf_dir, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in queries.op1_token_files(spark, sf_dir).collect()}
    start = 0
    for i, text in sorted(documents):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(documents)


@pytest.mark.parametrize("kind", ["dictionary", "delta"])
def test_token_files_of_odd_rows(spark, tmp_path, kind):
    docs = rows_of(spark, ODD, [5, 3, None, 1, 1, 0, 9, 8, 7, 6])
    token_files.write_token_files(docs, str(tmp_path / "a"), public_tokenizers.path("byte_bpe_50k.json"), 0, ("lang",), kind)
    got = token_files.read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 1, 3, 5, 6, 7, 8, 9]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert [len(r["ids"]) for r in got] == [r["n_tokens"] for r in got] and got[5]["ids"] == [0] and got[0]["lang"] == "en"
    token_files.write_token_files(docs.limit(0), str(tmp_path / "b"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def check_packing(pieces, size):
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return by_doc, padding


def test_packing(spark, sf_dir, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, padding = check_packing(queries.op4_packing(spark, sf_dir).collect(), 1024)
    assert padding == 0 and len(by_doc) == len(documents)
    for i, text in documents:
        ids = np.asarray([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_places_by_sum_of_squares():
    draw = random.Random(3)
    made = packing.SumOfSquares(20)
    for _ in range(400):
        n = draw.randint(1, 19)
        counts = [len(x) for x in made.open]

        def change(h):
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + n < 20:
                after[h + n] += 1
            return sum(x * x for x in after)

        want = min(change(h) for h in range(20 - n + 1) if h == 0 or counts[h])
        list(made.add((1, 0, bytes(4 * n), n)))
        assert sum(len(x) ** 2 for x in made.open) == want


def test_packing_of_odd_rows(spark):
    tool = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(rows_of(spark, ODD, [5, 3, None, 1, 2, 0, 9, 8, 7, 6]), tool, 0, 64).collect()
    by_doc, padding = check_packing(got, 64)
    assert padding == 0 and len(by_doc) == 10 and all(len(r["ids"]) == r["length"] for r in got) and by_doc[3][0]["ids"] == [0]
    assert packing.pack_documents(rows_of(spark, []), tool, 0).count() == 0


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, keep):
    from pyspark.sql import functions as F

    draw = random.Random(2)
    texts = [draw.choice([None, "", "a", "b", "long " * 5000, str(draw.random())]) for _ in range(400)]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    pick = max if keep == "max" else min
    for digest in (exact_dedup.sha256, lambda t: F.unhex(F.hex(F.crc32(t) % 5))):  # a digest that clashes
        got = {r["doc_id"]: r for r in exact_dedup.equal_texts(rows_of(spark, texts), digest, keep).collect()}
        assert len(got) == 400
        for i, t in enumerate(texts):
            own = groups[t or ""]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (pick(own), len(own), pick(own) == i)


def test_exact_dedup_of_odd_rows(spark):
    docs = rows_of(spark, ODD, [5, 3, None, 1, 1, 0, None, 8, None, 6])
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], (r["text"] or "")[:5]) for r in left.collect()) == Counter([(6, ""), (None, " "), (1, "a"), (0, "word "), (8, "MIT L"), (None, "é\t☃ x")])
    assert exact_dedup.equal_texts(rows_of(spark, [])).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    digits = lambda s: [int(x) for x in re.findall("[0-9]", s)]

    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_personal_data(spark, sf_dir, documents):
    for r in queries.op6_pii(spark, sf_dir).collect():
        want = base_spans(dict(documents)[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(":".join(map(str, x)) for x in want).encode()).hexdigest()
        assert r["spans"].startswith(",".join(":".join(map(str, x)) for x in want))


def test_personal_data_by_chance():
    draw = random.Random(5)
    for alphabet in ("a@.-b+%", "12.0 @a", "4-1 5", "+12().- 3", "1.2 3-+@a☃", "0123456789 -", "25.1"):
        for _ in range(3000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))
            assert [x for x in pii.find(text) if x[0] in pii.BASE_KINDS] == base_spans(text), text
    assert [x[0] for x in pii.find('token = "f3ef4d6b2755a36d7d9c" see https://ex.com/a. IBAN: DE89 3704 0044 0532 0130 00, SSN 123-45-6789')] == ["url", "secret", "iban", "ssn"]
    assert pii.find("1" * 50_000 + "." + "9" * 50_000 + ".1.2 +" + "(" * 50_000) == []


def test_a_long_secret_is_found_whole():
    for n in (16, 512, 513, 5000):
        assert pii.find("token = " + "aB3" * n) == [("secret", 8, 8 + 3 * n)]


def test_personal_data_of_odd_rows(spark):
    got = pii.digest(pii.find_personal_data(rows_of(spark, ODD, [5, 3, None, 1, 1, 0, 9, 8, 7, 6]))).collect()
    assert len(got) == 10 and sum(r["n_email"] for r in got) == 1 and {r["spans"] for r in got} == {"", "email:4:10"}


def test_license_scan_of_odd_rows(spark):
    texts = [*ODD, "The MIT license and the mit License. apache\nLICENSE general public, license", "Permission is hereby granted, free of charge, to any person really obtaining a copy of this software and associated documentation files, the software, to deal in the software without restriction"]
    got = {r["doc_id"]: r for r in license_scan.summary(license_scan.scan(rows_of(spark, texts))).collect()}
    assert len(got) == len(texts) and [got[i]["n_words"] for i in range(5)] == [0, 0, 0, 1, 1] and got[5]["n_words"] == 30_000
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["last_word"], got[10]["base_labels"]) == (4, 1, 9, "apache,gpl,mit")
    assert (got[11]["n_base"], got[11]["first_word"], got[11]["labels"]) == (0, None, "mit-text") and 0.8 <= got[11]["score"] < 1
    assert (got[7]["labels"], got[7]["score"], got[3]["labels"], got[3]["score"]) == ("mit", 1.0, "", 0.0)
    assert license_scan.scan(rows_of(spark, [])).count() == 0


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, pairs):
    at = list(range(n))

    def root(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_simhash(spark, sf_dir, documents):
    documents = sorted(documents)
    bits = np.array([plain_fingerprint(t) for _, t in documents], np.uint64)
    root = components(len(bits), np.argwhere(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4).tolist())
    got = {r["doc_id"]: r for r in queries.op10_simhash(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for k, (i, _) in enumerate(documents):
        assert got[i]["fingerprint"] == f"{int(bits[k]):016x}" and got[i]["component_id"] == documents[root[k]][0]


@pytest.mark.parametrize("count", [1, 10**9])
def test_anchors_lose_no_link(count):
    draw = np.random.default_rng(count)
    values = set(draw.integers(0, 2**63, 200, dtype=np.uint64).tolist())
    for x in list(values)[:100]:
        for _ in range(6):
            for k in draw.choice(64, draw.integers(1, 7), replace=False):
                x ^= 1 << int(k)
            values.add(x)
    values |= {0, 1, 3, 7, 2**64 - 1, *(2**k - 1 for k in range(64))}
    values = np.array(sorted(values), np.uint64)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    want = simhash_dedup._ties(len(values), a, b)
    cells, own, near = (np.concatenate(x) for x in zip(*simhash_dedup.copies(values, simhash_dedup.choose_code(count, 4))))
    order = np.argsort(cells, kind="stable")
    a, b = simhash_dedup.compare(cells[order], own[order], near[order], 4)
    place = {int(x): k for k, x in enumerate(values)}
    got = simhash_dedup._ties(len(values), np.array([place[int(x)] for x in a]), np.array([place[int(x)] for x in b]))
    assert (got == want).all()


def test_simhash_of_odd_rows(spark):
    docs = rows_of(spark, ODD, [5, 3, None, 1, 1, 0, None, 8, 7, 6])
    got = [(r["doc_id"], r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect()]
    assert Counter(got) == Counter([(5, 3), (3, 3), (None, 3), (1, 1), (1, 1), (0, 0), (None, 0), (8, 8), (7, 7), (6, 3)])
    assert simhash_dedup.drop_near_copies(docs).columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in simhash_dedup.drop_near_copies(docs).collect()) == [-1, -1, -1, 1, 3, 7, 8]
    assert simhash_dedup.near_duplicates(rows_of(spark, [])).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, sf_dir).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [(got[i]["score"], y, got[i]["predicted"]) for i, y in labels if got[i]["held_out"]]
    ones, zeros = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert area > 0.8 and sum(p for _, y, p in held if not y) <= 0.02 * len(zeros) and sum(p for _, y, p in held if y) >= 0.6 * len(ones)


def test_toxicity_of_odd_rows(spark):
    docs, none = rows_of(spark, ODD, [5, 3, None, 1, 1, 0, 9, 8, 7, 6]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.5}
    left = toxicity.reject_toxic(docs, none)
    assert left.columns == docs.columns and left.count() == 10
    labels = spark.createDataFrame([(i, 0, int(i % 2)) for i in range(10)] + [(None, None, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 10
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_full_table_and_any_division_change_no_ids(documents, monkeypatch, name):
    monkeypatch.setattr(encoding, "TOGETHER", 5000)
    texts = [t for _, t in documents[:80]] + ["", "tab\tseparated", "x" * 300, "of some words, " * 3000]
    tool = encoding.PieceEncoder(public_tokenizers.path(name), pieces=300)
    expected = [tool.whole(t).tobytes() for t in texts]
    assert list(tool.encode_all(texts)) == expected == list(tool.encode_all(texts))


def test_metadata_with_the_names_of_the_files_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 7, "x", 3, 9)], "doc_id long, text string, part int, ids string, n_tokens long, Start int")
    token_files.write_token_files(docs, str(tmp_path / "a"), public_tokenizers.path("byte_bpe_50k.json"), 0, ("part", "ids", "n_tokens", "Start"))
    (got,) = token_files.read_token_files(spark, str(tmp_path / "a")).collect()
    assert (got["part_"], got["ids_"], got["n_tokens_"], got["Start_"], got["n_tokens"], got["start"]) == (7, "x", 3, 9, 3, 0)


def test_dropping_copies_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (3, "b", "z", 3), (3, "b", "z", 3), (None, "b", "w", 4)], "doc_id long, text string, _digest string, _of int")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect()) == [(2, "a", "y", 2), (3, "b", "z", 3)]
