"""License notices by diagonal voting, with DataFrame functions only.

Every word position of a text gives a rolling k-gram hash; a join with the template positions (a few hundred rows
fixed in this module, so they are broadcast) turns it into votes for *diagonals*, word position minus template
position.  Votes are added up by document, template and diagonal; neighbouring diagonals, which differ by inserted or
left-out words, are merged; and a span counts if enough of the template's k-grams were found in it.  Words are compared
as well as hashes, so a hash collision gives no vote.

Phrases are templates of two-word grams: a phrase stands where all its grams vote for one diagonal.

Defined results: a NULL text counts as empty; a text without words has zero words, no labels and score 0; repeated rows
give a row each; a NULL identifier is carried along; texts of any length are handled alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that the contract names.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices found beyond those; words as in the published texts.
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-text",
    "licensed under the apache license version 2 0": "apache-notice",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-text",
    "licensed under the gnu general public license": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "this work is licensed under a creative commons attribution": "cc-notice",
}
NOTICE_GRAM = 4
#: Diagonals no further apart than this are one span.
MERGE_GAP = 3
#: Share of a notice's k-grams that its span must hold.
MIN_SHARE = 0.8

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_rows() -> list[tuple]:
    """(template, label, is_phrase, grams, position, four words) for every template position; phrases have NULLs."""
    rows = []
    for t, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        words, phrase = text.split(), text in PHRASES
        k = 2 if phrase else NOTICE_GRAM
        grams = len(words) - k + 1
        for p in range(grams):
            rows.append((t, label, phrase, grams, p, *words[p : p + k], *[None] * (NOTICE_GRAM - k)))
    return rows


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, places`` and ``spans``.

    ``places`` are the phrases found, ``spans`` the merged and verified notices, both arrays of
    ``(label, first_word, words, share)``.
    """
    spark = docs.sparkSession
    templates = spark.createDataFrame(template_rows(), "t int, label string, phrase boolean, grams int, p int, a string, b string, c string, d string")
    templates = templates.withColumns({"h2": F.xxhash64("a", "b"), "h4": F.xxhash64("a", "b", "c", "d")})
    listed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w1"))
    grams = F.arrays_zip("w1", *(F.slice("w1", F.lit(k), F.size("w1")).alias(f"w{k}") for k in range(2, NOTICE_GRAM + 1)))
    positions = listed.select("row", "doc_id", F.posexplode_outer(grams).alias("pos", "g")).select("row", "doc_id", "pos", "g.*")
    positions = positions.toDF("row", "doc_id", "pos", "w1", "w2", "w3", "w4")
    same = (F.xxhash64("w1", "w2") == F.col("h2")) & (F.col("w1") == F.col("a")) & (F.col("w2") == F.col("b"))
    four = (F.xxhash64("w1", "w2", "w3", "w4") == F.col("h4")) & (F.col("w3") == F.col("c")) & (F.col("w4") == F.col("d"))
    voted = positions.join(F.broadcast(templates), same & (F.col("phrase") | four), "left")
    diagonals = voted.groupBy("row", "doc_id", "t", (F.col("pos") - F.col("p")).alias("diagonal")).agg(F.max("pos").alias("last"), F.min("pos").alias("first"), F.count(F.lit(1)).alias("votes"))
    names = templates.select("t", "label", "phrase", "grams").distinct()
    order = Window.partitionBy("row", "t").orderBy("diagonal")
    apart = F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > MERGE_GAP, F.lit(True))
    merged = diagonals.join(F.broadcast(names), "t", "left").withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("apart").over(order))
    spans = merged.groupBy("row", "doc_id", "t", "island", "label", "phrase", "grams").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    found = F.struct("label", F.col("first").cast("long").alias("first_word"), (F.col("last") - F.col("first") + F.when(F.col("phrase"), 2).otherwise(NOTICE_GRAM)).cast("long").alias("words"), F.round(share, 6).alias("share"))
    long_enough = F.when(F.col("phrase"), F.col("votes") == F.col("grams")).otherwise(F.col("votes") >= F.ceil(F.col("grams") * MIN_SHARE))
    return spans.groupBy("row", "doc_id").agg(
        (F.coalesce(F.max("last"), F.lit(-1)) + 1).cast("long").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("phrase") & long_enough, found))).alias("places"),
        F.sort_array(F.collect_list(F.when(~F.col("phrase") & long_enough, found))).alias("spans"),
        F.coalesce(F.max(F.when(~F.col("phrase"), F.round(share, 6))), F.lit(0.0)).alias("best_share"),
    ).drop("row")


def summary(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``scan`` found."""
    first = F.expr("transform(places, x -> x.first_word)")
    label = lambda c: F.expr(f"transform({c}, x -> x.label)")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(label("places"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(label("places"), label("spans")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.col("best_share")).alias("score"),
    )


def duckdb_sql() -> str:
    """The same rows in DuckDB's SQL."""
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    values = ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in template_rows())
    return f"""
WITH t(t, label, phrase, grams, p, a, b, c, d) AS (VALUES {values}),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, ws[i + 3] AS w4 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
v AS (SELECT doc_id, t.t, label, phrase, grams, pos - p AS diagonal, min(pos) AS f, max(pos) AS l, count(*) AS votes
      FROM g JOIN t ON w1 = a AND w2 = b AND (phrase OR (w3 = c AND w4 = d)) GROUP BY ALL),
m AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) > {MERGE_GAP}, true) THEN 1 ELSE 0 END AS apart FROM v),
n AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS island FROM m),
s AS (SELECT doc_id, t, label, phrase, grams, island, sum(votes) AS votes, min(f) AS f FROM n GROUP BY ALL),
k AS (SELECT *, round(least(votes / grams::DOUBLE, 1.0), 6) AS share, CASE WHEN phrase THEN votes = grams ELSE votes >= ceil(grams * {MIN_SHARE}) END AS ok FROM s),
r AS (SELECT doc_id, count(*) FILTER (phrase AND ok) AS n_base, min(f) FILTER (phrase AND ok) AS first_word, max(f) FILTER (phrase AND ok) AS last_word,
      list(DISTINCT label) FILTER (phrase AND ok) AS bl, list(DISTINCT label) FILTER (ok) AS al, max(share) FILTER (NOT phrase) AS best FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels, coalesce(array_to_string(list_sort(al), ','), '') AS labels,
       CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN r USING (doc_id)
"""
