"""License scans by an exact set-similarity join, in DataFrame operations only.

Template notices and the text blocks of documents (sentences and paragraphs) are sets of words. The words of the
templates are ordered by their count over all documents, rarest first. A block can hold a share of at least
``threshold`` of a template's words only if it holds one of the |T| - o + 1 rarest of them (o = ceil(threshold |T|)):
blocks are joined with the index of these prefixes, pairs are pruned by length (template words in the block >= o) and
by position (what can still match after the common word), and the rest is verified by the intersection of the sets.
Only the template table, which is a parameter and not data, is broadcast or collected.

Besides, places where a phrase's words stand consecutively are counted over whole texts.

Defined results: a null text is the empty one; an empty text has no words and no labels; repeated rows are reported
each; rows with equal or null doc_id are told apart by their text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import table

THRESHOLD = 0.9
#: Phrases of the contract and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Notices of public licenses, lower case, words only.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
NOT_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between blocks: white space after the end of a sentence (the stop of "v. 2.0" ends none), and blank lines.
BLOCK_END, BLANK_LINE = r"((?<![^A-Za-z0-9][Vv])[.!?]|[.!?](?![\x20\x09-\x0D]+[0-9]))[\x20\x09-\x0D]+", r"\n[\x20\x09-\x0D]*\n"


def _alone(words: str) -> str:
    """A pattern for words that stand alone, in any case."""
    return rf"(?i)(?<![^{NOT_WORD}])(?:{words})(?![^{NOT_WORD}])"


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _words(text: Column) -> Column:
    return F.filter(F.split(_lower(text), rf"[{NOT_WORD}]+"), lambda w: w != "")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rows(spark: SparkSession, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def phrase_places(text: Column, phrases: list[tuple[str, str]]) -> list[Column]:
    """n_words, n_base, first_word, last_word, base (labels) of a text that isn't null."""
    n_words = F.regexp_count(text, F.lit(rf"[^{NOT_WORD}]+")).cast("long")
    any_phrase = _alone("|".join(rf"[{NOT_WORD}]+".join(p.split()) for p, _ in phrases))
    plain = F.when(text.rlike(any_phrase), F.regexp_replace(_lower(F.concat(F.lit(" "), text, F.lit(" "))), rf"[{NOT_WORD}]+", " "))
    counts = [F.regexp_count(plain, F.lit(f" {p}(?= )")) for p, _ in phrases]
    firsts = [F.when(plain.contains(f" {p} "), _spaces(F.substring_index(plain, f" {p} ", 1))) for p, _ in phrases]
    lasts = [F.when(plain.contains(f" {p} "), n_words - len(p.split()) - _spaces(F.substring_index(plain, f" {p} ", -1))) for p, _ in phrases]
    labels = F.array_compact(F.array(*[F.when(plain.contains(f" {p} "), label) for p, label in phrases]))
    most = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    return [n_words.alias("n_words"), F.coalesce(reduce(lambda a, b: a + b, counts), F.lit(0)).cast("long").alias("n_base"), most(F.least, firsts).cast("long").alias("first_word"), most(F.greatest, lasts).cast("long").alias("last_word"), labels.alias("base")]


def template_blocks(docs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """doc_id, h, label, score: the best share of a template's words that one block holds, of those that reach the threshold.

    ``docs`` has doc_id, h and text (not null).
    """
    spark = docs.sparkSession
    sets = [sorted(set(t.split())) for _, t in templates]
    known = sorted({w for s in sets for w in s})
    counted = docs.select(F.explode(_words(F.col("text"))).alias("word")).where(F.col("word").isin(known)).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in counted.collect()}
    rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}
    ordered = [sorted(rank[w] for w in s) for s in sets]
    least = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    prefixes = [(r, t, i, len(s), least[t]) for t, s in enumerate(ordered) for i, r in enumerate(s[: len(s) - least[t] + 1])]
    word_of = {r: w for w, r in rank.items()}
    index = _rows(spark, [F.struct(*[F.lit(x).alias(n) for n, x in zip(("word", "t", "i", "size", "least"), p)]) for p in prefixes])
    full = _rows(spark, [F.struct(F.lit(t).alias("t"), F.lit(templates[t][0]).alias("label"), F.array(*map(F.lit, s)).alias("words")) for t, s in enumerate(ordered)])
    rare = _alone("|".join(sorted({re.escape(word_of[p[0]]) for p in prefixes})))
    ranks = F.create_map(*[F.lit(x) for w in known for x in (w, rank[w])])

    marked = F.regexp_replace(F.regexp_replace(F.col("text"), BLOCK_END, "$1\x01"), BLANK_LINE, "\x01")
    blocks = docs.where(F.col("text").rlike(rare)).select("doc_id", "h", F.posexplode(F.split(marked, "\x01")).alias("block", "text")).where(F.col("text").rlike(rare))
    own = F.array_sort(F.array_compact(F.array_distinct(F.transform(F.filter(_words(F.col("text")), lambda w: w.isin(known)), lambda w: ranks[w]))))
    held = blocks.select("doc_id", "h", "block", own.alias("own"))
    probed = held.select("*", F.posexplode("own").alias("j", "word"))
    close = (
        probed.join(F.broadcast(index), "word")
        .where((F.size("own") >= F.col("least")) & (1 + F.least(F.col("size") - F.col("i"), F.size("own") - F.col("j")) - 1 >= F.col("least")))
        .select("doc_id", "h", "block", "own", "t", "least")
        .distinct()
    )
    shared = F.size(F.array_intersect("own", "words"))
    return (
        close.join(F.broadcast(full), "t")
        .where(shared >= F.col("least"))
        .groupBy("doc_id", "h", "label")
        .agg(F.max(shared / F.size("words")).alias("score"))
    )


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    base = texts.select("doc_id", "h", *phrase_places(F.col("text"), phrases))
    found = template_blocks(texts, templates, threshold).groupBy("doc_id", "h").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "found", "score")
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", names(F.col("base")).alias("base_labels"),
        names(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op4_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = " UNION ALL ".join(f"SELECT r, i - 1 AS i, {len(p.split())} AS n, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in PHRASES)
    templates = ", ".join(f"({t}, '{label}', {sorted(set(x.split()))!r})" for t, (label, x) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{words}') AS w FROM documents
), p AS ({places}),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM p GROUP BY r),
t AS (SELECT * FROM (VALUES {templates}) AS v(t, label, words)),
k AS (
  SELECT r, list_distinct(regexp_extract_all(translate(block, '{UPPER}', '{LOWER}'), '{words}')) AS own
  FROM (SELECT r, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([^A-Za-z0-9][Vv])[.!?]([\x20\x09-\x0D]+[0-9])', '\1' || chr(2) || '\2', 'g'), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), '\n[\x20\x09-\x0D]*\n', chr(1), 'g'), chr(1))) AS block FROM d)
),
m AS (SELECT r, label, len(list_intersect(own, words)) / len(words) AS score FROM k, t WHERE len(list_intersect(own, words)) >= ceil({THRESHOLD} * len(words) - 1e-9)),
f AS (SELECT r, list(DISTINCT label) AS found, max(score) AS score FROM m GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(f.score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""


OP4_SQL = _sql()
