"""Packing into optimal length buckets.

Documents are cut into pieces of at most ``max_len`` tokens. The global histogram of piece lengths, which has at most
``max_len`` rows whatever the corpus, goes to the driver, where a dynamic programme picks the bucket boundaries that
minimise padding. Inside each bucket, pieces are dealt to batches of a fixed token budget by their exact global
position, which is found in two steps (a count for each range of the order, then a rank inside the range). The order ends
in a salt, so that neither a bucket with most of the rows nor a doc_id that most of them share meets in one task; pieces
that only the salt tells apart are equal in all columns.

Defined results: a null or empty text is one piece that holds the end token only; repeated rows are packed as often as
they occur; a null doc_id sorts as the empty string; no documents give no pieces; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, table

MAX_LEN, BUCKETS, TOKEN_BUDGET, RANGE_ROWS = 2048, 8, 65536, 100_000


def word_tokens(text: Column) -> Column:
    """Words of the text and one end token."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long") + 1


def pieces(docs: DataFrame, n_tokens: Column, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, piece, start_token, n_tokens: each document in pieces of ``max_len`` tokens, the last one shorter."""
    last = F.ceil(F.col("total") / max_len) - 1
    return (
        docs.select("doc_id", n_tokens.cast("long").alias("total"))
        .select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * max_len).alias("start_token"), F.least(F.lit(max_len).cast("long"), F.col("total") - F.col("piece") * max_len).alias("n_tokens"))
    )


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The ``buckets`` upper lengths of least total padding (ties: the smaller lower boundary), for sorted lengths."""
    if not lengths:
        return []
    size = np.asarray(lengths, dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    tokens = np.concatenate([[0], np.cumsum(size * np.asarray(counts, dtype=np.int64))])
    n = len(size)
    buckets = min(buckets, n)
    # best[j]: least padding of the j shortest lengths in k buckets; came[k][j]: where the last of them starts
    best = np.concatenate([[0], size * rows[1:] - tokens[1:]])
    came = [np.zeros(n + 1, dtype=np.int64)]
    for k in range(2, buckets + 1):
        now, at = best.copy(), np.zeros(n + 1, dtype=np.int64)
        for j in range(k, n + 1):
            i = np.arange(k - 1, j)
            cost = best[i] + size[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            pick = int(np.argmin(cost))
            now[j], at[j] = cost[pick], i[pick]
        best = now
        came.append(at)
    out, j = [], n
    for at in reversed(came):
        out.append(int(size[j - 1]))
        j = int(at[j])
    return out[::-1]


def pack(docs: DataFrame, n_tokens: Column, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, piece, start_token, n_tokens, bucket, padded_len, batch, slot: one row for each piece.

    Batches are numbered from 0 inside a bucket; every batch but the last of a bucket holds
    floor(token_budget / padded_len) pieces, in the order of the md5 of doc_id (a fixed shuffle), doc_id, piece.
    """
    if token_budget < max_len:
        raise ValueError("a batch must hold a piece of max_len tokens")
    cutted = cut(pieces(docs, n_tokens, max_len).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())))
    histogram = sorted((r["n_tokens"], r["count"]) for r in cutted.groupBy("n_tokens").count().collect())
    total = sum(n for _, n in histogram)
    upper = boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    ranges = max(1, math.ceil(total / RANGE_ROWS))
    bucket, padded = F.lit(len(upper) - 1), F.lit(upper[-1] if upper else max_len).cast("long")
    for i in range(len(upper) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= upper[i], i).otherwise(bucket)
        padded = F.when(F.col("n_tokens") <= upper[i], F.lit(upper[i]).cast("long")).otherwise(padded)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    order = ["_key", "doc_id", "piece", "n_tokens", "_salt"]
    placed = cutted.select("*", bucket.cast("int").alias("bucket"), padded.alias("padded_len"), key.alias("_key"))
    # written, so that the ranges, which Spark takes from a sample, stay the same in all that follows
    ranged = cut(placed.repartitionByRange(ranges, "bucket", *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("bucket", "_range").agg(F.count("*").alias("_n"))
    before = sizes.select("bucket", "_range", (F.sum("_n").over(Window.partitionBy("bucket").orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "_range").orderBy(*order))
    position, room = F.col("_before") + F.col("_rank") - 1, F.floor(F.lit(token_budget) / F.col("padded_len"))
    return (
        ranged.withColumn("_rank", rank)
        .join(before, ["bucket", "_range"])
        .select("doc_id", "piece", "start_token", "n_tokens", "bucket", "padded_len", F.floor(position / room).alias("batch"), (position % room).alias("slot"))
    )


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokens(F.col("text")))


OP1_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, 1 + coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS total FROM documents
), p AS (
  SELECT doc_id, piece, piece * {MAX_LEN} AS start_token, least({MAX_LEN}, total - piece * {MAX_LEN}) AS n_tokens
  FROM (SELECT doc_id, total, unnest(range(0, CAST(ceil(total / {MAX_LEN}) AS BIGINT))) AS piece FROM d)
), h AS (
  SELECT n_tokens AS len, row_number() OVER (ORDER BY n_tokens) AS j, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS rows_to,
         CAST(sum(sum(n_tokens)) OVER (ORDER BY n_tokens) AS BIGINT) AS tokens_to
  FROM p GROUP BY n_tokens
), f AS (
  SELECT 1 AS k, j, rows_to, tokens_to, struct_pack(cost := len * rows_to - tokens_to, i := CAST(0 AS BIGINT), path := [len]) AS best FROM h
  UNION ALL
  SELECT f.k + 1, h.j, any_value(h.rows_to), any_value(h.tokens_to),
         min(struct_pack(cost := f.best.cost + h.len * (h.rows_to - f.rows_to) - (h.tokens_to - f.tokens_to), i := f.j, path := list_append(f.best.path, h.len)))
  FROM f JOIN h ON h.j > f.j WHERE f.k < {BUCKETS} GROUP BY f.k, h.j
), chosen AS (
  SELECT best.path AS path FROM f WHERE j = (SELECT max(j) FROM h) ORDER BY k DESC LIMIT 1
), u AS (SELECT unnest(path) AS padded_len, unnest(range(0, len(path))) AS bucket FROM chosen),
q AS (
  SELECT p.*, (SELECT min(padded_len) FROM u WHERE padded_len >= p.n_tokens) AS padded_len FROM p
), r AS (
  SELECT q.*, u.bucket, row_number() OVER (PARTITION BY u.bucket ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, piece, n_tokens) - 1 AS pos,
         {TOKEN_BUDGET} // q.padded_len AS room
  FROM q JOIN u USING (padded_len)
)
SELECT doc_id, piece, start_token, n_tokens, CAST(bucket AS INTEGER) AS bucket, padded_len, pos // room AS batch, pos % room AS slot FROM r
"""
