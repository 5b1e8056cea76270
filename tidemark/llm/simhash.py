"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint is cut into four segments of 16 bits. If two fingerprints differ in at most three bits, then some
segment is equal while the segment after it (cyclically) differs in at most one bit: with exactly one equal segment
the other three hold one error each, and with two or more equal ones an error-free or single-error follower always
exists. Keys are therefore (equal segment, code key of the follower). Segments, padded to 23 bits, are decoded with
the perfect binary Golay code: words at distance one from each other share a codeword that is the nearest one of the
first and within distance four of the second, so the first is stored under one codeword and the second looks under
one or six. Joined candidates are verified by the number of differing bits, and links become components.

Equal fingerprints are merged before the join, so groups of exact copies cost one row.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; fewer than three words
are one shingle; repeated rows share a class; a null doc_id takes part and is never a class id unless alone; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.graph import components

SHINGLE, MAX_BITS = 3, 3
#: Generator polynomial of the (23, 12) code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, unsigned, of the XXH64 (seed 42) of word shingles in lower case (A-Z only)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    one = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(one[a:b], 42) for a, b in zip(starts.tolist(), stops)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


@cache
def code_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment: the message of the nearest codeword, and the messages within distance four (-1 fills)."""

    def encode(message: int) -> int:
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        return message << 11 | rest

    words = np.array([encode(m) for m in range(4096)], dtype=np.int64)
    parity = words & 2047
    errors = [sum(1 << i for i in e) for r in range(4) for e in _choose(23, r)]
    leader = np.zeros(2048, dtype=np.int64)
    for e in errors:
        leader[(e & 2047) ^ parity[e >> 11]] = e
    others: dict[int, list[int]] = {}
    light = [int(w) for w in words if int(w).bit_count() == 7]
    for e in errors:
        if e.bit_count() == 3:
            others[e] = [w for w in light if w & e == e]
    segment = np.arange(1 << 16, dtype=np.int64)
    error = leader[(segment & 2047) ^ parity[segment >> 11]]
    nearest = (segment ^ error) >> 11
    near = np.full((1 << 16, 6), -1, dtype=np.int64)
    near[:, 0] = nearest
    table = np.full((1 << 23, 5), 0, dtype=np.int16)
    for e, ws in others.items():
        table[e] = [w >> 11 for w in ws]
    at = np.flatnonzero(np.bitwise_count(error) == 3)
    near[at, 1:] = nearest[at, None] ^ table[error[at]]
    return nearest, near


def _choose(n: int, r: int, start: int = 0) -> Iterator[tuple[int, ...]]:
    if r == 0:
        yield ()
        return
    for i in range(start, n):
        for rest in _choose(n, r - 1, i + 1):
            yield (i, *rest)


def _keys(fps: np.ndarray, probing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys (which pair of segments, the equal segment, a codeword's message) and the rows they belong to."""
    nearest, near = code_keys()
    fps = fps.view(np.uint64)
    segments = [((fps >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    keys, rows = [], []
    for i in range(4):
        base, follower = (np.int64(i) << np.int64(28)) | (segments[i] << np.int64(12)), segments[(i + 1) % 4]
        if probing:
            found = near[follower]
            at, which = np.nonzero(found >= 0)
            keys.append(base[at] | found[at, which])
            rows.append(at)
        else:
            keys.append(base | nearest[follower])
            rows.append(np.arange(len(fps)))
    return np.concatenate(keys), np.concatenate(rows)


def links(fps: DataFrame) -> DataFrame:
    """a, b: pairs of different fingerprints of ``fps`` (distinct fp) with at most three differing bits, each pair once."""

    def keyed(probing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp = b.column("fp").to_numpy(zero_copy_only=False)
                key, row = _keys(fp, probing)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

        return run

    stored = fps.select("fp").mapInArrow(keyed(False), "key long, fp long").withColumnRenamed("fp", "a")
    asked = fps.select("fp").mapInArrow(keyed(True), "key long, fp long").withColumnRenamed("fp", "b")
    near = stored.join(asked, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id, component_size, for every row of ``docs``."""
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    labelled = distinct.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    whole = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    classes = labelled.select("fp", "root").join(whole, "root").select("fp", "component_id", "component_size")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "component_size")


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
