"""Substring deduplication by super-k-mer partitioning.

A window is 13 consecutive words of a document. Its minimiser is the smallest hash of its 3-word subsequences;
consecutive windows that share a minimiser form a super-k-mer and travel as one packed string to the bucket of that
minimiser, so equal windows always meet while each word is sent about three times instead of thirteen. Documents are
dealt to blocks of a few MB by a hash of doc_id; a block sends each distinct string once, with the smallest and the
largest doc_id that hold it, so a passage that a third of the corpus repeats costs a bucket one string a block. A
bucket compares the windows of strings whose minimiser occurs in more than one document, word for word, and answers
each block with the smallest doc_id of every window that some document of the block must give up. The block, dealt
out by the same shuffle, applies the answers to its documents.

A minimiser of common words would bring more strings than a bucket should hold. Such minimisers are looked for in a
share of the documents; their windows travel one by one, each to the bucket of its own hash, in all blocks alike. The
list only decides on the way, not on the result.

Defined results: a null or empty text has no words; texts shorter than a window lose none; rows with a null doc_id
are returned unchanged and are no one's earlier document; rows with equal doc_id don't affect each other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

WINDOW, SEED = 13, 3
BLOCK_BYTES, BUCKET_BYTES, LOOK_AT_ONE_IN = 4 << 20, 16 << 20, 64
_CODEC = "zstd"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Block:
    """The super-k-mers of a block of documents, the same whatever the order of its rows."""

    def __init__(self, docs: pa.Table, window: int, seed: int, buckets: int, heavy: np.ndarray | None = None):
        self.docs = docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = ids = docs.column("doc_id").combine_chunks()
        known = np.asarray(ids.is_valid())
        self.doc_ids = ids.fill_null(0).to_numpy()
        self.words: list[bytes] = []
        edge = [0]
        for t in docs.column("text").cast(pa.binary()).to_pylist():
            if t:
                self.words += t.split()
            edge.append(len(self.words))
        self.edge = np.array(edge)
        n = len(self.words)
        lens = np.fromiter(map(len, self.words), dtype=np.int64, count=n)
        self.at = np.concatenate([[0], np.cumsum(lens + 1)])
        self.text = b" ".join(self.words)
        self.strings: list[bytes] = []
        self.run_start = self.run_string = self.run_doc = np.zeros(0, dtype=np.int64)
        self.window = window
        owner = np.repeat(np.arange(len(known)), np.diff(self.edge))
        last = self.edge[1:][owner] - window
        valid = np.flatnonzero((np.arange(n) <= last) & known[owner]) if n else np.zeros(0, dtype=np.int64)
        if not len(valid):
            self.bucket = np.zeros(0, dtype=np.int64)
            self.mini = self.low = self.high = np.zeros(0, dtype=np.int64)
            return
        cache = _Hashes()
        h = np.fromiter(map(cache.__getitem__, self.words), dtype=np.uint64, count=n)
        g = np.zeros(n - seed + 1, dtype=np.uint64)
        for j in range(seed):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : n - seed + 1 + j]
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        span, low, step = window - seed + 1, g, 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[: len(g) - span + 1], low[span - step :][: len(g) - span + 1])
        mini = low[valid]
        new = np.concatenate([[True], (mini[1:] != mini[:-1]) | (np.diff(valid) != 1)])
        if heavy is not None and len(heavy):
            alone = np.isin(mini, heavy)
            own = np.zeros(int(alone.sum()), dtype=np.uint64)
            for j in range(window):
                own = own * np.uint64(0xD6E8FEB86659FD93) + h[valid[alone] + j]
            mini = mini.copy()
            mini[alone] = own ^ (own >> np.uint64(31))
            new |= alone
            new[1:] |= alone[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(valid)]]))
        start = valid[first]
        stop = start + size - 1 + window
        index: dict[bytes, int] = {}
        put, text = index.setdefault, self.text
        which = np.fromiter((put(text[a:b], len(index)) for a, b in zip(self.at[start].tolist(), (self.at[stop] - 1).tolist())), dtype=np.int64, count=len(start))
        self.strings = list(index)
        self.run_start, self.run_string, self.run_doc = start, which, self.doc_ids[owner[start]]
        m = len(self.strings)
        self.mini, self.low, self.high = np.zeros(m, dtype=np.uint64), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        self.mini[which] = mini[first]
        self.low[which[::-1]] = self.run_doc[::-1]  # documents are in order: the first occurrence is the smallest
        self.high[which] = self.run_doc
        self.bucket = (((self.mini * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets and the numbers of their strings, in order."""
        order = np.argsort(self.bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(self.bucket[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(self.bucket[part[0]]), part


def _packed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    head = np.array([a.nbytes for a in arrays] + [len(tail)], dtype=np.int64)
    raw = head.tobytes() + b"".join(a.tobytes() for a in arrays) + tail
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpacked(data: bytes, *kinds: str) -> list:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec=_CODEC, asbytes=True)
    head = np.frombuffer(raw, dtype=np.int64, count=len(kinds) + 1)
    out, at = [], head.nbytes
    for size, kind in zip(head.tolist(), kinds):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return [*out, raw[at:]]


def _judge(strings: list[bytes], mini: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(string's number, first window, windows, smallest doc_id) where that doc_id is below the string's largest one."""
    order = np.argsort(mini, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(mini[order])) + 1])
    shared = np.flatnonzero(np.minimum.reduceat(low[order], cuts) < np.maximum.reduceat(high[order], cuts))
    ends = np.concatenate([cuts[1:], [len(order)]])
    for g in shared.tolist():
        members = order[cuts[g] : ends[g]].tolist()
        least: dict[bytes, int] = {}
        for i in members:
            if (old := least.get(strings[i])) is None or low[i] < old:
                least[strings[i]] = int(low[i])
        if len(least) == 1:
            count = strings[members[0]].count(b" ") + 2 - window
            smallest = next(iter(least.values()))
            for i in members:
                if smallest < high[i]:
                    yield i, 0, count, smallest
            continue
        seen: dict[bytes, int] = {}
        spans: dict[bytes, list[bytes]] = {}
        for s, doc in least.items():
            words = s.split(b" ")
            spans[s] = keys = [b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]
            for key in keys:
                if (old := seen.get(key)) is None or doc < old:
                    seen[key] = doc
        runs: dict[bytes, list[tuple[int, int, int]]] = {}
        for i in members:
            s = strings[i]
            if s not in runs:
                smallest = np.array([seen[key] for key in spans[s]])
                at = np.concatenate([[0], np.flatnonzero(np.diff(smallest)) + 1, [len(smallest)]])
                runs[s] = [(int(a), int(b - a), int(smallest[a])) for a, b in zip(at[:-1], at[1:])]
            for first, count, smallest in runs[s]:
                if smallest < high[i]:
                    yield i, first, count, smallest


def heavy_minimisers(docs: DataFrame, window: int, seed: int, bucket_bytes: int, one_in: int) -> np.ndarray:
    """Minimisers whose strings would fill a bucket, by a share of the documents; at most total / bucket_bytes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                mini, n = np.unique(Block(pa.Table.from_batches([b.slice(i, 512)]), window, seed, 1).mini.astype(np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64)), pa.array(n)], ["mini", "n"])

    part = docs.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(one_in)) == 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = part.mapInArrow(run, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))
    least = max(2, math.ceil(bucket_bytes / (8 * window * one_in)))
    return np.sort(np.array([r["mini"] for r in sums.where(F.col("n") >= least).collect()], dtype=np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, one_in: int = LOOK_AT_ONE_IN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document without the words of windows that an earlier one holds."""
    heavy = heavy_minimisers(docs, window, seed, bucket_bytes, one_in)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(3 * total / bucket_bytes))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))

    def send(key: tuple, docs: pa.Table) -> pa.Table:
        block = Block(docs, window, seed, buckets, heavy)
        rows: tuple[list, list] = ([], [])
        for bucket, part in block.by_bucket():
            rows[0].append(bucket)
            low = block.low[part]
            rows[1].append(_packed((block.mini[part] >> np.uint64(32)).astype(np.uint32), np.diff(low, prepend=0), block.high[part] - low, tail=b"\n".join([block.strings[i] for i in part.tolist()])))
        return pa.table([pa.array(rows[0], pa.int32()), pa.array([key[0].as_py()] * len(rows[0]), pa.int32()), pa.array(rows[1], pa.binary())], ["bucket", "block", "load"])

    def judge(key: tuple, loads: pa.Table) -> pa.Table:
        strings, parts = [], ([], [], [])
        sizes = []
        for data in loads.column("load").to_pylist():
            mini, low, more, tail = _unpacked(data, "u4", "i8", "i8")
            low = np.cumsum(low)
            for to, x in zip(parts, (mini, low, low + more)):
                to.append(x)
            strings += tail.split(b"\n")
            sizes.append(len(mini))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        found = np.array(list(_judge(strings, *(np.concatenate(x) for x in parts), window)), dtype=np.int64).reshape(-1, 4)
        to = np.searchsorted(begins, found[:, 0], side="right") - 1
        names, answers = loads.column("block").to_pylist(), []
        order = np.argsort(to, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            if len(part):
                k, rows = int(to[part[0]]), found[part]
                answers.append((names[k], key[0].as_py(), _packed(np.ascontiguousarray((rows - [[begins[k], 0, 0, 0]]).T).ravel())))
        return pa.table([pa.array([a[0] for a in answers], pa.int32()), pa.array([a[1] for a in answers], pa.int32()), pa.array([a[2] for a in answers], pa.binary())], ["to_block", "from_bucket", "answer"])

    def apply(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs, window, seed, buckets, heavy)
        n = len(block.words)
        edge = np.zeros(n + 1, dtype=np.int64)
        if answers.num_rows:
            own, entries = dict(block.by_bucket()), []
            for bucket, data in zip(answers.column("from_bucket").to_pylist(), answers.column("answer").to_pylist()):
                rows = _unpacked(data, "i8")[0].reshape(4, -1).copy()
                rows[0] = own[bucket][rows[0]]
                entries.append(rows)
            string, first, count, smallest = np.concatenate(entries, axis=1)
            runs = np.argsort(block.run_string, kind="stable")
            sizes = np.bincount(block.run_string, minlength=len(block.strings))
            begins = np.concatenate([[0], np.cumsum(sizes)])
            times = sizes[string]
            entry = np.repeat(np.arange(len(string)), times)
            run = runs[np.repeat(begins[string] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(entry))]
            hit = block.run_doc[run] > smallest[entry]
            start = block.run_start[run[hit]] + first[entry[hit]]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + count[entry[hit]] - 1 + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[block.edge[1:]] - before[block.edge[:-1]]
        kept = []
        for k, (a, b) in enumerate(zip(block.edge[:-1].tolist(), block.edge[1:].tolist())):
            kept.append(b" ".join([w for w, g in zip(block.words[a:b], gone[a:b].tolist()) if not g]) if removed[k] else block.text[block.at[a] : block.at[b] - 1] if b > a else b"")
        return pa.table([block.ids, pa.array(np.diff(block.edge)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    sent = keyed.groupBy("block").applyInArrow(send, "bucket int, block int, load binary")
    answers = sent.groupBy("bucket").applyInArrow(judge, "to_block int, from_bucket int, answer binary")
    return keyed.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept_text string")


def op5_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM p),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM g JOIN m USING (g) WHERE first < doc_id),
x AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda v, k: NOT list_contains(coalesce(gone, []), k)), ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
