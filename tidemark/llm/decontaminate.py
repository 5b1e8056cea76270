"""Benchmark decontamination by greedy string tiling.

Words are lower case without marks at their ends. All runs of ``min_match`` words of the benchmark items (of the whole item
if it is shorter) are a table of seeds, by two running Karp-Rabin hashes of 64 bits each. A pass over the documents
keeps the places whose hash is in a bit map of the seeds, of bounded size whatever the benchmark's; these places are joined
with the seed table. For each pair of a text and an item whose common seeds could cover enough of the item, tiles are
marked: the longest common run of words of which none is marked yet, in both texts, again and again until none of
``min_match`` words is left. Tiles may stand in any order, so passages whose sentences have been reordered are found. A
document is contaminated if the tiles cover at least ``coverage`` of an item's words.

Pairs come from an item's rarer seeds only: if L words must be covered, at least L / min_match seeds are common, so the
L / min_match - 1 seeds of an item that most texts hold can't be the only ones, and phrases that stand in many texts and
many items make no pairs. Equal texts are judged once, by two 64-bit hashes of the text.

Defined results: items without words match nothing; an item of fewer than ``min_match`` words must stand whole; items with a
null item_id take part and come after the others of equal coverage; a null or empty text is clean; repeated rows are
judged each; an empty benchmark leaves all documents clean; an empty table gives no rows. A text and an item that repeat
one run have |text| x |item| common places, which are held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_name, table

MIN_MATCH, COVERAGE, SLICE_BYTES, MOST_BITS, BROADCAST_ROWS = 5, 0.8, 4 << 20, 1 << 27, 100_000
MARKS = b".,;:!?\"'()[]{}*#$%&|"
#: Multipliers of the two running hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
KEYS = ["seed", "seed2"]


class _Bare(dict):
    """Hashes of words without marks at their ends; 0 where nothing is left."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(MARKS)
        self[word] = h = (xxhash.xxh64_intdigest(bare) or 1) if bare else 0
        return h


def rolling(ids: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all runs of ``size`` numbers; other sizes give other hashes."""
    out = np.full(max(0, len(ids) - size + 1), size, dtype=np.uint64)
    for j in range(size if len(out) else 0):
        out = out * np.uint64(base) + ids[j : len(ids) - size + 1 + j].astype(np.uint64)
    return out ^ (out >> np.uint64(29))


def tiles(i: np.ndarray, j: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(place in the text, place in the item, words): longest first, then by place; i, j: common runs of ``size`` words."""
    out: list[tuple[int, int, int]] = []
    used_i, used_j = np.zeros(int(i.max(initial=0)) + size, dtype=bool), np.zeros(int(j.max(initial=0)) + size, dtype=bool)
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    while len(i):
        first = np.flatnonzero(np.concatenate([[True], (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)]))
        length = np.diff(np.append(first, len(i)))
        best = int(length.max())
        words, starts = best + size - 1, first[length == best]
        starts = starts[np.lexsort((j[starts], i[starts]))]
        for a, b in zip(i[starts].tolist(), j[starts].tolist()):
            if not used_i[a : a + words].any() and not used_j[b : b + words].any():
                used_i[a : a + words] = used_j[b : b + words] = True
                out.append((a, b, words))
        before_i, before_j = (np.concatenate([[0], np.cumsum(u)]) for u in (used_i, used_j))
        free = (before_i[i + size] == before_i[i]) & (before_j[j + size] == before_j[j])
        i, j = i[free], j[free]
    return out


def _slices(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The number of the first row, and texts of bounded size together."""
    texts, size, first = [], 0, 0
    for k, t in enumerate(b.column("text").cast(pa.binary())):
        texts.append(t.as_py() or b"")
        size += len(texts[-1])
        if size >= SLICE_BYTES or k + 1 == b.num_rows:
            yield first, texts
            texts, size, first = [], 0, k + 1


def _words(texts: list[bytes], hashes: _Bare) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's begin."""
    if len(hashes) > 1 << 20:
        hashes.clear()
    split = [t.lower().split() for t in texts]
    found = np.fromiter((hashes[w] for x in split for w in x), dtype=np.uint64, count=sum(map(len, split)))
    edges = np.cumsum([0, *map(len, split)])
    word = found != 0
    return found[word], np.concatenate([[0], np.cumsum(word)])[edges]


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id (the smallest one of equal items), words (hashes), of the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _slices(b):
                h, edges = _words(texts, _Bare())
                words = [h[a:z].view(np.int64) for a, z in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([b.column("item_id").slice(first, len(texts)), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, words array<long>")
    return cut(rows.where(F.size("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id")).select(F.monotonically_increasing_id().alias("item"), "item_id", "words"))


def seeds_of(items: DataFrame, min_match: int) -> DataFrame:
    """item, j, size, seed, seed2: all runs of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, words in zip(b.column("item").to_pylist(), b.column("words").to_pylist()):
                h, size = np.array(words, dtype=np.int64).view(np.uint64), min(min_match, len(words))
                codes = [rolling(h, size, base).view(np.int64) for base in BASES]
                n = len(codes[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, item)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, size, dtype=np.int32)), *map(pa.array, codes)], ["item", "j", "size", *KEYS])

    return items.select("item", "words").mapInArrow(run, "item long, j int, size int, seed long, seed2 long")


def bit_map(seeds: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """Words of a bit map, at most ``most`` bits, of the seeds modulo its size."""
    bits = min(most, max(1 << 12, 1 << (64 * seeds.count()).bit_length()))
    at = F.pmod("seed", F.lit(bits))
    rows = seeds.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(seed, {bits}) % 64 as int))")).alias("x")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("x").to_numpy()
    return out.view(np.uint64)


def _text_keys() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def found_in(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """t1, t2 (hashes of a contaminated text) and item_id, coverage, n_tiles of the item that it covers most."""
    items = items_of(benchmark)
    seeds = cut(seeds_of(items, min_match))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())
    known = bit_map(seeds)
    bits = np.uint64(64 * len(known) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Bare()
        for b in batches:
            for first, texts in _slices(b):
                h, edges = _words(texts, hashes)
                for size in sizes:
                    code = rolling(h, size)
                    at = np.flatnonzero(known[(code & bits) >> np.uint64(6)] >> (code & np.uint64(63)) & np.uint64(1))
                    if not len(at):
                        continue
                    owner = np.searchsorted(edges, at, side="right") - 1
                    inside = at + size <= edges[owner + 1]
                    at, owner = at[inside], owner[inside]
                    code2 = np.full(len(at), size, dtype=np.uint64)
                    for j in range(size):
                        code2 = code2 * np.uint64(BASES[1]) + h[at + j]
                    code2 ^= code2 >> np.uint64(29)
                    rows = pa.array(first + owner)
                    yield pa.RecordBatch.from_arrays([b.column("t1").take(rows), b.column("t2").take(rows), pa.array((at - edges[owner]).astype(np.int32)), pa.array(code[at].view(np.int64)), pa.array(code2.view(np.int64))], ["t1", "t2", "i", *KEYS])

    text = ["t1", "t2"]
    hits = cut(docs.select("text", *_text_keys()).where("text is not null").mapInArrow(run, "t1 long, t2 long, i int, seed long, seed2 long").distinct().join(seeds.select(*KEYS).distinct(), KEYS, "left_semi"))
    # the seeds of an item that most texts hold are left out, as many as can't be all that are common
    must = F.ceil(coverage * F.size("words") - 1e-9).cast("int")
    whole = items.select("item", "item_id", F.size("words").alias("n_words"), must.alias("must"))
    often = hits.groupBy(*KEYS).agg(F.count("*").alias("texts"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("texts"), "j"))
    rare = seeds.join(often, KEYS).join(whole, "item").withColumn("rank", rank).where(F.col("rank") > F.ceil(F.col("must") / F.col("size")) - 1).select("item", *KEYS).distinct()
    pairs = hits.select(*text, *KEYS).distinct().join(rare, KEYS).select(*text, "item").distinct()
    common = hits.join(pairs, text).join(seeds, ["item", *KEYS]).groupBy(*text, "item", "size").agg(F.collect_list(F.struct("i", "j")).alias("hits"))
    common = common.join(whole, "item").where(F.size(F.array_distinct("hits.j")) * F.col("size") >= F.col("must"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, (size, must, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("size", "must", "n_words")))):
                both = b.column("hits")[k].values
                marked = tiles(both.field("i").to_numpy().astype(np.int64), both.field("j").to_numpy().astype(np.int64), size)
                covered = sum(x for _, _, x in marked)
                if covered >= must:
                    out.append((k, covered / n, len(marked)))
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in (*text, "item_id")), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int32())], [*text, "item_id", "coverage", "n_tiles"])

    tiled = common.select(*text, "item_id", "size", "must", "n_words", "hits").mapInArrow(tile, "t1 long, t2 long, item_id long, coverage double, n_tiles int")
    best = tiled.groupBy(*text).agg(F.min(F.struct((-F.col("coverage")).alias("less"), F.col("item_id").isNull().alias("unnamed"), F.col("item_id").alias("item_id"), "n_tiles")).alias("b"))
    return cut(best.select(*text, "b.item_id", (-F.col("b.less")).alias("coverage"), "b.n_tiles"))


def _joined(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``found`` by the text; few texts are sent to all tasks, many are joined by a shuffle."""
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # 4 MB
    one, two = (free_name(docs, f"_{n}") for n in ("t1", "t2"))
    found = found.withColumnsRenamed({"t1": one, "t2": two})
    first, second = _text_keys()
    return docs.withColumns({one: first, two: second}).join(F.broadcast(found) if few else found, [one, two], how).drop(one, two)


def flag(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text and contaminated, item_id, coverage, n_tiles of the item that a document covers most (null where it is clean)."""
    found = found_in(docs, benchmark, min_match, coverage)
    out = _joined(docs.select("doc_id", "text"), found.withColumn("contaminated", F.lit(1)), "left")
    return out.select("doc_id", "text", F.coalesce("contaminated", F.lit(0)).alias("contaminated"), "item_id", "coverage", "n_tiles")


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    columns = docs.columns
    return _joined(docs, found_in(docs, benchmark, min_match, coverage).select("t1", "t2"), "left_anti").select(*columns)


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"))
