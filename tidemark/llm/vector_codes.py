"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Vectors are cut into equal consecutive parts, each with a codebook of its own. A codebook begins with the parts of the
vectors of smallest id and is refined by rounds of integer k-means. Every search for the nearest entry sorts the entries
by norm: since |p - e| >= ||p| - |e||, an entry can only be as near as the best one so far if its norm lies within that
distance of the part's own norm. The entries of nearest norm give a first best distance; a binary search gives the
interval of norms that it allows, ends included; entries inside this annulus are evaluated in whole numbers, from the middle
outwards in growing steps, and each step's best distance narrows the interval for the next.

A row is coded by itself, so no group of equal vectors or labels meets in one task. A round sends one row of sums for each
task, part and entry; the driver gets the entries of the new codebooks, whose number is bounded by ``entries``.

Defined results: vectors that are null or hold null or non-finite components are dropped; rows with a null id stay and count
as the largest ids; rows of one id are ordered by their vectors; repeated rows are coded each; fewer rows than entries give
smaller codebooks. Vectors of different lengths have codebooks of their own for each length; where a length is no multiple of the
number of parts, part i begins at component floor(i * length / parts). Rows with a null label are one label. An
empty table gives no rows. Other columns are ignored. Components, sums and errors must fit into 64 bits: larger ones
raise an error that says so, and nothing is rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
FIRST, PAIRS, SMALL_TABLE = 4, 1 << 18, 100_000
LIMIT = 1 << 62

#: For each length of vectors, each part's entries as (entries, width) whole numbers.
Codebooks = dict[int, list[np.ndarray]]


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    return [(i * length // parts, (i + 1) * length // parts) for i in range(parts)]


def _whole(x: np.ndarray) -> np.ndarray:
    """``x`` as int64, or an error where it doesn't fit: nothing is wrapped around."""
    if x.size and float(np.abs(x.astype(np.float64)).max()) >= LIMIT:
        raise OverflowError("vector codes: a component, sum or squared distance doesn't fit into 64 bits")
    return x.astype(np.int64)


class Annulus:
    """The entries of one codebook in the order of their norms."""

    def __init__(self, entries: np.ndarray):
        wide = entries.shape[1]
        most = int(np.abs(entries).max()) if entries.size else 0
        self.most = most
        self.entries = entries
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.lexsort((np.arange(len(entries)), norms))
        self.norms, self.wide = norms[self.order], wide
        self.sorted = entries[self.order]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry (ties: the lower), its squared distance, and the number of distances evaluated."""
        m, k = len(rows), len(self.entries)
        reach = 2 * max(self.most, int(np.abs(rows).max()) if rows.size else 0)
        if reach * reach * max(1, self.wide) >= LIMIT:
            raise OverflowError("vector codes: a component, sum or squared distance doesn't fit into 64 bits")
        kind = np.int32 if reach * reach * max(1, self.wide) < 1 << 31 else np.int64
        entries, small = self.sorted.astype(kind), rows.astype(kind)
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        code, far = np.full(m, k, dtype=np.int64), np.full(m, np.iinfo(np.int64).max)
        left = np.clip(np.searchsorted(self.norms, norm) - FIRST // 2, 0, max(0, k - FIRST))
        right, low, high = left.copy(), np.zeros(m, dtype=np.int64), np.full(m, k)
        open_, step, tried = np.arange(m), FIRST, 0
        while len(open_):
            # left and right of what has been evaluated, as far as the current best distance allows
            to_left, to_right = np.maximum(low[open_], left[open_] - (step if tried else 0)), np.minimum(high[open_], right[open_] + step)
            for begin, end in ((to_left, left[open_]), (right[open_], to_right)):
                tried += self._evaluate(small, entries, open_, begin, end, code, far)
            left[open_], right[open_] = np.minimum(to_left, left[open_]), np.maximum(to_right, right[open_])
            radius = np.sqrt(far[open_].astype(np.float64))
            slack = 1e-9 * (norm[open_] + radius + 1)  # more than any rounding of the norms: the ends are inside
            low[open_] = np.searchsorted(self.norms, norm[open_] - radius - slack, "left")
            high[open_] = np.searchsorted(self.norms, norm[open_] + radius + slack, "right")
            open_ = open_[(low[open_] < left[open_]) | (high[open_] > right[open_])]
            step *= 2
        return code, far, tried

    def _evaluate(self, rows: np.ndarray, entries: np.ndarray, which: np.ndarray, begin: np.ndarray, end: np.ndarray, code: np.ndarray, far: np.ndarray) -> int:
        """Takes the entries from place ``begin`` to ``end`` of each row of ``which`` into ``code`` and ``far``; the number of distances."""
        some = end > begin
        which, begin, spans = which[some], begin[some], (end - begin)[some]
        ends = np.cumsum(spans)
        for a, b in batched(ends, PAIRS):
            n, own = spans[a:b], which[a:b]
            starts = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(starts, n) + np.repeat(begin[a:b], n)
            gap = np.repeat(rows[own], n, axis=0)
            gap -= entries[at]
            d = np.einsum("ij,ij->i", gap, gap)
            least = np.minimum.reduceat(d, starts)
            index = np.minimum.reduceat(np.where(d == np.repeat(least, n), self.order[at], len(self.order)), starts)
            code[own] = np.where(least < far[own], index, np.where(least == far[own], np.minimum(index, code[own]), code[own]))
            far[own] = np.minimum(least, far[own])
        return int(ends[-1]) if len(ends) else 0


def batched(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` pairs each; ``ends`` are running sums of the rows' pairs."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def usable(vector_col: str):
    """A vector without null or non-finite components."""
    return F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _groups(column: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and whole components of the vectors of each length."""
    starts = column.offsets.to_numpy()
    flat = _whole(np.floor(column.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale))
    sizes = np.diff(starts)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


def _first_codebooks(kept: DataFrame, entries: int, parts: int, scale: int) -> Codebooks:
    """Parts of the vectors of smallest id, for each length."""
    lengths = [r["d"] for r in kept.select(F.size("v").alias("d")).distinct().collect()]
    out = {}
    for d in sorted(lengths):
        first = kept.where(F.size("v") == d).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        rows = _whole(np.floor(np.array([r["v"] for r in first], dtype=np.float64).reshape(len(first), d) * scale))
        out[d] = [rows[:, a:b] for a, b in bounds(d, parts)]
    return out


def _sums(books: Codebooks, parts: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The number and sum of the vectors' parts for each entry, once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = {d: [Annulus(e) for e in book] for d, book in books.items()}
        count = {d: [np.zeros(len(e), dtype=np.int64) for e in book] for d, book in books.items()}
        total = {d: [np.zeros(e.shape, dtype=np.int64) for e in book] for d, book in books.items()}
        for b in batches:
            for d, rows, v in _groups(b.column("v"), scale):
                for p, (lo, hi) in enumerate(bounds(d, parts)):
                    part = np.ascontiguousarray(v[:, lo:hi])
                    code, _, _ = search[d][p].nearest(part)
                    order = np.argsort(code, kind="stable")
                    used, at, n = np.unique(code[order], return_index=True, return_counts=True)
                    if part.size and int(np.abs(part).max()) * (len(rows) + 1) >= LIMIT:
                        raise OverflowError("vector codes: a component, sum or squared distance doesn't fit into 64 bits")
                    count[d][p][used] += n
                    if hi > lo:
                        total[d][p][used] += np.add.reduceat(part[order], at, axis=0)
                        _whole(total[d][p])
        found = [(d, p, e, int(count[d][p][e]), total[d][p][e].tolist()) for d in books for p in range(parts) for e in np.flatnonzero(count[d][p]).tolist()]
        columns = list(zip(*found)) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["d", "part", "entry", "n", "total"])

    return run


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of the vectors of ``kept`` (id, v)."""
    books = _first_codebooks(kept, entries, parts, scale)
    width = max((hi - lo for d in books for lo, hi in bounds(d, parts)), default=0)
    for _ in range(rounds if books else 0):
        sums = kept.select("v").mapInArrow(_sums(books, parts, scale), "d int, part int, entry int, n long, total array<long>")
        # sums of 64 bits: larger ones are an error of Spark's
        new = sums.groupBy("d", "part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"_{i}") for i in range(width)])
        books = {d: [e.copy() for e in book] for d, book in books.items()}
        for r in new.collect():  # at most ``entries`` rows for each part and length
            e = books[r["d"]][r["part"]]
            e[r["entry"]] = [r[f"_{i}"] // r["n"] for i in range(e.shape[1])]
    return books


def encode(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """id, label, code (two hex digits for each part), error, and codebooks_sha256 of the row's codebooks."""
    kept = vectors.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    books = train(kept.select("id", "v"), parts, entries, rounds, scale)
    mark = {d: hashlib.sha256(",".join(str(x) for e in book for x in e.ravel().tolist()).encode()).hexdigest() for d, book in books.items()}
    types = {f.name: f.dataType.simpleString() for f in kept.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = {d: [Annulus(e) for e in book] for d, book in books.items()}
        for b in batches:
            codes, error, marks = np.zeros((b.num_rows, parts), dtype=np.uint8 if entries <= 256 else ">u2"), np.zeros(b.num_rows, dtype=np.int64), np.empty(b.num_rows, dtype=object)
            for d, rows, v in _groups(b.column("v"), scale):
                for p, (lo, hi) in enumerate(bounds(d, parts)):
                    code, far, _ = search[d][p].nearest(np.ascontiguousarray(v[:, lo:hi]))
                    codes[rows, p] = code
                    _whole(error[rows].astype(np.float64) + far)
                    error[rows] += far
                marks[rows] = mark[d]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error), pa.array(marks, pa.string())], ["id", "label", "code", "error", "codebooks_sha256"])

    return kept.mapInArrow(run, f"id {types['id']}, label {types['label']}, code string, error long, codebooks_sha256 string")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of error over the rows of its label (nulls are one label)."""
    coded = cut(coded)
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= SMALL_TABLE:
        sums = F.broadcast(sums)
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")


def op11_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = with_label_error(encode(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    near = """a{r} AS (
  SELECT row, part, p, arg_min(entry, dist * {k} + entry) AS entry, min(dist) AS dist FROM (
    SELECT s.row, s.part, s.p, c.entry, CAST(list_sum(list_transform(list_zip(s.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS dist FROM s JOIN c{r} AS c ON s.part = c.part
  ) GROUP BY row, part, p
)"""
    step = """m{r} AS (
  SELECT part, entry, list(v ORDER BY pos) AS p FROM (
    SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS v
    FROM (SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM a{r}) GROUP BY part, entry, pos
  ) GROUP BY part, entry
), c{n} AS (SELECT c.part, c.entry, coalesce(m.p, c.p) AS p FROM c{r} AS c LEFT JOIN m{r} AS m ON c.part = m.part AND c.entry = m.entry)"""
    rounds = ",\n".join(near.format(r=r, k=ENTRIES) + ",\n" + step.format(r=r, n=r + 1) for r in range(ROUNDS))
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT row, part, e[CAST(part * len(e) // {PARTS} AS BIGINT) + 1 : CAST((part + 1) * len(e) // {PARTS} AS BIGINT)] AS p FROM v, range({PARTS}) AS r(part)
), c0 AS (SELECT part, row AS entry, p FROM s WHERE row < {ENTRIES}),
{rounds},
{near.format(r=ROUNDS, k=ENTRIES)},
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM c{ROUNDS})),
o AS (SELECT row, lower(string_agg(printf('%02x', entry), '' ORDER BY part)) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row)
SELECT v.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM v JOIN o ON v.row = o.row CROSS JOIN h
"""


OP11_SQL = _sql()
