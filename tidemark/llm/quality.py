"""Quality scores by co-training of a text view and a page view.

The text view sees hashed byte trigrams of the whole text. The page view sees what a crawler keeps about a page and
its layout: source, language, length, lines, and shares of kinds of characters and of repeated words. Both are
logistic models fitted in numpy. In each round, either view labels the documents of an unlabelled pool of which it is
most confident, and they join the other view's training rows. At last both views are calibrated and combined on
labelled rows that neither has been trained on, with the classes weighted to their share of all labels.

The fit is on bounded samples, taken by a hash of doc_id whatever the size of the table: ``most`` labelled documents
of each class and ``pool`` unlabelled ones; of several rows of one doc_id the smallest by text is learnt from. The scores
are of all documents. The driver holds the sample of the text view in half precision and standardises only the rows of a fit.

Defined results: a null or empty text is scored as a text without trigrams; null source or language are values of
their own; several labels of one document count as the smallest; without labels of both classes every document gets
the share of good labels (1 without any) and so stays; repeated rows are scored each; an empty table gives no rows;
other columns are passed on untouched.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, table
from tidemark.llm.toxicity import _platt

TEXT_DIM, SOURCE_DIM, LANG_DIM, STATS = 2048, 32, 8, 14
MOST, POOL, ROUNDS, EXCHANGED = 2000, 4000, 4, 200
KEEP_FROM = 0.5
#: Columns and rows that are taken to single precision together.
COLUMNS, ROWS = 256, 512
PAGE_DIM = STATS + SOURCE_DIM + LANG_DIM
#: Kinds of bytes: lower, upper, digit, blank, line feed, full stop or comma, other mark, beyond ASCII.
_KIND = np.full(256, 6, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9, 11, 12, 13]], _KIND[10], _KIND[[44, 46]], _KIND[128:] = 0, 1, 2, 3, 4, 5, 7


def text_view(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(TEXT_DIM, dtype=np.float32)
    code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
    x = np.sqrt(np.bincount(code >> np.uint32(21), minlength=TEXT_DIM).astype(np.float32))
    return x / np.sqrt((x * x).sum())


def _slot(value: str | None, size: int) -> int:
    return xxhash.xxh64_intdigest("\0" if value is None else value) % size


def page_view(text: bytes, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(PAGE_DIM, dtype=np.float32)
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=8)
    words = text.split()
    counts = Counter(words)
    size, lines = max(1, len(text)), int(kinds[4]) + 1
    x[:8] = kinds / size
    x[8] = np.log1p(len(text) if n_chars is None else max(0, n_chars)) / 10
    x[9], x[10] = np.log1p(lines) / 5, np.log1p(size / lines) / 10
    x[11] = len(counts) / max(1, len(words)) ** 0.75  # distinct words grow more slowly than words
    x[12] = max(counts.values(), default=0) / max(1, len(words))
    x[13] = sum(1 for a, b in zip(words, words[1:]) if a == b) / max(1, len(words))
    x[STATS + _slot(source, SOURCE_DIM)] = 0.3
    x[STATS + SOURCE_DIM + _slot(lang, LANG_DIM)] = 0.3
    return x


class Logistic:
    """Weighted logistic regression with an L2 penalty on standardised columns, by full-batch Adam; rows may be in half precision."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        parts = (x[rows, i : i + COLUMNS].astype(np.float32) for i in range(0, x.shape[1], COLUMNS))
        mean, scale = zip(*((p.mean(axis=0), 1 / (p.std(axis=0) + np.float32(1e-3))) for p in parts))
        self.mean, self.scale = np.concatenate(mean), np.concatenate(scale)
        self.w, self.b = np.zeros(x.shape[1], dtype=np.float32), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 120) -> None:
        x, p = x.astype(np.float32), (weight / weight.sum()).astype(np.float32)
        x -= self.mean
        x *= self.scale
        m = v = np.zeros(len(self.w) + 1, dtype=np.float32)
        for t in range(1, steps + 1):
            d = p * (1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30))) - y)
            g = np.concatenate([x.T @ d + penalty * self.w, [d.sum()]]).astype(np.float32)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            s = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w, self.b = self.w - s[:-1].astype(np.float32), self.b - float(s[-1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        parts = [(x[i : i + ROWS].astype(np.float32) - self.mean) * self.scale @ self.w + self.b for i in range(0, len(x), ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)


class CoTrained:
    """Two views and their combination."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, exchanged: int = EXCHANGED):
        """``y``: 0, 1 or -1 for a row of the pool."""
        known = np.flatnonzero(y >= 0)
        apart, first = known[np.arange(len(known)) % 4 == 3], known[np.arange(len(known)) % 4 != 3]
        pool = np.flatnonzero(y < 0)
        self.models = [Logistic(x, np.concatenate([first, pool])) for x in views]
        rows, labels = [first, first], [y[first].astype(np.float32)] * 2
        weights = [weight[first]] * 2
        share = float((weight[known] * (y[known] == 1)).sum() / weight[known].sum())
        light = float(weight[first].mean()) / 2
        self.exchanged = [0, 0]
        for r in range(rounds + 1):
            for k, (model, x) in enumerate(zip(self.models, views)):
                model.fit(x[rows[k]], labels[k], weights[k], (1e-2, 1e-3)[k])
            if r == rounds or not len(pool):
                break
            new: list[tuple[np.ndarray, np.ndarray]] = []
            for model, x in zip(self.models, views):
                p = 1 / (1 + np.exp(-np.clip(model.logit(x[pool]), -30, 30)))
                order = np.argsort(p, kind="stable")
                low, high = order[: max(1, round(exchanged * (1 - share)))], order[::-1][: max(1, round(exchanged * share))]
                low, high = low[p[low] < 0.1], high[p[high] > 0.9]
                new.append((pool[np.concatenate([low, high])], np.concatenate([np.zeros(len(low)), np.ones(len(high))]).astype(np.float32)))
            for k in (0, 1):
                got, told = new[1 - k]
                rows[k], labels[k] = np.concatenate([rows[k], got]), np.concatenate([labels[k], told])
                weights[k] = np.concatenate([weights[k], np.full(len(got), light)])
                self.exchanged[k] += len(got)
            pool = np.setdiff1d(pool, np.concatenate([new[0][0], new[1][0]]))
        if len(set(y[apart].tolist())) < 2:
            apart = known
        self.platt = [_platt(m.logit(x[apart]).astype(np.float64), y[apart], weight[apart]) for m, x in zip(self.models, views)]
        both = sum(a * m.logit(x[apart]).astype(np.float64) + b for (a, b), m, x in zip(self.platt, self.models, views))
        self.joint = _platt(both, y[apart], weight[apart])

    def scores(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Of the text view, the page view and both."""
        own = [a * m.logit(x).astype(np.float64) + b for (a, b), m, x in zip(self.platt, self.models, views)]
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*own, self.joint[0] * (own[0] + own[1]) + self.joint[1])]


def _views(texts: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> list[np.ndarray]:
    rows = [(t.as_py() or b"", s.as_py(), g.as_py(), n.as_py()) for t, s, g, n in zip(texts.cast(pa.binary()), source, lang, n_chars)]
    return [np.array([text_view(t) for t, *_ in rows], dtype=np.float32).reshape(-1, TEXT_DIM), np.array([page_view(*r) for r in rows], dtype=np.float32).reshape(-1, PAGE_DIM)]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, pool: int = POOL) -> CoTrained | float:
    """The model, or the share of good labels where there aren't two classes."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 1))
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 0").orderBy(*by_hash).limit(most).unionByName(known.where("y = 1").orderBy(*by_hash).limit(most))
    free = columns.where("doc_id is not null").select("doc_id").join(known, "doc_id", "left_anti").orderBy(*by_hash).limit(pool).select("doc_id", F.lit(-1).alias("y"))
    wanted = F.broadcast(chosen.unionByName(free).dropDuplicates(["doc_id"]))  # 2 most + pool rows
    one = columns.join(wanted, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("row"))
    picked = one.select("doc_id", "y", "row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                text, page = _views(c.column("text"), c.column("source"), c.column("lang"), c.column("n_chars"))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("y"), pa.array([zlib.compress(x.astype(np.float16).tobytes(), 1) for x in text], pa.binary()), pa.array([x.tobytes() for x in page], pa.binary())], ["doc_id", "y", "text", "page"])

    got = picked.mapInArrow(run, "doc_id long, y int, text binary, page binary").toArrow()
    ids, y = got.column("doc_id").to_pylist(), got.column("y").to_numpy()
    order = sorted(range(len(ids)), key=lambda k: (xxhash.xxh64_intdigest(str(ids[k])), ids[k]))
    y = y[order]
    if {0, 1} - set(y.tolist()):
        return float((y == 1).any() or not (y == 0).any())
    text, page = np.empty((len(ids), TEXT_DIM), dtype=np.float16), np.empty((len(ids), PAGE_DIM), dtype=np.float32)
    for k, t, p in zip(np.argsort(order), got.column("text"), got.column("page")):
        text[k], page[k] = np.frombuffer(zlib.decompress(t.as_py()), dtype=np.float16), np.frombuffer(p.as_py(), dtype=np.float32)
    del got
    weight = np.array([1.0 if k < 0 else sizes[int(k)] / max(1, int((y == k).sum())) for k in y])
    return CoTrained([text, page], y, weight)


def _scoring(model: CoTrained | float, shape: Callable[[pa.RecordBatch, list[np.ndarray]], pa.RecordBatch]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                scores = [np.full(c.num_rows, model)] * 3 if isinstance(model, float) else model.scores(_views(c.column("text"), c.column("source"), c.column("lang"), c.column("n_chars")))
                yield shape(c, scores)

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``docs`` and text_score, page_score, score, keep (named with underscores in front if taken)."""
    model = fit(docs, labels)
    names = [free_name(docs, n) for n in ("text_score", "page_score", "score", "keep")]
    columns = [*docs.columns, *names]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names[:3]], T.StructField(names[3], T.IntegerType())])

    def shape(c: pa.RecordBatch, scores: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*c.columns, *map(pa.array, scores), pa.array((scores[2] >= KEEP_FROM).astype(np.int32))], columns)

    return docs.mapInArrow(_scoring(model, shape), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is at least KEEP_FROM."""
    return docs.mapInArrow(_scoring(fit(docs, labels), lambda c, scores: c.filter(pa.array(scores[2] >= KEEP_FROM))), docs.schema)


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    return score_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "text_score", "page_score", "score", "keep")
