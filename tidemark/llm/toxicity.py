"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Each word enters as the sum of a vector of its own (for words of the training sample) and of the mean vector of its
hashed character trigrams. Overlapping windows of words cover the whole text; each is read in both directions, the
states are pooled by attention and give a logit. A document's logit is the largest one of its windows, calibrated on
training documents that the network has not seen.

The labels are of documents, not of windows. Training therefore alternates: the window of a toxic document that looks
most toxic (at first by the words' log odds, then by the network) stands for it, against the most suspicious and some
other windows of clean documents. The sample for training is bounded by ``most`` documents and ``sample_bytes`` of text
of each class, taken in the order of a hash of doc_id (a text that no longer fits is left out), whatever the number of
labelled rows; of several rows of one doc_id the smallest text is learnt from. Statistics of the labels are of all rows.

Inputs of a score are the text only. Defined results: a null or empty text is one window without words and gets a
score; several labels of one document count as the largest; documents without a label are scored only; if there are
no labels of both classes, the score is the share of toxic labels (0 without any); repeated rows are scored each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.common import is_held_out, table
from tidemark.llm.gru import F32

WINDOW, STRIDE = 40, 32
WORD_DIM, CHAR_ROWS, CHAR_DIM, WIDTH, ATTENTION = 12, 4096, 8, 12, 8
MOST, EPOCHS, PASSES = 2000, 8, 3
SLICE_BYTES, CHUNK, SAMPLE_BYTES = 4 << 20, 1024, 32 << 20
MARKS = b".,;:!?\"'()[]{}*#$%&|"


class Words:
    """The distinct words of some texts and each text's words by number."""

    def __init__(self, texts: list[bytes]):
        index: dict[bytes, int] = {}
        put = index.setdefault
        self.texts = []
        for t in texts:
            words = t.lower().split()
            self.texts.append(np.fromiter((put(w, len(index)) for w in words), dtype=np.int32, count=len(words)))
        self.distinct = list(index)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers (windows, WINDOW; -1 behind the end), lengths, and the text of each window."""
        rows, sizes, owner = [], [], []
        for k, t in enumerate(self.texts):
            count = 1 + max(0, -(-(len(t) - WINDOW) // STRIDE))
            padded = np.full((count - 1) * STRIDE + WINDOW, -1, dtype=np.int32)
            padded[: len(t)] = t
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
            sizes.append(np.minimum(WINDOW, len(t) - STRIDE * np.arange(count)))
            owner.append(np.full(count, k))
        if not rows:
            return np.zeros((0, WINDOW), dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(rows), np.concatenate(sizes), np.concatenate(owner)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of the trigrams of all words, with marks at both ends, and where each word's begin."""
    joined = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])
    code = joined[:-2] | joined[1:-1] << np.uint64(8) | joined[2:] << np.uint64(16)
    inside = np.ones(len(joined), dtype=bool)
    inside[starts[1:] - 1] = inside[starts[1:] - 2] = False
    rows = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(CHAR_ROWS)
    return rows[inside[:-2]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


class Network:
    def __init__(self, vocabulary: list[bytes], seed: int = 11):
        rng = np.random.default_rng(seed)
        w = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(F32)
        self.vocabulary = {x: i + 1 for i, x in enumerate(vocabulary)}
        wide = WORD_DIM + CHAR_DIM
        self.w = {
            "word": w(0.3, len(vocabulary) + 1, WORD_DIM), "char": w(0.3, CHAR_ROWS, CHAR_DIM),
            "xf": w(0.3, wide, 3 * WIDTH), "xb": w(0.3, wide, 3 * WIDTH), "bf": np.zeros(3 * WIDTH, F32), "bb": np.zeros(3 * WIDTH, F32),
            "hf": w(0.3, WIDTH, 3 * WIDTH), "hb": w(0.3, WIDTH, 3 * WIDTH),
            "att": w(0.3, 2 * WIDTH, ATTENTION), "va": w(0.5, ATTENTION), "out": w(0.3, 2 * WIDTH), "bias": np.zeros(1, F32),
        }
        self.w["word"][0] = 0

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of words (a row of zeros follows), with what they were made of."""
        ids = np.fromiter((self.vocabulary.get(x.strip(MARKS), 0) for x in words), dtype=np.int64, count=len(words))
        rows, starts = trigrams(words) if words else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        char = np.add.reduceat(self.w["char"][rows], starts[:-1], axis=0) / np.diff(starts)[:, None].astype(F32) if words else np.zeros((0, CHAR_DIM), F32)
        x = np.concatenate([self.w["word"][ids], char], axis=1)
        return np.concatenate([x, np.zeros((1, x.shape[1]), F32)]), ids, rows, starts

    @staticmethod
    def _masks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, windows): 1 inside; and, for the reversed reading, 0 where the text begins."""
        t = np.arange(WINDOW)[:, None]
        return (t < sizes[None, :]), (t[::-1] != sizes[None, :] - 1).astype(F32)

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows, and the text of each."""
        x, *_ = self.inputs(words.distinct)
        w = self.w
        ahead, back = x @ w["xf"] + w["bf"], x @ w["xb"] + w["bb"]
        grid, sizes, owner = words.windows()
        out = np.zeros(len(grid))
        for i in range(0, len(grid), CHUNK):
            g = np.ascontiguousarray(grid[i : i + CHUNK].T)
            inside, keep = self._masks(sizes[i : i + CHUNK])
            h = np.zeros((g.shape[1], WIDTH), F32)
            s = np.concatenate([gru.run(ahead[g], w["hf"], h), gru.run(back[g[::-1]], w["hb"], h, keep)[::-1]], axis=2)
            e = np.where(inside, np.tanh(s @ w["att"]) @ w["va"], F32(-30))
            a = np.exp(e - e.max(axis=0))
            out[i : i + CHUNK] = ((s @ w["out"]) * a * inside).sum(axis=0) / a.sum(axis=0) + w["bias"][0]
        return out, owner

    def learn(self, words: Words, grid: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int, rate: float, seed: int) -> None:
        w, adam, rng = self.w, gru.Adam(self.w, rate), np.random.default_rng(seed)
        for _ in range(epochs):
            for pick in np.array_split(rng.permutation(len(grid)), max(1, len(grid) // 128)):
                used, g = np.unique(grid[pick], return_inverse=True)
                g = g.reshape(len(pick), WINDOW).T
                own = [words.distinct[i] for i in used if i >= 0]
                g = np.where(g >= len(used) - len(own), g - (len(used) - len(own)), len(own))
                x, ids, rows, starts = self.inputs(own)
                inside, keep = self._masks(sizes[pick])
                h, ones = np.zeros((len(pick), WIDTH), F32), np.ones(g.shape, F32)
                sf, kf = gru.forward((x @ w["xf"] + w["bf"])[g], w["hf"], h, ones)
                sb, kb = gru.forward((x @ w["xb"] + w["bb"])[g[::-1]], w["hb"], h, keep)
                s = np.concatenate([sf, sb[::-1]], axis=2)
                u = np.tanh(s @ w["att"])
                e = np.where(inside, u @ w["va"], F32(-30))
                a = np.exp(e - e.max(axis=0)) * inside
                a = a / np.maximum(a.sum(axis=0), F32(1e-9))
                pooled = (a[:, :, None] * s).sum(axis=0)
                d = ((gru.sigmoid((pooled @ w["out"] + w["bias"][0]).astype(F32)) - y[pick]) / len(pick)).astype(F32)
                grads = {"out": pooled.T @ d, "bias": np.array([d.sum()], F32)}
                dpool = d[:, None] * w["out"]
                da = (s * dpool).sum(axis=2)
                de = (a * (da - (a * da).sum(axis=0))).astype(F32)
                du = de[:, :, None] * w["va"] * (1 - u * u)
                grads["va"], grads["att"] = (u * de[:, :, None]).sum(axis=(0, 1)), s.reshape(-1, 2 * WIDTH).T @ du.reshape(-1, ATTENTION)
                ds = (a[:, :, None] * dpool + du @ w["att"].T).astype(F32)
                df, grads["hf"] = gru.backward(np.ascontiguousarray(ds[:, :, :WIDTH]), kf, w["hf"], ones)
                db, grads["hb"] = gru.backward(np.ascontiguousarray(ds[::-1, :, WIDTH:]), kb, w["hb"], keep)
                flat = g.ravel()
                pf, pb = gru.rows_sum(flat, df.reshape(-1, 3 * WIDTH), len(x)), gru.rows_sum(g[::-1].ravel(), db.reshape(-1, 3 * WIDTH), len(x))
                grads["xf"], grads["xb"], grads["bf"], grads["bb"] = x.T @ pf, x.T @ pb, pf.sum(axis=0), pb.sum(axis=0)
                dx = (pf @ w["xf"].T + pb @ w["xb"].T)[:-1]
                grads["word"] = gru.rows_sum(ids, dx[:, :WORD_DIM], len(w["word"]))
                grads["word"][0] = 0
                size = np.diff(starts)
                grads["char"] = gru.rows_sum(rows, np.repeat(dx[:, WORD_DIM:] / size[:, None].astype(F32), size, axis=0), CHAR_ROWS)
                adam.step(grads)


def _largest(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, -np.inf)
    np.maximum.at(out, owner, values)
    return out


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of the weighted logistic fit a x + b, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, r = weight * (p - y), weight * p * (1 - p) + 1e-9
        m = np.array([[(r * x * x).sum() + 1e-2, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-2]])
        da, db = np.linalg.solve(m, [(g * x).sum() + 1e-2 * (a - 1), g.sum()])
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return max(a, 1e-3), b


def fit(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray, passes: int = PASSES, epochs: int = EPOCHS) -> tuple[Network, float, float]:
    """A network and the calibration of a document's largest logit."""
    apart = np.arange(len(texts)) % 5 == 4  # for calibration
    words = Words(texts)
    bare = [w.strip(MARKS) for w in words.distinct]
    seen: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
    for k, t in enumerate(words.texts):
        if not apart[k]:
            seen[int(toxic[k])].update({bare[i] for i in set(t.tolist())})
    docs = [max(1, int(((toxic == c) & ~apart).sum())) for c in (0, 1)]
    common = sorted(w for w in seen[0].keys() | seen[1].keys() if w and seen[0][w] + seen[1][w] >= 3)
    odds = {w: math.log((seen[1][w] + 0.5) / (docs[1] + 1)) - math.log((seen[0][w] + 0.5) / (docs[0] + 1)) for w in common}
    of_word = np.array([odds.get(w, 0.0) for w in bare] + [0.0])
    net = Network(common)
    grid, sizes, owner = words.windows()
    look = of_word[grid].max(axis=1)
    rng = np.random.default_rng(3)
    for p in range(passes):
        best = np.lexsort((-look, owner))
        rank = np.empty(len(owner), dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        rank[best] = np.arange(len(owner)) - begin[owner[best]]
        own_toxic = toxic[owner] == 1
        use = ~apart[owner] & np.where(own_toxic, rank == 0, (rank < 2) | (rng.random(len(owner)) < 2 / np.maximum(1, np.bincount(owner)[owner])))
        net.learn(words, grid[use], sizes[use], own_toxic[use].astype(F32), epochs, 0.01 if p == 0 else 0.004, p)
        look, _ = net.logits(words)
    top = _largest(look, owner, len(texts))
    use = apart if len(set(toxic[apart].tolist())) == 2 else np.ones(len(texts), dtype=bool)
    return net, *_platt(top[use], toxic[use], weight[use])


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = MOST, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learns from labelled rows that aren't held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.where(~held_out).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model: tuple[Network, float, float] | None = None
    if len(sizes) == 2:
        sample = []
        for c in (0, 1):
            chosen = known.where(~held_out).where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
            left, ids = sample_bytes, []
            for r in texts.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # ``most`` numbers
                if r["size"] <= left:
                    left, ids = left - r["size"], [*ids, r["doc_id"]]
            sample += sorted((r["doc_id"], r["text"].encode(), c) for r in texts.where(F.col("doc_id").isin(ids)).collect())
        sample.sort(key=lambda r: hash(r[0] * 2654435761 % (1 << 32)))
        toxic = np.array([c for _, _, c in sample], dtype=np.int64)
        share = {c: sizes[c] / max(1, int((toxic == c).sum())) for c in (0, 1)}
        if len(set(toxic.tolist())) == 2:
            model = fit([t for _, t, _ in sample], toxic, np.array([share[int(c)] for c in toxic]))
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rows, size = [], [], 0
            column = b.column("text").cast(pa.binary())
            for i, t in enumerate(column):
                rows.append(t.as_py() or b"")
                size += len(rows[-1])
                if size >= SLICE_BYTES or i + 1 == len(column):
                    if model is None:
                        out.append(np.full(len(rows), prior))
                    else:
                        net, a, c = model
                        found, owner = net.logits(Words(rows))
                        out.append(1 / (1 + np.exp(-np.clip(a * _largest(found, owner, len(rows)) + c, -30, 30))))
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), is_held_out(0))
