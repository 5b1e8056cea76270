"""Secret scans: patterns find the plain cases, a character network finds what looks like them.

One pass over the whole texts finds the base spans of three patterns and the candidates: runs of key characters from
``LEAST`` characters on that hold a digit, or capitals behind a small letter. A candidate is read by a convolutional network
through windows of its characters (all of them, ``VALUE`` at a time) with the characters before and behind it. The network
has one output for each kind of finding. It learns from findings labelled by the base patterns: a candidate that a base span covers is
positive for the span's kind, every other one negative. For hex and access keys each positive is also learnt without its surroundings,
characters of the surroundings are blotted out and some windows turned into capitals at random, so that values are known by their looks
and names by more than one spelling.

What the patterns miss stands among the negatives, so no value is judged by a network that has learnt it: values are dealt into two
halves by a hash of their characters, and each half is scored by the network of the other. Each output is calibrated by a
logistic fit on such scores. Its threshold is the highest at which ``RECALL`` of the labelled findings of the kind are found, lowered to
the middle of the gap to the next negative, but never a calibrated score under one half. Candidates at or above a threshold that no
base span overlaps are added.

All distinct windows are learnt from: they are dealt to parts of about ``PART`` by a hash of their characters, in each of ``ROUNDS`` rounds
every part trains a copy of the networks, and the copies are averaged by a shuffle over the weights, in whole numbers, so that their order
doesn't matter. Calibrations (sums of Newton steps over the parts) and thresholds (counts by the leading bits of the scores, then by the next
ones) are exact ones of all windows too. No part and no step on the driver grows with the corpus but for a few numbers of each part.
The work of a row is linear in its text.

Defined results: a null text is an empty one, without spans; places count code points; repeated rows are scanned each; ids may
be null; kinds without a base span in the whole table have no output of their own, so nothing is added for them; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.common import cut, table
from tidemark.llm.gru import F32
from tidemark.llm.toxicity import _platt

#: Kinds of findings in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "key")  # every name of ASSIGN holds one of these
LEAST, LEAST_ASSIGNED = 8, 6
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
TELLING = re.compile(r"[0-9]|[a-z][A-Za-z+/_-]*[A-Z]")

BEFORE, VALUE, AFTER = 24, 32, 8
WIDE = BEFORE + VALUE + AFTER
CODES, CHAR_DIM, SPAN, FILTERS = 97, 8, 5, 24
EPOCHS, STEPS, BATCH, BLOT, LOUD, RECALL, LEAST_SCORE = 10, 300, 64, 0.15, 0.2, 0.99, 0.5
PART, RATES = 4096, (0.01, 0.01, 0.01, 0.01, 0.002, 0.002)
ROUNDS = len(RATES)
SCORED = 4096


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """start, kind, end and start of the value of every base span, by start and kind."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def windows(text: str, start: int, end: int) -> list[str]:
    """The characters of a candidate, VALUE at a time, each between the characters before and behind the candidate; padded with NUL."""
    before, after = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0")
    return [before + text[i : min(end, i + VALUE)].ljust(VALUE, "\0") + after for i in range(start, end, VALUE)]


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, list[str]]]:
    """start, end, bits of the kinds whose base values overlap it, and windows of every candidate."""
    out, first = [], 0
    for m in RUN.finditer(text):
        if not TELLING.search(m[0]):
            continue
        start, end = m.span()
        while first < len(base) and base[first][2] <= start:
            first += 1  # spans begin in order, and those of one kind end in order
        label, i = 0, first
        while i < len(base) and base[i][0] < end:
            _, kind, e, value = base[i]
            if value < end and e > start:
                label |= 1 << kind
            i += 1
        out.append((start, end, label, windows(text, start, end)))
    return out


def codes(rows: list[str]) -> np.ndarray:
    """(rows, WIDE) numbers of characters: 0 padding, 1 to 95 printable ASCII, 96 any other."""
    flat = np.frombuffer("".join(rows).encode("utf-32-le"), dtype="<u4").astype(np.int64).reshape(len(rows), WIDE)
    return np.where((flat >= 32) & (flat < 127), flat - 31, np.where(flat == 0, 0, CODES - 1))


class Network:
    """Characters, one convolution, the largest answer of each filter before and inside the candidate, one output a kind."""

    PARTS = np.repeat([0, 1, 2], [BEFORE, VALUE, AFTER])
    SPLIT = BEFORE - SPAN // 2  # windows of the convolution from here on reach into the value

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(F32)
        self.w = {"char": w(0.4, CODES, CHAR_DIM), "part": w(0.2, 3, CHAR_DIM), "conv": w(0.25, SPAN * CHAR_DIM, FILTERS), "shift": np.zeros(FILTERS, F32), "out": w(0.2, 2 * FILTERS, len(KINDS)), "bias": np.zeros(len(KINDS), F32)}

    def _layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        seen = self.w["char"][x] + self.w["part"][self.PARTS]
        cols = np.lib.stride_tricks.sliding_window_view(seen, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDE - SPAN + 1, SPAN * CHAR_DIM)
        act = np.maximum(cols @ self.w["conv"] + self.w["shift"], F32(0))
        top = np.stack([act[:, : self.SPLIT].argmax(axis=1), act[:, self.SPLIT :].argmax(axis=1) + self.SPLIT], axis=1)
        pooled = np.take_along_axis(act, top, axis=1).reshape(len(x), 2 * FILTERS)
        return cols, act, top, pooled

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._layers(x[i : i + SCORED])[3] @ self.w["out"] + self.w["bias"] for i in range(0, len(x), SCORED)] or [np.zeros((0, len(KINDS)), F32)])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted logistic loss of (rows, kinds) targets, and its gradients."""
        cols, act, top, pooled = self._layers(x)
        z = pooled @ self.w["out"] + self.w["bias"]
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum() / len(x))
        d = (weight * (gru.sigmoid(z) - y) / len(x)).astype(F32)
        g = {"out": pooled.T @ d, "bias": d.sum(axis=0)}
        dact = np.zeros_like(act)
        np.put_along_axis(dact, top, ((d @ self.w["out"].T).reshape(len(x), 2, FILTERS)), axis=1)
        dact *= act > 0
        g["conv"], g["shift"] = np.tensordot(cols, dact, axes=([0, 1], [0, 1])), dact.sum(axis=(0, 1))
        dcols = (dact @ self.w["conv"].T).reshape(len(x), WIDE - SPAN + 1, SPAN, CHAR_DIM)
        dseen = np.zeros((len(x), WIDE, CHAR_DIM), F32)
        for j in range(SPAN):
            dseen[:, j : j + WIDE - SPAN + 1] += dcols[:, :, j]
        g["char"] = gru.rows_sum(x.ravel(), dseen.reshape(-1, CHAR_DIM), CODES)
        g["part"] = gru.rows_sum(np.tile(self.PARTS, len(x)), dseen.reshape(-1, CHAR_DIM), 3)
        return loss, g


class Model(NamedTuple):
    nets: tuple[Network, Network]  # each scores the half of the values that the other has learnt from
    scale: np.ndarray  # of the calibrations, for each kind
    shift: np.ndarray
    least: np.ndarray  # thresholds of the calibrated scores; above 1 where a kind has no findings

    def scores(self, rows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * unseen_logits(self.nets, rows) + self.shift, -30, 30)))


def half(row: str) -> int:
    """Which network scores the value of a window."""
    return zlib.crc32(row[BEFORE : BEFORE + VALUE].encode()) % 2


def unseen_logits(nets: tuple[Network, Network], rows: list[str]) -> np.ndarray:
    x, of = codes(rows), np.fromiter(map(half, rows), dtype=np.int64, count=len(rows))
    out = np.zeros((len(rows), len(KINDS)))
    for h, net in enumerate(nets):
        out[of == h] = net.logits(x[of == h])
    return out


def threshold(logit: np.ndarray, found: np.ndarray, recall: float) -> float:
    """The highest logit that keeps ``recall`` of the positives, lowered to the middle of the gap to the next negative."""
    own = np.sort(logit[found])[::-1]
    top = own[min(len(own), int(np.ceil(recall * len(own)))) - 1]
    under = logit[~found & (logit < top)]
    return float((top + under.max()) / 2) if len(under) else float(top) - 1.0


def passes(rows: float, epochs: int = EPOCHS) -> int:
    """How often a round sees the rows of a part; few rows are seen more often."""
    return -(-max(epochs, math.ceil(STEPS * BATCH / max(1, 2 * rows))) // ROUNDS)


def learn(net: Network, x: np.ndarray, y: np.ndarray, share: np.ndarray, epochs: int, rate: float, seed: tuple[int, ...]) -> None:
    """A round of training on codes of windows and their (rows, kinds) targets; ``share``: of the kinds in all windows."""
    if not len(x):
        return
    bare = x.copy()
    bare[:, :BEFORE] = bare[:, BEFORE + VALUE :] = 0
    is_bare = np.repeat([False, True], len(x))
    x, y = np.concatenate([x, bare]), np.concatenate([y, y])
    weight = np.ones((len(y), len(KINDS)), F32)
    weight[is_bare, 0] = 1 - y[is_bare, 0]  # without its name an assigned value isn't known as one
    weight *= np.where(y > 0, np.clip(0.5 / np.maximum(share, 1e-3), 1, 50), 1).astype(F32)
    rng, adam = np.random.default_rng(seed), gru.Adam(net.w, rate)
    around = np.concatenate([np.arange(BEFORE), np.arange(BEFORE + VALUE, WIDE)])
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            seen = x[pick]
            loud = (rng.random(len(pick)) < LOUD)[:, None] & (seen >= ord("a") - 31) & (seen <= ord("z") - 31)
            seen = np.where(loud, seen - 32, seen)
            blots = (rng.random((len(pick), len(around))) < BLOT) & (seen[:, around] > 0)
            seen[:, around] = np.where(blots, CODES - 1, seen[:, around])
            adam.step(net.gradients(seen, y[pick], weight[pick])[1])


def fit(x: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> Network:
    """A network from codes of windows and their (rows, kinds) targets, as one part."""
    net = Network(seed)
    for r, rate in enumerate(RATES):
        learn(net, x, y, y.mean(axis=0) if len(y) else np.zeros(len(KINDS)), passes(len(x), epochs), rate, (seed, r, 0))
    return net


def train(rows: list[str], labels: np.ndarray, epochs: int = EPOCHS, recall: float = RECALL) -> Model | None:
    """A model from windows in memory and bits of their kinds; None where there are no findings or nothing else. ``learnt`` does it on Spark."""
    y = ((labels[:, None] >> np.arange(len(KINDS))) & 1).astype(F32)
    if not len(rows) or not y.any() or y.any(axis=1).all():
        return None
    x, of = codes(rows), np.fromiter(map(half, rows), dtype=np.int64, count=len(rows))
    nets = (fit(x[of == 1], y[of == 1], epochs, 7), fit(x[of == 0], y[of == 0], epochs, 8))
    z = unseen_logits(nets, rows)
    scale, shift, least = np.ones(len(KINDS)), np.zeros(len(KINDS)), np.full(len(KINDS), 2.0)
    for k in np.flatnonzero(y.any(axis=0)):
        found = y[:, k] > 0
        scale[k], shift[k] = _platt(z[:, k], found.astype(float), np.ones(len(z)))
        least[k] = max(LEAST_SCORE, 1 / (1 + np.exp(-np.clip(scale[k] * threshold(z[:, k], found, recall) + shift[k], -30, 30))))
    return Model(nets, scale, shift, least)


def _bits(label: np.ndarray) -> np.ndarray:
    """(rows, kinds) of zeros and ones."""
    return (label[:, None] >> np.arange(len(KINDS))) & 1


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """The windows of a part in one row: codes, which network scores them, bits of their kinds."""
    rows = rows.sort_by("window")
    text = rows.column("window").to_pylist()
    columns = (codes(text), np.fromiter(map(half, text), dtype=np.int64), rows.column("label").to_numpy())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.astype(np.uint8).tobytes()], pa.binary()) for x in columns)], ["part", "codes", "half", "label"])


def _parts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for part, *columns in zip(b.column("part").to_pylist(), *(b.column(c) for c in ("codes", "half", "label"))):
        x, of, label = (np.frombuffer(c.as_py(), dtype=np.uint8).astype(np.int64) for c in columns)
        yield part, x.reshape(-1, WIDE), of, label


def _flat(nets: tuple[Network, Network]) -> np.ndarray:
    return np.concatenate([x.ravel() for net in nets for x in net.w.values()]).astype(np.float64)


def _networks(flat: np.ndarray) -> tuple[Network, Network]:
    nets, at = (Network(7), Network(8)), 0
    for net in nets:
        for k, x in net.w.items():
            net.w[k] = flat[at : at + x.size].reshape(x.shape).astype(F32)
            at += x.size
    return nets


#: Weights are summed as whole numbers of this part of one.
GRAIN = 2.0**32


def _averaged(packed: DataFrame, nets: tuple[Network, Network], share: np.ndarray, epochs: list[int], rate: float, r: int) -> tuple[Network, Network]:
    """The networks after a round: the means of the parts' copies, weighted by the rows that these have learnt from."""
    start = _flat(nets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x, of, label in _parts(b):
                own, y = _networks(start), _bits(label).astype(F32)
                for k, net in enumerate(own):
                    learn(net, x[of != k], y[of != k], share[k], epochs[k], rate, (7 + k, r, part))
                n = np.repeat([int((of != k).sum()) for k in (0, 1)], len(start) // 2)
                whole = np.round(_flat(own) * GRAIN).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start), dtype=np.int32)), pa.array(n), pa.array(whole)], ["i", "n", "w"])

    exact = F.col("w").cast("decimal(38,0)") * F.col("n")
    sums = packed.mapInArrow(run, "i int, n long, w long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(exact).alias("w"))
    found = sums.where("n > 0").select("i", (F.col("w").cast("double") / F.col("n") / GRAIN).alias("w")).toArrow()
    flat = start.copy()
    flat[found.column("i").to_numpy()] = found.column("w").to_numpy()
    return _networks(flat)


def _judged(packed: DataFrame, nets: tuple[Network, Network]) -> DataFrame:
    """part, z, label: the logits of all windows by the networks that haven't learnt their values, and bits of their kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x, of, label in _parts(b):
                z = np.zeros((len(x), len(KINDS)), F32)
                for k, net in enumerate(nets):
                    z[of == k] = net.logits(x[of == k])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([z.tobytes()], pa.binary()), pa.array([label.astype(np.uint8).tobytes()], pa.binary())], ["part", "z", "label"])

    return cut(packed.mapInArrow(run, "part int, z binary, label binary"))


def _logits(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for part, z, label in zip(b.column("part").to_pylist(), b.column("z"), b.column("label")):
        yield part, np.frombuffer(z.as_py(), dtype=F32).reshape(-1, len(KINDS)), _bits(np.frombuffer(label.as_py(), dtype=np.uint8)) > 0


def calibrated(judged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """scale and shift of every kind: the logistic fit of ``_platt``, whose sums are taken over the parts."""
    a, b = np.ones(len(KINDS)), np.zeros(len(KINDS))
    for _ in range(50):

        def run(batches: Iterator[pa.RecordBatch], a=a, b=b) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, z, y in _logits(batch):
                    x = z.astype(np.float64)
                    p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
                    g, r = p - y, p * (1 - p) + 1e-9
                    sums = np.stack([(r * x * x).sum(axis=0), (r * x).sum(axis=0), r.sum(axis=0), (g * x).sum(axis=0), g.sum(axis=0)])
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], ["part", "sums"])

        rows = sorted((r["part"], r["sums"]) for r in judged.mapInArrow(run, "part int, sums array<double>").collect())
        xx, x, one, gx, g = np.sum([s for _, s in rows], axis=0).reshape(5, len(KINDS))
        steps = [np.linalg.solve([[xx[k] + 1e-2, x[k]], [x[k], one[k] + 1e-2]], [gx[k] + 1e-2 * (a[k] - 1), g[k]]) for k in range(len(KINDS))]
        da, db = np.clip(np.array(steps).T, -1, 1)
        a, b = a - da, b - db
        if max(np.abs(da).max(), np.abs(db).max()) < 1e-10:
            break
    return np.maximum(a, 1e-3), b


def ordered(z: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 below 2^32 in the order of single-precision numbers."""
    bits = (z + F32(0)).view(np.int32).astype(np.int64)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) + (1 << 31)


def _number(place: int) -> float:
    bits = place - (1 << 31)
    return float(np.array([bits ^ 0x7FFFFFFF if bits < 0 else bits]).astype(np.int32).view(F32)[0])


def thresholds(judged: DataFrame, counts: dict[int, int], recall: float) -> dict[int, float]:
    """``threshold`` of every kind in ``counts`` (its findings): its place is counted by ever more leading bits of the logits."""
    left = {k: min(n, math.ceil(recall * n)) for k, n in counts.items()}
    prefix, before = dict.fromkeys(counts, 0), 32
    for shift in (21, 10, 0):

        def run(batches: Iterator[pa.RecordBatch], prefix=dict(prefix), before=before, shift=shift) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, z, y in _logits(b):
                    for k, p in prefix.items():
                        place = ordered(z[y[:, k], k])
                        bin_, n = np.unique(place[place >> before == p] >> shift, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, dtype=np.int32)), pa.array(bin_), pa.array(n)], ["kind", "bin", "n"])

        rows = judged.mapInArrow(run, "kind int, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect()  # 2048 a kind at most
        done: set[int] = set()
        for kind, bin_, n in sorted(((r["kind"], r["bin"], r["n"]) for r in rows), reverse=True):
            if kind in done:
                continue
            if left[kind] <= n:
                prefix[kind] = bin_
                done.add(kind)
            else:
                left[kind] -= n
        before = shift
    top = {k: _number(p) for k, p in prefix.items()}

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, z, y in _logits(b):
                for k, t in top.items():
                    x = z[~y[:, k] & (z[:, k] < t), k]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([float(x.max())])], ["kind", "z"])

    next_ = {r["kind"]: r["z"] for r in judged.mapInArrow(under, "kind int, z double").groupBy("kind").agg(F.max("z").alias("z")).collect()}
    return {k: (t + next_[k]) / 2 if k in next_ else t - 1.0 for k, t in top.items()}


def learnt(seen: DataFrame, recall: float = RECALL, size: int = PART) -> Model | None:
    """The model of all distinct windows (window, label); None where there are no findings or nothing else."""
    of = F.crc32(F.substring("window", BEFORE + 1, VALUE).cast("binary")) % 2
    counts = {(r["half"], r["label"]): r["n"] for r in seen.groupBy(of.alias("half"), "label").agg(F.count("*").alias("n")).collect()}  # 16 at most
    found = {k: sum(n for (_, label), n in counts.items() if label >> k & 1) for k in range(len(KINDS))}
    found = {k: n for k, n in found.items() if n}
    if not found or not any(label == 0 for _, label in counts):
        return None
    parts = math.ceil(sum(counts.values()) / size)
    rows = [sum(n for (h, _), n in counts.items() if h != k) for k in (0, 1)]  # that network k learns from
    share = np.array([[sum(n for (h, label), n in counts.items() if h != k and label >> i & 1) / max(1, rows[k]) for i in range(len(KINDS))] for k in (0, 1)])
    dealt = seen.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts)).cast("int")).repartition(parts, "part")
    packed = cut(dealt.groupBy("part").applyInArrow(_pack, "part int, codes binary, half binary, label binary"))
    nets = (Network(7), Network(8))
    for r, rate in enumerate(RATES):
        nets = _averaged(packed, nets, share, [passes(n / parts) for n in rows], rate, r)
    judged = _judged(packed, nets)
    scale, shift = calibrated(judged)
    least = np.full(len(KINDS), 2.0)
    for k, t in thresholds(judged, found, recall).items():
        least[k] = max(LEAST_SCORE, 1 / (1 + np.exp(-np.clip(scale[k] * t + shift[k], -30, 30))))
    return Model(nets, scale, shift, least)


SPANS = "array<struct<start:long,kind:int,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("windows", pa.list_(pa.string()))]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, found = [], []
        for t in b.column("text"):
            text = t.as_py() or ""
            base = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in base])
            found.append([{"start": s, "end": e, "label": bits, "windows": w} for s, e, bits, w in candidates(text, base)])
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, _SPAN), pa.array(found, _FOUND)], ["id", "base", "found"])


def find_secrets(docs: DataFrame, id_col: str, text_col: str, recall: float = RECALL) -> DataFrame:
    """id, base and added: the spans (start, kind, end) of the patterns and of the network, each by start and kind."""
    kind = dict(docs.dtypes)[id_col]
    found = "array<struct<start:long,end:long,label:int,windows:array<string>>>"
    scanned = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, f"id {kind}, base {SPANS}, found {found}"))
    seen = scanned.select(F.explode("found").alias("f")).select("f.label", F.explode("f.windows").alias("window"))
    seen = cut(seen.groupBy("window").agg(F.bit_or("label").alias("label")))
    model = learnt(seen, recall)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for found, base in zip(b.column("found"), b.column("base")):
                out.append([{"start": s, "kind": k, "end": e} for s, k, e in _added(model, found.as_py(), base.as_py())])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("base"), pa.array(out, _SPAN)], ["id", "base", "added"])

    return scanned.mapInArrow(score, f"id {kind}, base {SPANS}, added {SPANS}")


def _added(model: Model | None, found: list[dict], base: list[dict]) -> list[tuple[int, int, int]]:
    """start, kind and end of the candidates of one text that reach a threshold and meet no base span."""
    rows: list[dict] = []
    at = ends = 0  # ends: the largest end of the base spans that begin before the candidate's end
    for f in found:
        while at < len(base) and base[at]["start"] < f["end"]:
            ends, at = max(ends, base[at]["end"]), at + 1
        if ends <= f["start"]:
            rows.append(f)
    if model is None or not rows:
        return []
    sizes = np.array([len(f["windows"]) for f in rows])
    best = np.maximum.reduceat(model.scores([w for f in rows for w in f["windows"]]), np.cumsum(sizes) - sizes, axis=0)
    over = best - model.least
    return [(f["start"], int(k), f["end"]) for f, k, o in zip(rows, over.argmax(axis=1), over.max(axis=1)) if o >= 0]


def written(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        F.col("id").alias("doc_id"),
        *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
