"""Language-model scores of whole documents by a gated recurrent network with a class-factored output.

Words of all training documents are counted. The most frequent ones, as many as the root of the number of distinct
words (``LEAST_OUTPUTS`` to ``MOST_OUTPUTS``), have output weights of their own, in as many classes as a class has words; every
other word belongs to one of a few classes by its ending, inside which its probability is its smoothed count's share.
So P(word | history) = P(class | state) P(word | class, state), a proper distribution over known words and one unknown
word for each ending.

Counts cover all training documents and are summed by a shuffle. The network learns by truncated backpropagation in
numpy from every training document once: rounds take disjoint parts of the documents by hash (``ROUNDS``, shares that
sum to one, the same whatever the size). In a round, every task trains a copy on its documents, in pieces of at most
``PIECE`` words, and the copies are averaged by a shuffle over the weights. Output biases start at the counts, so an
untrained network equals the unigram model of the classes. The weights depend on how Spark splits the table into tasks;
another layout of files gives another, equally trained network. Base scores don't.

When scoring, documents run side by side in lanes; a lane carries its state from window to window to the end of each
document. Counts of frequent words (a bounded table) are at hand in the task; other words are joined with the counts.

Defined results: a null text is the empty one, which has one token, its end; without training documents N and V are 0;
repeated rows are scored each; a null doc_id counts as the empty text for the split; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.common import cut, is_held_out, table
from tidemark.llm.gru import F32

END = b"\n"  # no word holds a line feed
LEAST_OUTPUTS, MOST_OUTPUTS, WIDTH, TABLE = 1 << 10, 1 << 14, 16, 1 << 18
ROUNDS, RATES, STEPS, LANES, PIECE = (1 / 16, 3 / 16, 3 / 4), (0.03, 0.02, 0.01), 16, 512, 2048
CHUNK, ROWS, READ, CACHE = 64, 32, 16, 1 << 18
SLICE_BYTES, SLICE_UNITS = 12 << 20, 2 << 20
PLACES, PACKED = 1 << 20, np.dtype("<u2")  # units are fewer than 32,768: MOST_OUTPUTS and the endings
MARKS, GROUPS = b".,;:!?)]}'\"", 14
ENDINGS = 2 * GROUPS


def ending(word: bytes) -> int:
    """The class of a word without an output of its own: ends in a mark or not, and its last letter."""
    bare = word.rstrip(MARKS)
    last = bare[-1] if bare else 0
    return (GROUPS if len(bare) < len(word) else 0) + ((last - 97) // 2 if 97 <= last <= 122 else GROUPS - 1)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Slices of a batch: the number of the first row, how many words each text has, and all words."""
    text = batch.column("text").cast(pa.string())
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1).tolist(), len(text)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text.slice(i, j - i), "")))
            words = found.flatten()
            full = pc.greater(pc.binary_length(words), 0)  # a blank at an end leaves an empty one
            row = np.repeat(np.arange(j - i), np.diff(found.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
            yield i, np.bincount(row, minlength=j - i), words.filter(full).cast(pa.binary())


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c: over all texts, with the end of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sizes, words in _words(b):
                found = words.value_counts()
                word, n = pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([found.field("counts"), pa.array([len(sizes)], pa.int64())])
                yield pa.RecordBatch.from_arrays([word, n], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Frequent words with their counts, the first ``outputs`` of which have outputs of their own."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, ending_rows: dict[int, tuple[int, int]], outputs: int):
        self.words = words
        self.total, self.base_mass = total, total + 0.5 * (distinct + 1)
        self.log_count = np.append(np.log10(np.array(counts, dtype=np.float64) + 0.5), np.zeros(ENDINGS))
        self.outputs = min(outputs, len(words))
        self.classes = max(1, math.isqrt(self.outputs))
        self.size = max(1, math.ceil(self.outputs / self.classes))
        self.unit = np.concatenate([np.arange(self.outputs), [self.outputs + ending(w) for w in words[self.outputs :]], self.outputs + np.arange(ENDINGS)]).astype(np.int32)
        # mass of each ending: counts of its words plus one half for each of them and for its unknown word
        self.mass = np.array([ending_rows.get(e, (0, 0))[0] + 0.5 * (ending_rows.get(e, (0, 0))[1] + 1) for e in range(ENDINGS)])
        self.frequent = np.array(counts[: self.outputs], dtype=np.float64) + 0.5


def fresh(v: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda *shape: (rng.standard_normal(shape) * (0.5 / math.sqrt(shape[0] if len(shape) > 1 else 1))).astype(F32)
    word = np.full((v.classes, v.size), -30.0)
    word.ravel()[: v.outputs] = np.log(v.frequent)
    in_class = np.logaddexp.reduce(word, axis=1)
    top = np.concatenate([in_class, np.log(v.mass)])
    return {
        "emb": (rng.standard_normal((v.outputs + ENDINGS + 1, WIDTH)) * 0.3).astype(F32),
        "wx": w(WIDTH, 3 * WIDTH), "wh": w(WIDTH, 3 * WIDTH), "b": np.zeros(3 * WIDTH, dtype=F32),
        "wc": np.zeros((WIDTH, v.classes + ENDINGS), dtype=F32), "bc": (top - top.max()).astype(F32),
        "ww": np.zeros((v.classes, WIDTH, v.size), dtype=F32), "bw": (word - in_class[:, None]).astype(F32),
    }


class _Room:
    """Arrays for the logits of a window, made once; those of classes hold as many rows as a processor's cache takes."""

    def __init__(self, rows: int, v: Vocabulary):
        self.rows = max(128, CACHE // (4 * (v.classes + ENDINGS)))
        self.flat, self.top = np.ones((rows, WIDTH + 1), dtype=F32), np.empty((self.rows, v.classes + ENDINGS), dtype=F32)
        self.word = np.empty((rows // ROWS + v.classes, ROWS, v.size), dtype=F32)

    def classes(self, states: np.ndarray, w: dict[str, np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows, their states and a one behind each, and their logits, which the next rows take the place of."""
        flat, top = self.flat[: len(states)], np.concatenate([w["wc"], w["bc"][None]])
        flat[:, :WIDTH] = states
        for i in range(0, len(flat), self.rows):
            some = flat[i : i + self.rows]
            yield slice(i, i + len(some)), some, np.matmul(some, top, out=self.top[: len(some)])

    def words(self, deep: np.ndarray, kinds: np.ndarray, own: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
        out = np.matmul(deep, own, out=self.word[: len(kinds)])
        out += w["bw"][kinds][:, None, :]
        return out.reshape(-1, out.shape[2])


def _within(w: np.ndarray, b: np.ndarray) -> bool:
    """No logit of states, which lie within one, is cut."""
    return float((np.abs(w).sum(axis=-2) + np.abs(b)).max()) < 60


def _by_class(unit: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units with outputs of their own in pieces of ROWS of one class: their places, the places' numbers in the pieces, the pieces' classes."""
    own = np.flatnonzero(unit < v.outputs)
    kind = (unit[own] // v.size).astype(np.int16)
    order = np.argsort(kind, kind="stable")
    count = np.bincount(kind, minlength=v.classes)
    parts = -(-count // ROWS)
    begin = np.cumsum(parts * ROWS) - parts * ROWS
    at = np.arange(len(own)) + np.repeat(begin - (np.cumsum(count) - count), count)
    return own[order], at, np.repeat(np.arange(v.classes), parts)


def _softmax(x: np.ndarray, scale: float = 1.0, within: bool = False) -> np.ndarray:
    """``scale`` times the probabilities, in place; logits are cut at 60 to both sides, in training and scoring alike, if not ``within``."""
    if not within:
        np.clip(x, F32(-60), F32(60), out=x)
    np.exp(x, out=x)
    x *= (F32(scale) / (x @ np.ones(x.shape[1], dtype=F32)))[:, None]
    return x


def lanes(sequences: list[np.ndarray], start: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences laid into lanes: inputs, targets (-1: none), whether one begins, and owner, each (time, lanes)."""
    sizes = np.array([len(s) for s in sequences])
    count = int(max(1, min(count, sizes.sum() // max(1, sizes.max()) + 1)))
    free, places = np.zeros(count, dtype=np.int64), []
    import heapq

    heap = [(0, k) for k in range(count)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        at, k = heapq.heappop(heap)
        places.append((i, k, at))
        heapq.heappush(heap, (at + int(sizes[i]), k))
        free[k] = at + sizes[i]
    time = int(free.max())
    into, target, owner = np.full((count, time), start, dtype=np.int16), np.full((count, time), -1, dtype=np.int16), np.zeros((count, time), dtype=np.int32)
    begins = np.zeros((count, time), dtype=bool)
    for i, k, at in places:
        s = sequences[i]
        target[k, at : at + len(s)] = s
        into[k, at + 1 : at + len(s)] = s[:-1]
        into[k, at] = start
        begins[k, at] = True
        owner[k, at : at + len(s)] = i
    return tuple(np.ascontiguousarray(x.T) for x in (into, target, begins, owner))  # type: ignore[return-value]


def train(w: dict[str, np.ndarray], sequences: list[np.ndarray], v: Vocabulary, rate: float, width: int = LANES, adam: gru.Adam | None = None) -> None:
    """One pass of truncated backpropagation over sequences of units; ``w`` changes in place."""
    into, target, begins, _ = lanes(sequences, v.outputs + ENDINGS, width)
    h, adam = np.zeros((into.shape[1], WIDTH), dtype=F32), adam or gru.Adam(w, rate)
    layer, room = gru.Layer(STEPS, into.shape[1], WIDTH), _Room(STEPS * into.shape[1], v)
    parts, ones = np.empty((3, STEPS * into.shape[1], WIDTH), dtype=F32), np.ones(STEPS * into.shape[1], dtype=F32)
    deltas = np.empty((STEPS * into.shape[1], WIDTH), dtype=F32)
    for t in range(0, len(into), STEPS):
        x, y, clear = into[t : t + STEPS], target[t : t + STEPS].ravel().astype(np.int32), begins[t : t + STEPS]
        emb, wx, wh = w["emb"].take(x.ravel(), axis=0), gru.apart(w["wx"]), gru.apart(w["wh"])
        a = np.matmul(emb, wx, out=parts[:, : len(emb)])
        a += w["b"].reshape(3, 1, WIDTH)
        states = layer.forward(a.reshape(3, *x.shape, WIDTH), wh, h, clear)
        h = states[-1].copy()
        flat, real = states.reshape(-1, WIDTH), y >= 0
        n = F32(max(1, real.sum()))
        kind = np.where(y < v.outputs, y // v.size, v.classes + y - v.outputs)
        grads = {"ww": np.zeros_like(w["ww"]), "bw": np.zeros_like(w["bw"])}
        top, d, wide, within = np.zeros((WIDTH + 1, v.classes + ENDINGS), dtype=F32), deltas[: len(y)], w["wc"].T, _within(w["wc"], w["bc"])
        for at, some, p in room.classes(flat, w):
            _softmax(p, 1 / n, within)
            p[np.arange(len(p)), kind[at]] -= 1 / n
            if not real[at].all():
                p[~real[at]] = 0
            top += some.T @ p
            np.matmul(p, wide, out=d[at])
        grads["wc"], grads["bc"] = top[:WIDTH], top[WIDTH]
        order, at, kinds = _by_class(np.where(real, y, v.outputs), v)
        mine = np.zeros((len(kinds) * ROWS, WIDTH), dtype=F32)
        mine[at] = flat[order]
        deep = mine.reshape(len(kinds), ROWS, WIDTH)
        own = w["ww"][kinds]
        q = _softmax(room.words(deep, kinds, own, w))
        q[at, y[order] % v.size] -= 1
        used = np.zeros(len(q), dtype=F32)
        used[at] = 1 / n
        q *= used[:, None]
        q = q.reshape(len(kinds), ROWS, v.size)
        if len(kinds):
            first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
            grads["ww"][kinds[first]] = np.add.reduceat(deep.transpose(0, 2, 1) @ q, first, axis=0)
            grads["bw"][kinds[first]] = np.add.reduceat(q.reshape(-1, v.size), first * ROWS, axis=0)
            d[order] += (q @ own.transpose(0, 2, 1)).reshape(-1, WIDTH)[at]
        da, dwh = layer.backward(d.reshape(states.shape), wh, clear)
        da = da.reshape(3, -1, WIDTH)
        grads["wh"], grads["wx"], grads["b"] = gru.together(dwh), gru.together(np.matmul(emb.T, da)), (ones[: len(y)] @ da).ravel()
        d = da[0] @ wx[0].T
        d += da[1] @ wx[1].T
        d += da[2] @ wx[2].T
        grads["emb"] = gru.rows_sum(x.ravel(), d, len(w["emb"]))
        adam.step(grads)


def log_probabilities(w: dict[str, np.ndarray], sequences: list[np.ndarray], v: Vocabulary) -> np.ndarray:
    """Natural log of the units' probabilities, summed for each sequence; the state runs through a whole sequence."""
    into, target, begins, owner = lanes(sequences, v.outputs + ENDINGS, LANES)
    count, within = into.shape[1], (_within(w["wc"], w["bc"]), _within(w["ww"], w["bw"]))
    parts, wh, h, out = gru.apart(w["emb"] @ w["wx"] + w["b"]), gru.apart(w["wh"]), np.zeros((count, WIDTH), dtype=F32), np.zeros(len(sequences))
    read = min(len(into), READ * LANES // count)  # a window has as many words whatever the number of lanes
    layer, room, a = gru.Layer(read, count, WIDTH), _Room(read * count, v), np.empty((3, read, count, WIDTH), dtype=F32)
    for t in range(0, len(into), read):
        x = into[t : t + read]
        for part, to in zip(parts, a):
            part.take(x, axis=0, out=to[: len(x)], mode="clip")
        states = layer.forward(a[:, : len(x)], wh, h, begins[t : t + read])
        h = states[-1].copy()
        y = target[t : t + read].ravel().astype(np.int32)
        real = np.flatnonzero(y >= 0)
        flat, y = states.reshape(-1, WIDTH).take(real, axis=0), y[real]
        kind = np.where(y < v.outputs, y // v.size, v.classes + y - v.outputs)
        score = np.concatenate([_chosen(x, kind[at], within[0]) for at, _, x in room.classes(flat, w)] or [np.zeros(0, dtype=F32)])
        order, at, kinds = _by_class(y, v)
        mine, goal = np.zeros((len(kinds) * ROWS, WIDTH), dtype=F32), np.zeros(len(kinds) * ROWS, dtype=np.int64)
        mine[at], goal[at] = flat[order], y[order] % v.size
        more = _chosen(room.words(mine.reshape(len(kinds), ROWS, WIDTH), kinds, w["ww"][kinds], w), goal, within[1])[at]
        score[order] += more
        out += np.bincount(owner[t : t + read].ravel()[real], weights=score, minlength=len(sequences))
    return out


def _chosen(x: np.ndarray, which: np.ndarray, within: bool) -> np.ndarray:
    """Log of one probability of each row of logits, which are lost."""
    if not within:
        np.clip(x, F32(-60), F32(60), out=x)
    own = x[np.arange(len(x)), which]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], dtype=F32))


def outputs_for(distinct: int) -> int:
    """Words with an output of their own for so many distinct ones: the bound is 2 MB of weights."""
    return min(MOST_OUTPUTS, max(LEAST_OUTPUTS, math.isqrt(distinct)))


def vocabulary(counts: DataFrame, outputs: int | None = None, table_words: int = TABLE) -> Vocabulary:
    """The frequent words (at most ``table_words``, by count, then by their bytes) and the statistics of all words."""
    band = F.floor(F.log2("c") * 8)
    total, distinct, taken, least, cut_band = 0, 0, 0, math.inf, None
    for r in sorted(counts.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect(), key=lambda r: -r["band"]):
        total, distinct = total + r["tokens"], distinct + r["words"]
        if cut_band is None and taken + r["words"] <= table_words:
            taken, least = taken + r["words"], r["band"]
        elif cut_band is None:
            cut_band = r["band"]
    found = counts.where(band >= least).select("word", "c") if taken else counts.limit(0).select("word", "c")
    if cut_band is not None and taken < table_words:  # the band that doesn't fit whole, by count and word
        found = found.unionByName(counts.where(band == cut_band).select("word", "c").orderBy(F.desc("c"), "word").limit(table_words - taken))
    found = found.toArrow()
    frequent = sorted(zip((-c for c in found.column("c").to_pylist()), found.column("word").to_pylist()))

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(ENDINGS, dtype=np.int64), np.zeros(ENDINGS, dtype=np.int64)
        for b in batches:
            e = np.fromiter((ending(w) for w in b.column("word").to_pylist()), dtype=np.int64, count=b.num_rows)
            np.add.at(tokens, e, b.column("c").to_numpy())
            np.add.at(words, e, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS, dtype=np.int32)), pa.array(tokens), pa.array(words)], ["e", "tokens", "words"])

    rows = {r["e"]: [r["t"], r["w"]] for r in counts.mapInArrow(endings, "e int, tokens long, words long").groupBy("e").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).collect()}
    outputs = outputs_for(distinct) if outputs is None else outputs
    for c, word in frequent[:outputs]:
        rows[ending(word)][0] += c
        rows[ending(word)][1] -= 1
    return Vocabulary([w for _, w in frequent], [-c for c, _ in frequent], total, distinct, {e: tuple(x) for e, x in rows.items()}, outputs)


def pieces(sequence: np.ndarray) -> list[np.ndarray]:
    return [sequence] if len(sequence) <= PIECE else [sequence[i : i + PIECE] for i in range(0, len(sequence), PIECE)]


def numbered(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """row, doc_id, place (by hash, below PLACES), units (packed numbers of two bytes), n_tokens, n_known, base, own and strange (words that aren't
    in the table, and how often) for every row of ``docs`` (doc_id, text): what training and scoring need of a text, made once.

    base: the base model's sum over the words of the table; own: what the table's rare words have less than their units.
    """
    mass = np.concatenate([np.zeros(v.outputs), np.log10(v.mass)])
    base_mass = math.log10(v.base_mass)
    rare = np.where(v.unit >= v.outputs, v.log_count - mass[v.unit], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        frequent, table_ = len(v.words), pa.array(v.words, pa.binary())
        for b in batches:
            for first, sizes, words in _words(b):
                n, ends = len(sizes), np.cumsum(sizes + 1) - 1
                words = pa.concat_arrays([words, pa.array([END], pa.binary())])
                which = np.full(len(words) - 1 + n, len(words) - 1)  # every text's words and an end
                inner = np.ones(len(which), dtype=bool)
                inner[ends] = False
                which[inner] = np.arange(len(words) - 1)
                at = pc.fill_null(pc.index_in(words, value_set=table_), frequent).to_numpy(zero_copy_only=False)[which]
                strange = np.flatnonzero(at == frequent)
                kinds = words.take(pa.array(which[strange])).dictionary_encode()
                code, unknown = kinds.indices.to_numpy(), kinds.dictionary
                at[strange] += np.fromiter(map(ending, unknown.to_pylist()), dtype=np.int32, count=len(unknown))[code]
                of = np.repeat(np.arange(n), sizes + 1)[strange]
                pair, times = np.unique(of * max(1, len(unknown)) + code, return_counts=True)
                of_pair, code = np.divmod(pair, max(1, len(unknown)))
                count = lambda x: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]).astype(np.int32)
                unknown_words = pa.ListArray.from_arrays(pa.array(count(of_pair)), pa.StructArray.from_arrays([unknown.take(pa.array(code)), pa.array(times)], ["word", "times"]))
                places = np.concatenate([[0], ends + 1]).astype(np.int32) * PACKED.itemsize
                units = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places), pa.py_buffer(v.unit[at].astype(PACKED))])
                known = sizes + 1 - np.bincount(of, minlength=n)
                base, own = np.add.reduceat(v.log_count[at], ends - sizes) - (sizes + 1) * base_mass, np.add.reduceat(rare[at], ends - sizes)
                columns = map(pa.array, (sizes + 1, known, base, own))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), b.column("doc_id").slice(first, n), b.column("place").slice(first, n), units, *columns, unknown_words], ["row", "doc_id", "place", "units", "n_tokens", "n_known", "base", "own", "strange"])
                row += n

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(PLACES)).alias("place"), "text")
    return ready.mapInArrow(run, "row long, doc_id long, place long, units binary, n_tokens long, n_known long, base double, own double, strange array<struct<word:binary,times:long>>")


def _sequences(column: pa.Array, most: int = SLICE_UNITS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts' units, ``most`` at a time, and the place of the first."""
    first, rows, size = 0, [], 0
    for i, x in enumerate(column):
        rows.append(np.frombuffer(x.as_buffer(), dtype=PACKED))
        size += len(rows[-1])
        if size >= most:
            yield first, rows
            first, rows, size = i + 1, [], 0
    if rows:
        yield first, rows


def learn(texts: DataFrame, v: Vocabulary, rounds: tuple[float, ...] = ROUNDS, rates: tuple[float, ...] = RATES) -> dict[str, np.ndarray]:
    """Weights learnt from all of ``texts`` (place, units), a share ``rounds[r]`` of them in round r, each by local training and averaging."""
    w = fresh(v)
    names, shapes = list(w), {k: x.shape for k, x in w.items()}
    size = sum(x.size for x in w.values())
    edges = np.round(np.cumsum((0, *rounds)) * PLACES).astype(int).tolist()

    def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
        sizes = np.cumsum([math.prod(shapes[k]) for k in names])[:-1]
        return {k: x.reshape(shapes[k]).astype(F32) for k, x in zip(names, np.split(flat[:size], sizes))}

    for r in range(len(rounds) if v.total else 0):
        start, rate = np.concatenate([w[k].ravel() for k in names]), rates[r]

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            own, tokens = unpack(start.copy()), 0
            adam = gru.Adam(own, rate)
            for b in batches:
                for _, found in _sequences(b.column("units")):
                    sequences = [s for x in found for s in pieces(x)]
                    train(own, sequences, v, rate, adam=adam)
                    tokens += sum(map(len, sequences))
            if tokens:
                flat = np.concatenate([own[k].ravel() for k in names] + [np.zeros(-size % CHUNK, dtype=F32)])
                n = len(flat) // CHUNK
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, float(tokens))), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CHUNK), pa.array(flat))], ["n", "i", "w"]
                )

        part = texts.where((F.col("place") >= edges[r]) & (F.col("place") < edges[r + 1])).select("units")
        copies = part.mapInArrow(run, "n double, i int, w array<float>")
        sums = copies.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("w")[k] * F.col("n")).alias(f"w{k}") for k in range(CHUNK)])
        found = sums.select("i", F.array(*[F.col(f"w{k}") / F.col("n") for k in range(CHUNK)]).alias("w")).toArrow()
        if found.num_rows:
            found = found.sort_by("i")
            w = unpack(found.column("w").combine_chunks().flatten().to_numpy().astype(F32))
    return w


def score(texts: DataFrame, v: Vocabulary, w: dict[str, np.ndarray], counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of ``texts``, as numbered() makes them."""
    kept = ("row", "doc_id", "n_tokens", "n_known", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.concatenate([log_probabilities(w, sequences, v) for _, sequences in _sequences(b.column("units"), 2 * SLICE_UNITS)] or [np.zeros(0)])
            own = b.column("own").to_numpy() + found / math.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(own)], [*kept, "own"])

    whole = texts.select(*kept, "units", "own").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, own double")
    # a document's own row has a word that is none and differs from document to document: no key is hot
    whole = whole.select("row", "doc_id", F.concat(F.lit("\n"), F.col("row").cast("string")).cast("binary").alias("word"), F.lit(0).cast("long").alias("times"), "n_tokens", "n_known", "base", "own")
    strange = texts.select("row", F.explode("strange").alias("s")).select("row", F.lit(None).cast("long").alias("doc_id"), "s.word", "s.times", *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known")], *[F.lit(0.0).alias(c) for c in ("base", "own")])
    joined = whole.unionByName(strange).join(counts, "word", "left").withColumn("more", F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5))
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("more")).alias("base_score"), F.sum(F.col("own") + F.col("more")).alias("score"),
    )


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model learns from rows not held out (a condition on doc_id)."""
    counts = cut(word_counts(docs.where(~held_out)))
    v = vocabulary(counts)
    texts = cut(numbered(docs, v))
    scored = score(texts, v, learn(texts.where(~held_out), v), counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), is_held_out(1))
