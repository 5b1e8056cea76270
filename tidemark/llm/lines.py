"""Near-duplicate lines removed by a segment-partition edit join.

A line is the sequence of its words. It is a duplicate if an equal line, or one within t word edits (a word replaced, put in
or left out), stands earlier in (doc_id, line) order; t grows with the words of the shorter line (``STEPS``: none below 8
words, one from 8, two from 20). Duplicates are removed, judged on the input. Lines without words stay.

If two lines are within t edits, one of the t + 1 even segments of the shorter one stands unchanged in the longer one,
at one of a few places (the multi-match-aware choice). Documents are dealt to blocks by a hash of doc_id and text; a block
offers, for each of its distinct lines once, the hashes of its own segments under its length, and of the runs of words
that could be segments of lines up to t words shorter. Most keys come once; only for those that come again in their bucket
does a block send what else is needed. Keys meet in buckets. Equal lines are settled there by their hashes, so a
line that a third of the corpus repeats costs a bucket one entry a block; for the others, the later line's text goes to
the block of the earlier one, where a banded bit-parallel edit distance decides. A candidate must also agree in all but
2 t bits of a signature, the parities of a line's hashed words (an edit changes two at most).

A line needs only one earlier neighbour: in the group of a key each is first held against the ``first_look`` ones of closest
signature, of equally close ones the latest, so that many copies of a line ask many blocks and not the one of the first
copy; only lines that are still open are held against all the rest. In a large group, lines are compared inside parts
only that agree in one of 2 t + 1 stretches of the signature, one of which two lines within t edits have in common. The
same stretches split the keys that very many lines share before they are sent (``heavy``); at most ``MOST_HEAVY`` such keys
are looked for in a share of the documents, in order of their lines. The list only decides on the way.

Defined results: null and empty texts have no line to remove (null stays null); a null doc_id comes after all others; rows
with equal doc_id are ordered by line and block; rows equal in doc_id and text share a block; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.substring import _packed, _unpacked

STEPS, FIRST_LOOK = ((8, 1), (20, 2)), 3
BLOCK_BYTES, BUCKET_BYTES, LOOK_AT_ONE_IN, MOST_HEAVY, LARGE, SMALL, SLICE_BYTES = 4 << 20, 12 << 20, 64, 65_536, 256, 32, 1 << 18
OWN, PROBE, OWN_FIRST = 0, 1, 2
LAST = np.iinfo(np.int64).max
U = np.uint64
_SPACES = bytes.maketrans(b"\t\r\v\f", b"    ")
#: Odd, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def allowed(words: int, steps: tuple[tuple[int, int], ...] = STEPS) -> int:
    """Edits that a line of so many words may be away."""
    return max([0, *(t for least, t in steps if words >= least)])


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, size) of the even segments of a line; the last ones are the longer."""
    parts = threshold + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def patterns(n: int, steps: tuple[tuple[int, int], ...] = STEPS) -> list[tuple[int, int, int, int, int, int]]:
    """(kind, words m of the shorter line, segment, threshold, start, size) of the keys of a line of n words."""
    t = allowed(n, steps)
    out = [(OWN if i else OWN_FIRST, n, i, t, at, size) for i, (at, size) in enumerate(segments(n, t))]
    for m in range(max(1, n - t), n + 1):
        t = allowed(m, steps)
        if t and n - m <= t:
            for i, (at, size) in enumerate(segments(m, t)):
                left, right = i, t - i
                for start in range(max(0, at - left, at + n - m - right), min(n - size, at + left, at + n - m + right) + 1):
                    out.append((PROBE, m, i, t, start, size))
    return out


def within(a: Sequence, b: Sequence, threshold: int) -> bool:
    """Edit distance at most ``threshold``: a column of the band of 2 threshold + 1 diagonals is one machine word."""
    if abs(len(a) - len(b)) > threshold:
        return False
    short = min(len(a), len(b))
    low = 0
    while low < short and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    low, short = 0, short - low
    while low < short and a[-1 - low] == b[-1 - low]:
        low += 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return max(len(a), len(b)) <= threshold
    width = 2 * threshold + 1
    full = (1 << width) - 1
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # bit t of a column j stands for row j - threshold + t; rows above the first one count as reached for nothing
    up, down, distance = full ^ ((1 << threshold) - 1), 0, threshold
    for j, c in enumerate(b):
        shift = j - threshold
        found = where.get(c, 0)
        equal = (found >> shift if shift >= 0 else found << -shift) & full
        zero = ((((equal & up) + up) ^ up) | equal | down) & full
        right, left = down | (full & ~(zero | up)), zero & up
        distance += not zero >> (width - 1) & 1
        moved = zero >> 1
        up, down = left | (full & ~(moved | right)), moved & right
        if distance - width + 1 > threshold:
            return False
    # distance is that of the last diagonal's row len(b) + threshold; step up to row len(a)
    for t in range(width - 1, len(a) - len(b) + threshold, -1):
        distance += (down >> (t - 1) & 1) - (up >> (t - 1) & 1)
    return distance <= threshold


def near(a: bytes, b: bytes, steps: tuple[tuple[int, int], ...] = STEPS) -> bool:
    x, y = a.split(b" "), b.split(b" ")
    return within(x, y, allowed(min(len(x), len(y)), steps))


def _plain(text: bytes) -> bytes:
    """The same words in the same lines, single spaces between them."""
    if b"\t" in text or b"\r" in text or b"\v" in text or b"\f" in text:
        text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class Lines:
    """The distinct lines of a block, numbered in order of their first place, the same whatever the order of rows."""

    def __init__(self, docs: pa.Table):
        docs = docs.append_column("_text", pc.struct_field(docs.column("_row"), "text").cast(pa.binary()))
        self.docs = docs = docs.sort_by([("_id", "ascending"), ("_text", "ascending")])
        ids = docs.column("_id").to_numpy().tolist()
        self.texts = docs.column("_text").to_pylist()
        self.refs: list[list[int]] = []
        index: dict[bytes, int] = {}
        self.doc: list[int] = []
        self.line: list[int] = []
        for k, text in enumerate(self.texts):
            refs = []
            for i, x in enumerate(_plain(text).split(b"\n") if text is not None else ()):
                x = x.strip()
                if not x:
                    refs.append(-1)
                    continue
                r = index.setdefault(x, len(index))
                refs.append(r)
                if r == len(self.doc):
                    self.doc.append(ids[k])
                    self.line.append(i)
            self.refs.append(refs)
        self.distinct = list(index)


def _mixed(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    x = (x ^ salt * U(0xD6E8FEB86659FD93)) * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def stretch(sign: np.ndarray, which: int, threshold: int) -> np.ndarray:
    """One of the 2 threshold + 1 stretches of signatures."""
    parts = 2 * threshold + 1
    low, high = 64 * which // parts, 64 * (which + 1) // parts
    return (sign >> U(low)) & U((1 << (high - low)) - 1)


@lru_cache(1 << 14)
def _pattern_table(n: int, steps: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Rows (kind, salt, threshold, start, size) of the patterns of a line of n words."""
    return np.array([(kind, m * 64 + i, t, start, size) for kind, m, i, t, start, size in patterns(n, steps)], dtype=np.int64)


@cache
def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(2 * SLICE_BYTES, U(base))]))


def keys(distinct: list[bytes], steps: tuple[tuple[int, int], ...] = STEPS, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, kind + 4 threshold, number of the line) of all keys of lines, and the lines' signatures."""
    ends = np.cumsum([0, *(len(x) + 1 for x in distinct)])
    cuts = [0, *np.flatnonzero(np.diff(ends[:-1] // SLICE_BYTES)).tolist(), len(distinct)]
    parts = [_keys(distinct[i:j], i, steps, heavy) for i, j in zip(cuts, cuts[1:]) if j > i]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate((U, np.uint8, np.int64, U)))  # type: ignore[return-value]


def _keys(distinct: list[bytes], number: int, steps: tuple[tuple[int, int], ...], heavy: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of words are runs of bytes: their hashes are differences of running sums of a polynomial, moved to the same place."""
    byte = np.frombuffer(b"\n".join(distinct) + b"\n", dtype=np.uint8)
    powers, back = _powers(BASE), _powers(BACK)
    if len(byte) >= len(powers):  # a line longer than a slice
        powers, back = (np.cumprod(np.concatenate([[U(1)], np.full(len(byte), U(b))])) for b in (BASE, BACK))
    sums = np.concatenate([np.zeros(1, U), np.cumsum((byte.astype(U) + U(1)) * powers[: len(byte)])])
    stop = np.flatnonzero((byte == 32) | (byte == 10))
    start = np.concatenate([[0], stop[:-1] + 1])
    last = np.flatnonzero(byte[stop] == 10)
    sizes = np.diff(np.concatenate([[-1], last]))
    begin = last + 1 - sizes
    word = _mixed((sums[stop] - sums[start]) * back[start], np.zeros(1, U))
    sign = np.bitwise_xor.reduceat(U(1) << (word >> U(58)), begin)
    lengths, which = np.unique(sizes, return_inverse=True)
    tables = [_pattern_table(int(n), steps) for n in lengths]
    table, counts = np.concatenate(tables), np.array([len(t) for t in tables])
    times = counts[which]
    ref = np.repeat(np.arange(len(sizes)), times)
    at = np.arange(len(ref)) - np.repeat(np.cumsum(times) - times, times) + (np.cumsum(counts) - counts)[which[ref]]
    kind, salt, t, first, size = table[at].T
    a, z = begin[ref] + first, begin[ref] + first + size - 1
    key = _mixed((sums[stop[z]] - sums[start[a]]) * back[start[a]], salt.astype(U))
    if heavy is not None and len(heavy):
        hot = np.flatnonzero(heavy[np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)] == key)
        rows = np.repeat(hot, 2 * t[hot] + 1)
        s = np.arange(len(rows)) - np.repeat(np.cumsum(2 * t[hot] + 1) - (2 * t[hot] + 1), 2 * t[hot] + 1)
        own = np.zeros(len(rows), U)
        for threshold in np.unique(t[rows]).tolist():
            for k in range(2 * threshold + 1):
                mine = (t[rows] == threshold) & (s == k)
                own[mine] = stretch(sign[ref[rows[mine]]], k, threshold)
        more = (_mixed(key[rows] ^ own, (1 << 20 | s).astype(U)), np.where((kind[rows] == OWN_FIRST) & (s > 0), OWN, kind[rows]), t[rows], ref[rows])
        cold = np.delete(np.arange(len(key)), hot)
        key, kind, t, ref = (np.concatenate([x[cold], y]) for x, y in zip((key, kind, t, ref), more))
    return key, (kind + 4 * t).astype(np.uint8), ref + number, sign


_SENT = ("u4", "u8", "u8", "i8", "i4", "i4", "u1")


def places(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, and its lower half, which will do in a bucket: what meets there is verified."""
    return ((key >> U(32)) % U(buckets)) << U(32) | (key & U(0xFFFFFFFF))


def _parts(place: np.ndarray) -> list[tuple[int, slice]]:
    """Buckets and their stretches of sorted places."""
    bucket = place >> U(32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(place)]
    return [(int(bucket[i]), slice(i, j)) for i, j in zip(cuts, cuts[1:]) if j > i]


def _distinct(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct places in order; an order of the rows by place, and where each distinct one begins in it."""
    order = np.argsort(place)
    place = place[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
    return place[first], order, first


def offered(place: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places in order, and whether several refs of the block have them."""
    own, order, first = _distinct(place)
    if not len(own):
        return own, np.zeros(0, dtype=bool)
    ref = ref[order]
    return own, np.minimum.reduceat(ref, first) < np.maximum.reduceat(ref, first)


def offer(block: int, place: np.ndarray, ref: np.ndarray) -> pa.Table:
    """bucket, block, load: the keys alone, a few bytes each."""
    own, several = offered(place, ref)
    parts = _parts(own)
    loads = [_packed(np.diff((own[at] & U(0xFFFFFFFF)).astype(np.int64), prepend=0).astype(np.uint32), np.packbits(several[at])) for _, at in parts]
    return pa.table([pa.array([b for b, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int32()), pa.array(loads, pa.binary())], ["bucket", "block", "load"])


def wanted(bucket: int, loads: pa.Table) -> pa.Table:
    """to_block, from_bucket, bits: for each block, which of its keys several lines have, there or in other blocks."""
    own, several = [], []
    for data in loads.column("load"):
        key, bits, _ = _unpacked(data.as_py(), "u4", "u1")
        own.append(np.cumsum(key, dtype=np.uint32))
        several.append(np.unpackbits(bits, count=len(key)).astype(bool))
    every = np.sort(np.concatenate(own))
    common = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[s] for k, s in zip(own, several))]))
    rows = []
    for block, key in zip(loads.column("block").to_pylist(), own):
        hit = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key if len(common) else np.zeros(len(key), dtype=bool)
        if hit.any():
            rows.append((block, bucket, _packed(np.packbits(hit))))
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["to_block", "from_bucket", "bits"])


def chosen(place: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The numbers of the wanted keys, ascending."""
    own, order, first = _distinct(place)
    hit = np.zeros(len(own), dtype=bool)
    at = dict(_parts(own))
    for bucket, bits in zip(answers.column("from_bucket").to_pylist(), answers.column("bits").to_pylist()):
        stretch_ = at[bucket]
        hit[stretch_] = np.unpackbits(_unpacked(bits, "u1")[0], count=stretch_.stop - stretch_.start).astype(bool)
    return np.sort(order[np.repeat(hit, np.diff(first, append=len(place)))])


def _send(block: int, distinct: list[bytes], doc: np.ndarray, line: np.ndarray, answers: pa.Table, steps: tuple[tuple[int, int], ...], buckets: int, heavy: np.ndarray) -> pa.Table:
    """Packed rows for each bucket, of the wanted keys."""
    key, kind, ref, sign = keys(distinct, steps, heavy)
    place = places(key, buckets)
    take = chosen(place, answers)
    place, kind, ref = place[take], kind[take], ref[take]
    used, number = np.unique(ref, return_inverse=True)
    same = np.fromiter((xxhash.xxh3_64_intdigest(distinct[r]) for r in used.tolist()), dtype=U, count=len(used))
    order = np.lexsort((ref, place >> U(32)))
    out: tuple[list, list] = ([], [])
    for bucket, at in _parts((place >> U(32) << U(32))[order]):
        part = order[at]
        r = ref[part]
        out[0].append(bucket)
        out[1].append(_packed(place[part].astype(np.uint32), same[number[part]], sign[r], np.diff(doc[r], prepend=0), line[r], np.diff(r, prepend=0).astype(np.int32), kind[part]))
    return pa.table([pa.array(out[0], pa.int32()), pa.array([block] * len(out[0]), pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "block", "load"])


MET = "bucket int, block int, ref int, other_block int, other_ref int"


def _meet(bucket: int, loads: pa.Table, first_look: int, still: set[tuple[int, int]] | None = None, large: int = LARGE) -> pa.Table:
    """Rows of MET: a line and an earlier candidate, or other_block -1 where an equal line is earlier.

    In the group of a key, a line gets the ``first_look`` candidates of closest signature; other_block -2 tells that
    there are more. With ``still`` (block, ref), these lines get all the others instead.
    """
    parts: list[list[np.ndarray]] = [[] for _ in range(8)]
    for block, data in zip(loads.column("block").to_pylist(), loads.column("load")):
        key, same, sign, doc, line, ref, kind, _ = _unpacked(data.as_py(), *_SENT)
        for to, x in zip(parts, (key, same, sign, np.cumsum(doc), line, np.cumsum(ref, dtype=np.int32), kind, np.full(len(key), block, dtype=np.int32))):
            to.append(x)
    key = np.concatenate(parts[0])
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1], [True]])
    order = np.sort(order[~(new[:-1] & new[1:])])  # keys that come once meet nothing
    kept = []
    while parts:
        kept.append(np.concatenate(parts.pop(0))[order])
    order = np.lexsort((kept[7], kept[4], kept[3], kept[6], kept[1], kept[2], kept[0]))
    key, same, sign, doc, line, ref, kind, block = (x[order] for x in kept)
    out: list[list[np.ndarray]] = [[], [], [], []]

    def put(x: np.ndarray, other: np.ndarray | None, mark: int = 0) -> None:
        for to, y in zip(out, (block[x], ref[x], np.full(len(x), mark) if other is None else block[other], np.full(len(x), mark) if other is None else ref[other])):
            to.append(y)

    def compare(rows: np.ndarray) -> None:
        """``rows`` of one key, in order of place."""
        probing = kind[rows] & 3 == PROBE
        if probing.all() or not probing.any():
            return
        most = 2 * int(kind[rows[0]] >> 2)
        for side in (True, False):
            at, there = np.flatnonzero(probing == side), np.flatnonzero(probing != side)
            mine, other = rows[at], rows[there]
            signs = sign[other]
            for x, n in zip(mine.tolist(), np.searchsorted(there, at).tolist()):
                if not n or (still is not None and (int(block[x]), int(ref[x])) not in still):
                    continue
                far = np.bitwise_count(signs[:n] ^ sign[x])
                found = np.flatnonzero(far <= most)
                found = found[(far[found] > 0) | (same[other[found]] != same[x])]
                if len(found) > first_look:
                    found = found[np.lexsort((-found, far[found]))]
                    if still is None:
                        put(np.array([x]), None, -2)
                found = other[found[:first_look] if still is None else found[first_look:]]
                put(np.full(len(found), x), found)

    def compare_small(rows: np.ndarray, count: np.ndarray, most: np.ndarray) -> None:
        """As compare(), for all small groups at once; ``count`` rows each."""
        if not len(rows):
            return
        group = np.repeat(np.arange(len(count)), count)
        rows = rows[np.lexsort((block[rows], line[rows], doc[rows], group))]
        probing, mine = kind[rows] & 3 == PROBE, (block[rows].astype(np.int64) << 32) | ref[rows]
        open_ = None if still is None else np.isin(mine, np.array([b << 32 | r for b, r in still], dtype=np.int64))
        pairs = []
        for d in range(1, int(count.max())):
            at = np.flatnonzero((group[d:] == group[:-d]) & (probing[d:] != probing[:-d]) & (True if open_ is None else open_[d:]))
            x, other = rows[at + d], rows[at]
            far = np.bitwise_count(sign[x] ^ sign[other])
            take = (far <= most[group[at]]) & ((far > 0) | (same[x] != same[other]))
            pairs.append(np.stack([at + d, at, far])[:, take])
        x, other, far = np.concatenate(pairs, axis=1)
        by = np.lexsort((-other, far, x))
        x, other = x[by], other[by]
        begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
        times = np.diff(begin, append=len(x))
        rank = np.arange(len(x)) - np.repeat(begin, times)
        if still is None:
            put(rows[x[begin[times > first_look]]], None, -2)
        take = rank < first_look if still is None else rank >= first_look
        put(rows[x[take]], rows[other[take]])

    if len(key):
        like = np.concatenate([[False], (key[1:] == key[:-1]) & (same[1:] == same[:-1]) & (sign[1:] == sign[:-1])])
        again = like & np.concatenate([[False], kind[1:] == kind[:-1]])
        if still is None:
            put(np.flatnonzero(again & (kind & 3 == OWN_FIRST)), None, -1)
        keep = np.flatnonzero(~again)
        first = np.flatnonzero(np.concatenate([[True], key[keep][1:] != key[keep][:-1]]))
        ends = np.concatenate([first[1:], [len(keep)]])
        texts = np.add.reduceat((~like[keep]).astype(np.int64), first)
        count, threshold = ends - first, kind[keep[first]] >> 2
        some = (texts > 1) & (threshold > 0)
        small = some & (count <= min(SMALL, large))
        compare_small(keep[np.repeat(small, count)], count[small], 2 * threshold[small].astype(np.int64))
        for g in np.flatnonzero(some & ~small).tolist():
            rows = keep[first[g] : ends[g]]
            t = int(threshold[g])
            rows = rows[np.lexsort((block[rows], line[rows], doc[rows]))]
            if len(rows) <= large:
                compare(rows)
                continue
            for s in range(2 * t + 1):
                v = stretch(sign[rows], s, t)
                by = np.argsort(v, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(v[by])) + 1):
                    if len(part) > 1:
                        compare(rows[part])
    found = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, dtype=np.int32) for x in out]
    return pa.table([pa.array(np.full(len(found[0]), bucket, dtype=np.int32)), *map(pa.array, found)], ["bucket", "block", "ref", "other_block", "other_ref"])


def _stored(store: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """First places (doc, line) and texts of a block's distinct lines."""
    doc, line, tail = _unpacked(store.column("lines")[0].as_py(), "i8", "i4")
    return doc, line, tail.split(b"\n") if len(doc) else []


class _Join:
    def __init__(self, docs: DataFrame, steps: tuple[tuple[int, int], ...], block_bytes: int, bucket_bytes: int, one_in: int):
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks, self.buckets = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / bucket_bytes))
        # one frame for all steps, so that its shuffle is made once and used again
        self.docs = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("_id"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.blocks)).cast("int").alias("block"))
        self.steps = steps
        self.heavy = self._heavy(max(2, math.ceil(bucket_bytes / (40 * one_in))), one_in)

    def _heavy(self, least: int, one_in: int) -> np.ndarray:
        """Keys of so many different lines in a share of the documents that all of them would fill a bucket."""
        steps = self.steps

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    key, kind, _, _ = keys(Lines(pa.Table.from_batches([b.slice(i, 512)])).distinct, steps)
                    key, n = np.unique(key[kind & 3 != PROBE], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

        part = self.docs.where(F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(one_in)) == 0)
        sums = part.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return np.sort(np.array([r["key"] for r in sums.orderBy(F.desc("n"), "key").limit(MOST_HEAVY).collect()], dtype=np.int64).view(U))

    def dropped(self, first_look: int, large: int) -> DataFrame:
        """block, ref of the lines of which an equal or near one is earlier."""
        steps, buckets, heavy = self.steps, self.buckets, self.heavy

        def keep(key: tuple, docs: pa.Table) -> pa.Table:
            lines = Lines(docs)
            packed = _packed(np.array(lines.doc, dtype=np.int64), np.array(lines.line, dtype=np.int32), tail=b"\n".join(lines.distinct))
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], ["block", "lines"])

        def first(key: tuple, store: pa.Table) -> pa.Table:
            found, _, ref, _ = keys(_stored(store)[2], steps, heavy)
            return offer(key[0].as_py(), places(found, buckets), ref)

        def common(key: tuple, loads: pa.Table) -> pa.Table:
            return wanted(key[0].as_py(), loads)

        def send(key: tuple, store: pa.Table, answers: pa.Table) -> pa.Table:
            doc, line, distinct = _stored(store)
            return _send(key[0].as_py(), distinct, doc, line, answers, steps, buckets, heavy)

        def meet(key: tuple, loads: pa.Table) -> pa.Table:
            return _meet(key[0].as_py(), loads, first_look, None, large)

        def meet_rest(key: tuple, loads: pa.Table, still: pa.Table) -> pa.Table:
            if not still.num_rows:
                return pa.Table.from_batches([], pa.schema([(c, pa.int32()) for c in ("bucket", "block", "ref", "other_block", "other_ref")]))
            return _meet(key[0].as_py(), loads, first_look, set(zip(still.column("block").to_pylist(), still.column("ref").to_pylist())), large)

        def settle(found: pa.Table) -> pa.Table:
            """bucket, block, ref once: bucket -1 for the lines that go, the bucket of the others that have more candidates there."""
            ref, bucket = found.column("ref").to_numpy(), found.column("bucket").to_numpy()
            gone = np.unique(ref[bucket < 0])
            more = np.unique(np.stack([bucket, ref])[:, (bucket >= 0) & ~np.isin(ref, gone)], axis=1)
            bucket, ref = np.concatenate([np.full(len(gone), -1, dtype=np.int32), more[0]]), np.concatenate([gone, more[1]])
            return pa.table([pa.array(bucket), pa.array([found.column("block")[0].as_py()] * len(ref), pa.int32()), pa.array(ref)], ["bucket", "block", "ref"])

        # each block's distinct lines in one packed row, which is read again by all steps
        self.store = self.docs.groupBy("block").applyInArrow(keep, "block int, lines binary")
        offers = self.store.groupBy("block").applyInArrow(first, "bucket int, block int, load binary")
        answers = offers.groupBy("bucket").applyInArrow(common, "to_block int, from_bucket int, bits binary")
        sent = self.store.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(send, "bucket int, block int, load binary")
        # what meets goes through one shuffle, marks and all, and is told apart behind it: no step runs once for each kind of row
        settled = self._near(sent.groupBy("bucket").applyInArrow(meet, MET)).groupBy("block").applyInArrow(settle, "bucket int, block int, ref int")
        rest = sent.groupBy("bucket").cogroup(settled.where("bucket >= 0").groupBy("bucket")).applyInArrow(meet_rest, MET)
        return settled.where("bucket < 0").unionByName(self._near(rest)).select("block", "ref")

    def _near(self, met: DataFrame) -> DataFrame:
        """block, ref, bucket: -1 for the lines that are near a candidate or marked as such, else that of a mark -2."""
        steps = self.steps

        def ask(store: pa.Table, pairs: pa.Table) -> pa.Table:
            """A line once for each block that has candidates of it, with their refs."""
            refs: dict[tuple[int, int], set[int]] = {}
            marks: set[tuple[int, int]] = set()
            for r, to, other, bucket in zip(*(pairs.column(c).to_pylist() for c in ("ref", "other_block", "other_ref", "bucket"))):
                if to < 0:
                    marks.add((r, bucket if to == -2 else -1))
                else:
                    refs.setdefault((to, r), set()).add(other)
            gone = {r for r, bucket in marks if bucket < 0}
            refs = {k: x for k, x in refs.items() if k[1] not in gone}
            lines, block = _stored(store)[2] if refs else [], pairs.column("block")[0].as_py() if pairs.num_rows else 0
            none, n = [None] * len(marks), len(refs) + len(marks)
            return pa.table(
                [
                    pa.array([to for to, _ in refs] + [block] * len(marks), pa.int32()), pa.array([block] * n, pa.int32()), pa.array([r for _, r in refs] + [r for r, _ in marks], pa.int32()), pa.array([-1] * len(refs) + [b for _, b in marks], pa.int32()),
                    pa.array([sorted(x) for x in refs.values()] + none, pa.list_(pa.int32())), pa.array([lines[r] for _, r in refs] + none, pa.binary()),
                ],
                ["to_block", "block", "ref", "bucket", "others", "line"],
            )

        def answer(store: pa.Table, asked: pa.Table) -> pa.Table:
            """Lines that are near one of their candidates, and the marks as they came."""
            lines = _stored(store)[2] if asked.column("line").null_count < asked.num_rows else []
            hit = [x is None or any(near(x, lines[o], steps) for o in others) for x, others in zip(asked.column("line").to_pylist(), asked.column("others").to_pylist())]
            return asked.select(["block", "ref", "bucket"]).filter(pa.array(hit, pa.bool_()))

        asked = self.store.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(ask, "to_block int, block int, ref int, bucket int, others array<int>, line binary")
        return self.store.groupBy("block").cogroup(asked.groupBy("to_block")).applyInArrow(answer, "block int, ref int, bucket int")


def remove_lines(docs: DataFrame, steps: tuple[tuple[int, int], ...] = STEPS, first_look: int = FIRST_LOOK, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, one_in: int = LOOK_AT_ONE_IN, large: int = LARGE) -> DataFrame:
    """row (the columns of ``docs``), n_lines, n_removed, kept_text for every row of ``docs``."""
    join = _Join(docs, steps, block_bytes, bucket_bytes, one_in)
    dropped = join.dropped(first_look, large)

    def apply(docs: pa.Table, dropped: pa.Table) -> pa.Table:
        lines = Lines(docs)
        gone = np.zeros(len(lines.distinct) + 1, dtype=bool)  # one more for lines without words
        gone[dropped.column("ref").to_numpy()] = True
        seen, kept, removed = gone.tolist(), [], []
        for text, refs in zip(lines.texts, lines.refs):
            out = []
            for i, r in enumerate(refs):
                if r < 0 or not seen[r]:
                    out.append(i)
                    if r >= 0:
                        seen[r] = True
            rows = text.split(b"\n") if len(out) < len(refs) else []
            kept.append(text if len(out) == len(refs) else b"\n".join([rows[i] for i in out]))
            removed.append(len(refs) - len(out))
        sizes = pa.array([len(x) for x in lines.refs], pa.int64())
        return pa.table([lines.docs.column("_row"), sizes, pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_lines", "n_removed", "kept_text"])

    schema = f"row {join.docs.schema['_row'].dataType.simpleString()}, n_lines long, n_removed long, kept_text string"
    return join.docs.groupBy("block").cogroup(dropped.groupBy("block")).applyInArrow(apply, schema)


def op9_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
