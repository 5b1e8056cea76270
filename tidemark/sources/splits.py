"""Large JSON documents read by many tasks: the elements of one array of the root object, whatever the layout of the file.

A file is cut into byte ranges. Whether a range begins inside a string, and how deep, is found exactly: each range counts its quotes
and brackets for both cases, and a running sum over the ranges settles which one holds. A second pass counts the elements of each
range, so that every element has its place in the array. Each range is then a partition of a Python data source; it
returns the elements that begin in it and reads on to the end of the last one. Escapes, key order, blanks and nested objects need no care.

The driver holds one short row for each range. Files that fit into one range are read without the two passes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES, LOOK_BACK, BATCH_BYTES = 32 << 20, 1 << 16, 4 << 20
_QUOTE, _BACKSLASH = 34, 92
_SIGN = np.zeros(256, dtype=np.int8)
_SIGN[[ord("{"), ord("[")]], _SIGN[[ord("}"), ord("]")]] = 1, -1


@dataclass
class Range(InputPartition):
    """Bytes of a file, and what is true where they begin: inside a string, depth, inside the array, elements before."""

    path: str
    start: int
    end: int
    in_string: int = 0
    depth: int = 0
    in_array: bool = False
    seq: int = 0


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _read(path: str, start: int, end: int) -> bytes:
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        return f.read_at(end - start, start)


def brackets(data: bytes, skip: int, in_string: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places (from ``skip`` on) and signs of the brackets outside strings, and the number of quotes; ``in_string`` holds at ``skip``."""
    a = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(a[skip:] == _QUOTE) + skip
    escaped = np.zeros(len(quotes), dtype=bool)
    for i in np.flatnonzero((quotes > 0) & (a[quotes - 1] == _BACKSLASH)):
        at = quotes[i] - 1
        while at >= 0 and a[at] == _BACKSLASH:
            at -= 1
        escaped[i] = (quotes[i] - 1 - at) % 2 == 1
    quotes = quotes[~escaped]
    at = np.flatnonzero(_SIGN[a[skip:]]) + skip
    at = at[(np.searchsorted(quotes, at) + in_string) % 2 == 0]
    return at, _SIGN[a[at]], len(quotes)


def _levels(data: bytes, skip: int, r: Range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets, their signs, and the depth behind each."""
    at, sign, _ = brackets(data, skip, r.in_string)
    return at, sign, r.depth + np.cumsum(sign, dtype=np.int64)


def _opens_array(data: bytes, at: int, key: str) -> bool:
    return data[at : at + 1] == b"[" and re.search(rb'"' + re.escape(key.encode()) + rb'"\s*:\s*\Z', data[max(0, at - LOOK_BACK) : at]) is not None


def _walk(data: bytes, skip: int, r: Range, key: str) -> tuple[list[tuple[int, int]], list[tuple[int, str]], bool, bool]:
    """Places of the elements that begin here (their end, or -1), of the array's ends ("open", "close"), whether the array goes on, and
    whether the last element is still open."""
    at, sign, depth = _levels(data, skip, r)
    marks, inside, found = [], r.in_array, []
    # members of the root open from depth 1 to 2 and close from 2 to 1; elements of an array open from 2 to 3 and close from 3 to 2
    some = np.flatnonzero(((sign > 0) & ((depth == 2) | (depth == 3))) | ((sign < 0) & ((depth == 1) | (depth == 2))))
    for i in some.tolist():
        p, s, d = int(at[i]), int(sign[i]), int(depth[i])
        if s > 0 and d == 2:
            inside = _opens_array(data, p, key)
            if inside:
                marks.append((p, "open"))
        elif s < 0 and d == 1:
            if inside:
                marks.append((p, "close"))
            inside = False
        elif inside and s > 0:
            found.append((p, -1))
        elif inside and found and found[-1][1] < 0:
            found[-1] = (found[-1][0], p + 1)
    return found, marks, inside, bool(found) and found[-1][1] < 0


def _with_context(r: Range) -> tuple[bytes, int]:
    """The bytes of a range behind some that stand before it, and how many these are."""
    before = min(LOOK_BACK, r.start)
    return _read(r.path, r.start - before, r.end), before


def plan(spark: SparkSession, files: list[tuple[str, int]], key: str, range_bytes: int) -> tuple[list[Range], list[tuple[str, list[tuple[int, int]]]]]:
    """The ranges of files (path, bytes) with what holds at their beginnings, and for each file the bytes outside the array."""
    ranges = [Range(p, a, min(size, a + range_bytes)) for p, size in files for a in range(0, size, range_bytes)]
    several = [r for p, size in files if size > range_bytes for r in ranges if r.path == p]

    def over(rows: list[Range], task, schema: str) -> list:
        """``task`` of every range, one Spark task each."""
        if not rows:
            return []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column("id").to_pylist():
                    yield pa.RecordBatch.from_pylist([{"id": i, **task(rows[i])}], schema=wanted)

        frame = spark.range(0, len(rows), 1, len(rows))
        wanted = pa.schema([("id", pa.int64()), *[(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in schema.split(", "))]])
        return sorted(frame.mapInArrow(run, "id long, " + schema).collect(), key=lambda x: x["id"])  # one short row for each range

    def count(r: Range) -> dict:
        data, skip = _with_context(r)
        _, outside, quotes = brackets(data, skip, 0)
        _, inside, _ = brackets(data, skip, 1)
        return {"quotes": quotes, "outside": int(outside.sum()), "inside": int(inside.sum())}

    def elements(r: Range) -> dict:
        data, skip = _with_context(r)
        # elements before, between and behind the array's ends, if a range begins inside the array and if not
        out = {}
        for name, there in (("no", False), ("yes", True)):
            found, marks, goes_on, _ = _walk(data, skip, Range(r.path, r.start, r.end, r.in_string, r.depth, there), key)
            out[name] = json.dumps([len(found), [(r.start - skip + p, m) for p, m in marks], goes_on])
        return out

    state: dict[str, tuple[int, int]] = {}
    for r, c in zip(several, over(several, count, "quotes long, outside long, inside long")):
        r.in_string, r.depth = state.get(r.path, (0, 0))
        state[r.path] = ((r.in_string + c["quotes"]) % 2, r.depth + (c["inside"] if r.in_string else c["outside"]))
    ends: dict[str, list[tuple[int, str]]] = {p: [] for p, _ in files}
    seen: dict[str, tuple[bool, int]] = {}
    for r, e in zip(several, over(several, elements, "no string, yes string")):
        r.in_array, r.seq = seen.get(r.path, (False, 0))
        number, marks, goes_on = json.loads(e["yes" if r.in_array else "no"])
        ends[r.path] += marks
        seen[r.path] = (goes_on, r.seq + number)
    rest = []
    for p, size in files:
        if size <= range_bytes:
            rest.append((p, [(-1, size)]))  # found out by the reader
        else:
            rest.append((p, _outside(ends[p], size)))
    return ranges, rest


def _outside(marks: list[tuple[int, str]], size: int) -> list[tuple[int, int]]:
    """Byte ranges without the insides of the array."""
    out, begin = [], 0
    for p, m in marks:
        if m == "open":
            out.append((begin, p + 1))
        else:
            begin = p
    return [*out, (begin, size)]


def _extent(coordinates: object) -> tuple[float, float, float, float] | None:
    """West, south, east, north of nested coordinates."""
    todo, xs, ys = [coordinates], [], []
    while todo:
        c = todo.pop()
        if isinstance(c, dict):
            todo += [c[k] for k in ("coordinates", "geometries") if k in c]
            if "lon" in c and "lat" in c:
                xs.append(c["lon"])
                ys.append(c["lat"])
        elif isinstance(c, list) and len(c) >= 2 and all(isinstance(v, (int, float)) for v in c[:2]):
            xs.append(c[0])
            ys.append(c[1])
        elif isinstance(c, list):
            todo += c
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


class _Wanted:
    """What the reader keeps: elements whose geometry reaches into a box, and whose text at a path matches a pattern."""

    def __init__(self, box: list[float] | None, path: list[str] | None, pattern: str | None):
        self.box, self.path, self.pattern = box, path, re.compile(pattern) if pattern else None

    def __call__(self, text: bytes) -> bool:
        if self.box is None and self.pattern is None:
            return True
        try:
            e = json.loads(text)
        except ValueError:
            return True  # as malformed rows are elsewhere: kept, with NULLs
        if self.pattern is not None:
            value = e
            for k in self.path or ():
                value = value.get(k) if isinstance(value, dict) else None
            if not isinstance(value, str) or not self.pattern.search(value):
                return False
        if self.box is not None:
            own, (west, south, east, north) = _extent(e.get("geometry")), self.box
            return own is not None and own[0] <= east and own[2] >= west and own[1] <= north and own[3] >= south
        return True


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.key, self.kind = options["key"], options["kind"]
        self.parts = json.loads(options["parts"])
        self.wanted = _Wanted(json.loads(options.get("box", "null")), json.loads(options.get("match_path", "null")), options.get("match"))

    def partitions(self) -> list[InputPartition]:
        return [Range(*p) if self.kind == "elements" else _Rest(*p) for p in self.parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, _Rest):
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([0], pa.int64()), pa.array([partition.text(self.key)])], ["path", "seq", "element"])
            return
        data, skip = _with_context(partition)
        found, _, _, open_ = _walk(data, skip, partition, self.key)
        more, at = 1 << 16, partition.end
        while open_:  # to the end of the last element
            tail = _read(partition.path, at, at + more)
            if not tail:
                break
            data, at, more = data + tail, at + len(tail), more * 2
            begin = found[-1][0]
            place, _, depth = _levels(data[begin:], 0, Range("", 0, 0, 0, 0))
            closed = np.flatnonzero(depth == 0)
            if len(closed):
                found[-1], open_ = (begin, begin + int(place[closed[0]]) + 1), False
        rows: list[tuple[int, bytes]] = []
        size = 0
        for i, (a, b) in enumerate(found):
            text = data[a:b] if b > 0 else data[a:]
            if self.wanted(text):
                rows.append((partition.seq + i, text))
                size += len(text)
            if rows and (size >= BATCH_BYTES or i + 1 == len(found)):
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array([s for s, _ in rows], pa.int64()), pa.array([t.decode("utf-8", "replace") for _, t in rows])], ["path", "seq", "element"])
                rows, size = [], 0


@dataclass
class _Rest(InputPartition):
    """A document without the elements of the array."""

    path: str
    pieces: list[tuple[int, int]]

    def text(self, key: str) -> str:
        pieces = self.pieces
        if pieces and pieces[0][0] < 0:
            size = pieces[0][1]
            _, marks, _, _ = _walk(_read(self.path, 0, size), 0, Range(self.path, 0, size), key)
            pieces = _outside(marks, size)
        return b"".join(_read(self.path, a, b) for a, b in pieces).decode("utf-8-sig", "replace")


class JsonArraySource(DataSource):
    """path, seq, element (JSON text)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_json_array"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("element", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]] | None:
    """Path and bytes of the files at ``path`` (a file, a folder or a pattern), by Spark's own file system; None where Python can't open them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], list(fs.globStatus(where) or [])
    while todo:
        s = todo.pop()
        name = s.getPath().getName()
        if s.isDirectory():
            todo += list(fs.listStatus(s.getPath()))
        elif not name.startswith(("_", ".")) and s.getLen():
            found.append((s.getPath().toString(), s.getLen()))
    try:
        for p, _ in found[:1]:
            opened(p.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", p) else p)
    except (pa.ArrowException, OSError, ValueError):
        return None
    return sorted((p.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", p) else p, n) for p, n in found)


def json_array(spark: SparkSession, files: list[tuple[str, int]], key: str, box: tuple[float, float, float, float] | None = None, match: tuple[list[str], str] | None = None, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rest, elements) of JSON documents: path, seq, element; ``rest`` has each document without what is in its root's array ``key``.

    box: west, south, east, north; match: keys down to a text, and a pattern. Both are applied by the readers.
    """
    spark.dataSource.register(JsonArraySource)
    ranges, rest = plan(spark, files, key, range_bytes)

    def frame(kind: str, parts: list) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], JsonArraySource({}).schema())
        r = spark.read.format(JsonArraySource.name()).option("key", key).option("kind", kind).option("parts", json.dumps(parts))
        if kind == "elements" and box is not None:
            r = r.option("box", json.dumps(list(box)))
        if kind == "elements" and match is not None:
            r = r.option("match_path", json.dumps(match[0])).option("match", match[1])
        return r.load()

    return frame("rest", rest), frame("elements", [[r.path, r.start, r.end, r.in_string, r.depth, r.in_array, r.seq] for r in ranges])
