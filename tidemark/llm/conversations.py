"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar.

A conversation's rows stand in the order of their turns. Its roles must begin with an optional system turn, then user and assistant
alternate and the assistant speaks last; no turn at all is right too. A row can be kept (0), given the role that fits (3) or
deleted (4), and an empty turn of the role that fits can be put in anywhere (3); blank rows and repetitions must be deleted; a row
that breaks off costs 3 more unless it is deleted. Of the cheapest ways the one counts whose edits' initials are least as a text.

The way is found by Dijkstra's search on an implicit lattice: a node is a row's index and a state of the grammar, the priority is the
pair (cost, initials so far), and the first accepting end node that is taken from the queue ends the search. The pair grows
along every edge, and of two ways to one node none of equal cost begins with the other, so the smaller one stays smaller whatever follows.

Conversations of up to ``most_rows`` rows and ``most_bytes`` bytes are gathered by one shuffle and repaired as a sorted stream, so a task
holds one of them at a time. Larger ones are dealt by ranges of the rows' order, so that one of them is spread over many tasks; each
task searches from every state in front of its rows to every state behind them, and these tables are put together in order. Equal rows are
one row with a count, and rows that repeat an earlier turn are found by a join. Only the written turns of a large conversation pass
through one task, as a stream, since their positions and their hash are sequential; its initials are one value of the result.

Defined results: a null role or text is one space; a row of an empty role can't be kept as it is; null turns come first; rows of one turn are ordered by role, then text; rows
with a null conv_id are one conversation; a conversation whose rows have no copies (all were dropped) is reported with zeros, no edits and
no turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

MOST_ROWS, MOST_BYTES, BLOCK, BATCH_BYTES, SMALL_TABLE = 65_536, 64 << 20, 256, 1 << 20, 10_000
REROLE, DELETE, INSERT, BROKEN_OFF = 3, 4, 3, 3

#: States of the grammar: nothing yet, behind the system turn, behind a user's, behind an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES, ACCEPTING = (NONE, SYSTEM, USER, ASSISTANT), (NONE, ASSISTANT)
KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FITTING = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
MARKED = re.compile(r"[.!?]\Z")

#: One or more rows in the search: initial of the role, cost of not deleting it (None: it must be deleted), number of rows.
Step = tuple[str, "int | None", int]
#: Cost and initials of the way from a state to a state.
Ways = dict[tuple[int, int], tuple[int, str]]


def search(steps: list[Step], begin: int, goals: Iterable[int] | None = None) -> Ways:
    """The best ways from ``begin`` before the steps to the states behind them; without ``goals`` only to the best accepting one."""
    wanted = set(goals) if goals is not None else None
    found: Ways = {}
    queue, done = [(0, "", 0, begin)], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(steps):
            if wanted is None and state in ACCEPTING:
                return {(begin, state): (cost, audit)}
            if wanted is not None and state in wanted:
                found[begin, state] = (cost, audit)
                if len(found) == len(wanted):
                    return found
        else:
            initial, price, times = steps[i]
            heapq.heappush(queue, (cost + DELETE * times, audit + "D" * times, i + 1, state))
            if price is not None:
                if (state, initial) in KEPT:
                    heapq.heappush(queue, (cost + price, audit + "K", i + 1, KEPT[state, initial]))
                heapq.heappush(queue, (cost + price + REROLE, audit + "R", i + 1, FITTING[state]))
        if (i, FITTING[state]) not in done:
            heapq.heappush(queue, (cost + INSERT, audit + "I", i, FITTING[state]))
    return found


def behind(first: Ways, second: Ways) -> Ways:
    """The best ways through ``first``, then ``second``."""
    out: Ways = {}
    for (a, b), (c1, w1) in first.items():
        for (b2, e), (c2, w2) in second.items():
            if b == b2 and ((a, e) not in out or (c1 + c2, w1 + w2) < out[a, e]):
                out[a, e] = (c1 + c2, w1 + w2)
    return out


def ways(steps: list[Step], entries: Iterable[int]) -> Ways:
    """The best ways from each of ``entries`` to every state, found block by block."""
    out: Ways = {(s, s): (0, "") for s in entries}
    for i in range(0, len(steps), BLOCK):
        block: Ways = {}
        for s in {e for _, e in out}:
            block |= search(steps[i : i + BLOCK], s, STATES)
        out = behind(out, block)
    return out


def cheapest(steps: list[Step]) -> tuple[int, str]:
    if len(steps) <= BLOCK:
        return next(iter(search(steps, NONE).values()))
    return min(v for (_, e), v in ways(steps, (NONE,)).items() if e in ACCEPTING)


@dataclass
class Tally:
    """Counts of faults over rows in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None
    steps: list[Step] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str, repeated: bool, times: int) -> None:
        initial, shown = role[:1], text.rstrip(BLANKS)
        if turn is not None and turn != self.high:
            self.turns, self.high, self.low = self.turns + 1, turn, turn if self.low is None else self.low
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (times - 1) * (initial + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if not shown or repeated:
            self.blank, self.duplicate = self.blank + times * (not shown), self.duplicate + times * bool(shown)
            self.steps.append((initial, None, times))
            return
        broken = not MARKED.search(shown)
        self.truncated += broken
        self.steps.append((initial, BROKEN_OFF * broken, 1))
        if times > 1:
            self.duplicate += times - 1
            self.steps.append((initial, None, times - 1))

    def merge(self, later: Tally) -> None:
        """Takes in the counts of rows that follow."""
        self.blank, self.duplicate, self.truncated = self.blank + later.blank, self.duplicate + later.duplicate, self.truncated + later.truncated
        self.illegal += later.illegal + (self.last is not None and later.first is not None and self.last + later.first not in LEGAL)
        self.turns += later.turns - (later.low is not None and later.low == self.high)
        self.low, self.high = later.low if self.low is None else self.low, self.high if later.high is None else later.high
        self.first, self.last = later.first if self.first is None else self.first, self.last if later.last is None else later.last

    def report(self, cost: int, audit: str) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


class Writer:
    """Turns out of rows and the initials of the edits."""

    def __init__(self) -> None:
        self.state, self.letters = NONE, iter(())

    def _put(self, role: str, text: str) -> tuple[str, str]:
        self.state = FITTING[self.state] if role == "" else KEPT[self.state, role[:1]]
        return role or ROLE[self.state], text

    def follow(self, audit: str) -> Iterator[tuple[str, str]]:
        """What is still to be put in behind the last row; then ``audit`` holds for the rows that follow."""
        for _ in self.letters:
            yield self._put("", "")
        self.letters = iter(audit)

    def row(self, role: str, text: str, times: int) -> Iterator[tuple[str, str]]:
        while times:
            letter = next(self.letters)
            times -= letter != "I"
            if letter != "D":
                yield self._put(role if letter == "K" else "", "" if letter == "I" else text)


REPORT = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"
_REPORT = pa.struct([(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES of text."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _turn_batches(rows: Iterator[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    return _batches(rows, ["conv_id", "at", "role", "text", "report"], [kind, pa.int64(), pa.string(), pa.string(), _REPORT])


def _whole(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Repairs conversations that follow each other whole (conv_id, turn, role, text, copies)."""

    def out() -> Iterator[tuple]:
        for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            tally, own, seen = Tally(), [], set()
            for _, turn, role, text, copies in rows:
                if copies:
                    tally.add(turn, role, text, (role, text) in seen, copies)
                    seen.add((role, text))
                    own.append((role, text, copies))
            cost, audit = cheapest(tally.steps)
            yield conv, 0, None, None, tally.report(cost, audit)
            writer, at = Writer(), itertools.count(1)
            for turn in itertools.chain(writer.follow(audit), *(writer.row(*r) for r in own), writer.follow("")):
                yield conv, next(at), *turn, None

    return _turn_batches(out(), kind)


_WAYS = pa.list_(pa.struct([("a", pa.int32()), ("e", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]


def _pieces(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """For each conversation's rows in one range (conv_id, turn, role, text, copies, repeated, part): the counts and the best ways."""

    def out() -> Iterator[tuple]:
        for (conv, part), rows in itertools.groupby(_rows(batches), key=lambda r: (r[0], r[6])):
            tally, best = Tally(), {(s, s): (0, "") for s in STATES}
            for _, turn, role, text, copies, repeated, _ in rows:
                tally.add(turn, role, text, repeated, copies)
                if len(tally.steps) >= BLOCK:
                    best, tally.steps = behind(best, ways(tally.steps, STATES)), []
            best = behind(best, ways(tally.steps, STATES))
            yield conv, part, *(getattr(tally, c) for c in _COUNTS), tally.first, tally.last, [{"a": a, "e": e, "cost": c, "audit": w} for (a, e), (c, w) in best.items()]

    return _batches(out(), ["conv_id", "part", *_COUNTS, "first", "last", "ways"], [kind, pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), _WAYS])


def _joined(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The report of a conversation (part -1) and the initials of each of its pieces, from the pieces in order."""

    def out() -> Iterator[tuple]:
        for conv, pieces in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            tally, best = Tally(), {NONE: (0, "", None)}  # cost, initials, and the pieces' initials as a chain
            for _, part, *counts, first, last, steps in pieces:
                tally.merge(Tally(**dict(zip(_COUNTS, counts)), first=first, last=last))
                now: dict[int, tuple] = {}
                for w in steps:
                    if w["a"] in best:
                        cost, audit, chain = best[w["a"]]
                        if w["e"] not in now or (cost + w["cost"], audit + w["audit"]) < now[w["e"]][:2]:
                            now[w["e"]] = (cost + w["cost"], audit + w["audit"], (chain, part, w["audit"]))
                best = now
            cost, audit, chain = min((v for s, v in best.items() if s in ACCEPTING), key=lambda v: v[:2])
            yield conv, -1, None, tally.report(cost, audit)
            while chain is not None:
                chain, part, own = chain
                yield conv, part, own, None

    return _batches(out(), ["conv_id", "part", "audit", "report"], [kind, pa.int32(), pa.string(), _REPORT])


def _written(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Turns from a conversation's report, and each part's initials before its rows (conv_id, role, text, copies, audit, report)."""

    def out() -> Iterator[tuple]:
        for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            writer, at = Writer(), itertools.count(1)
            for _, role, text, copies, audit, report in rows:
                if report is not None:
                    yield conv, 0, None, None, report
                else:
                    for turn in writer.follow(audit) if audit is not None else writer.row(role, text, copies):
                        yield conv, next(at), *turn, None
            for turn in writer.follow(""):
                yield conv, next(at), *turn, None

    return _turn_batches(out(), kind)


def repair(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """conv_id, at, role, text, report: for each conversation of ``rows`` (conv_id, turn, role, text, copies) a row with at = 0 and
    its report (gaps, blank, duplicate, truncated, illegal, cost, audit), then its repaired turns with at = 1, 2, ...

    A partition holds whole conversations, each in this order.
    """
    spark, name = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    kind = pa.string() if name == "string" else {"bigint": pa.int64(), "int": pa.int32()}[name]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"))
    weight = F.sum(F.col("copies") * (F.octet_length("role") + F.octet_length("text")))
    large = cut(rows.groupBy(F.col("conv_id").alias("_large")).agg(F.sum("copies").alias("_n"), weight.alias("_bytes")).where((F.col("_n") > most_rows) | (F.col("_bytes") > most_bytes)).select("_large"))
    number = large.count()
    is_large = rows["conv_id"].eqNullSafe(large["_large"])
    if number <= SMALL_TABLE:
        large = F.broadcast(large)
    order = F.concat("role", F.lit("\0"), "text")
    small = rows.join(large, is_large, "left_anti") if number else rows
    turns = f"conv_id {name}, at long, role string, text string, report {REPORT}"
    done = small.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), order).mapInArrow(lambda b: _whole(b, kind), turns)
    return done.unionByName(_repair_large(rows.join(large, is_large, "left_semi").where("copies > 0"), order, name, kind, turns)) if number else done


def _repair_large(rows: DataFrame, order: Column, name: str, kind: pa.DataType, turns: str) -> DataFrame:
    each = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    key = F.sha2(F.concat_ws("\0", F.coalesce(F.col("conv_id").cast("string"), F.lit("\1")), "role", "text"), 256)
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = each.groupBy(key.alias("key")).agg(F.min(when).alias("first"))
    marked = each.withColumn("key", key).join(first, "key").withColumn("repeated", when > F.col("first"))
    # a range never parts rows by more than the beginning of role and text, and equal rows are one
    ranged = marked.repartitionByRange("conv_id", F.asc_nulls_first("turn"), F.substring(order, 1, 64)).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), order)
    ranged = cut(ranged.select("conv_id", "turn", "role", "text", "copies", "repeated", F.spark_partition_id().alias("part")))
    steps = f"conv_id {name}, part int, {', '.join(f'{c} long' for c in _COUNTS)}, first string, last string, ways array<struct<a:int,e:int,cost:long,audit:string>>"
    pieces = ranged.mapInArrow(lambda b: _pieces(b, kind), steps)
    joined = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lambda b: _joined(b, kind), f"conv_id {name}, part int, audit string, report {REPORT}")
    both = ranged.drop("repeated").withColumn("behind", F.lit(1)).unionByName(joined.withColumn("behind", F.lit(0)), allowMissingColumns=True)
    sorted_ = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "behind", F.asc_nulls_first("turn"), order)
    return sorted_.select("conv_id", "role", "text", "copies", "audit", "report").mapInArrow(lambda b: _written(b, kind), turns)


def digests(repaired: DataFrame) -> DataFrame:
    """Each conversation's report with repaired_sha256, the hash of its turns ``role:text`` joined by line feeds; no shuffle."""
    name = dict(repaired.dtypes)["conv_id"]
    kind = pa.string() if name == "string" else {"bigint": pa.int64(), "int": pa.int32()}[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                mark, found = hashlib.sha256(), None
                for _, at, role, text, report in rows:
                    if at:
                        mark.update(f"{chr(10) if at > 1 else ''}{role}:{text}".encode())
                    else:
                        found = report
                yield conv, found, mark.hexdigest()

        return _batches(out(), ["conv_id", "report", "repaired_sha256"], [kind, _REPORT, pa.string()])

    return repaired.mapInArrow(run, f"conv_id {name}, report {REPORT}, repaired_sha256 string").select("conv_id", "report.*", "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32(conv_id:turn) modulo 20 (0: no copy is left, 1: no text, 2: no marks, 3: twice, 4: role user)."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(how == 0, F.lit(None)).when(how == 1, F.lit("")).when(how == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(how == 0, F.lit(None)).when(how == 4, F.lit("user")).otherwise(shown("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"))


def op13_dijkstra_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damage(table(spark, sf_dir, "conversations"))))
