import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import conversations

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
LEGAL = {"su", "ua", "au"}


def cheapest(rows, faults):
    """Every sequence of edits that costs no more than deleting all rows: cost, initials, turns."""
    best = (4 * len(rows), "D" * len(rows), [])

    def go(i, cost, audit, turns):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows):
            if GRAMMAR.match("".join(r[:1] or "-" for r, _ in turns)):
                best = min(best, (cost, audit, turns))
        else:
            role, text = rows[i]
            more = 3 * (faults[i] == "truncated")
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, cost + more, audit + "K", [*turns, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + more + 3, audit + "R", [*turns, (other, text)])
            go(i + 1, cost + 4, audit + "D", turns)
        if len(turns) < len(rows) + 3:
            for other in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*turns, (other, "")])

    go(0, 0, "", [])
    return best


def brute(table):
    """Damage and repair of (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
        cost, audit, repaired = cheapest([r[1:] for r in rows], faults)
        mark = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, mark))
    return sorted(map(repr, out))


def conversation(rng, conv, n):
    rows = []
    for t in range(n):
        role = ["system", "user", "assistant"][min(t, 1 + (t + 1) % 2)] if rng.random() < 0.6 else rng.choice(["user", "assistant", "system", "user", "tool", "", None, "Aide", "u"])
        rows.append((conv, rng.choice([t, t, t, t + 3, 2, None]), role, rng.choice(["yes.", "yes.", "go on", "é!", "", " \t\n", None, "a.\x0b", "x ", f"turn {t}?"])))
    return rows


def check(spark, table, **limits):
    df = spark.createDataFrame([(*r, 9) for r in table], "conv_id long, turn long, role string, text string, at int").repartition(3)
    got = conversations.digests(conversations.repair(conversations.damage(df), **limits))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(table)


@pytest.fixture(scope="module")
def small_table():
    rng = random.Random(31)
    table = [r for conv in range(160) for r in conversation(rng, conv, rng.randrange(1, 5))]
    return table + conversation(rng, None, 3) + [(900, t, "user", "all gone.") for t in range(200) if zlib.crc32(f"900:{t}".encode()) % 20 == 0] + [(901, None, None, None)] * 3


def test_against_all_edits(spark, small_table):
    check(spark, small_table)


def test_large_conversations_give_the_same(spark, small_table):
    check(spark, small_table, most_rows=1)
    check(spark, small_table, most_rows=10_000, most_bytes=12)


def test_blocks_give_what_one_search_gives(monkeypatch):
    rng = random.Random(5)
    for _ in range(150):
        steps = [(rng.choice("suaut"), rng.choice([0, 0, 0, 3, None]), 1) for _ in range(rng.randrange(12))]
        steps = [(i, p, rng.randrange(1, 4) if p is None else 1) for i, p, _ in steps]
        monkeypatch.setattr(conversations, "BLOCK", 10**6)
        want = conversations.cheapest(steps)
        monkeypatch.setattr(conversations, "BLOCK", rng.randrange(1, 5))
        assert conversations.cheapest(steps) == want


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(9)
    table = [(7, t // 3, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"turn {t}.", f"turn {t % 50}.", f"cut {t}", "", "same.", f"turn {t}!"])) for t in range(3000)]
    table += [(8, 1, "user", "again.")] * 2000 + [(8, 2, "assistant", "yes."), (9, 1, "user", "hm.")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    damaged = conversations.damage(df)
    one = sorted(map(tuple, conversations.digests(conversations.repair(damaged)).collect()))
    for limits in ({"most_rows": 50}, {"most_bytes": 500}):
        assert sorted(map(tuple, conversations.digests(conversations.repair(damaged, **limits)).collect())) == one
    turns = conversations.repair(damaged, most_rows=50).where("at > 0 and conv_id = 7").orderBy("at").collect()
    assert [r["at"] for r in turns] == list(range(1, len(turns) + 1)) and GRAMMAR.match("".join(r["role"][:1] for r in turns))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digests(conversations.repair(conversations.damage(df))).count() == 0
