import random

import numpy as np

from tidemark.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        kind, i = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out.insert(i, rng.choice("abcé"))
        elif kind == 1:
            out[i] = rng.choice("abcé")
        elif len(out) > 1:
            del out[i]
    return out


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(6000):
        t = rng.randrange(1, 4)
        a = [rng.choice("abc") for _ in range(rng.randrange(1, 18))]
        b = edited(rng, a, rng.randrange(1, t + 3)) if rng.random() < 0.8 else [rng.choice("abc") for _ in range(rng.randrange(1, 18))]
        assert lines.within(a, b, t) == (distance(a, b) <= t)


def test_lines_within_the_threshold_share_a_key():
    rng = random.Random(2)
    for steps in (lines.STEPS, ((4, 1), (9, 2), (14, 3))):
        for _ in range(1500):
            a = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))]
            b = edited(rng, a, rng.randrange(0, 4))
            t = lines.allowed(min(len(a), len(b)), steps)
            if distance(a, b) > t:
                continue
            short, long = sorted((" ".join(a).encode(), " ".join(b).encode()), key=lambda x: x.count(b" "))
            for heavy in (None, "own"):
                if heavy:
                    key, kind, _, _ = lines.keys([short], steps)
                    heavy = np.sort(key[kind & 3 != lines.PROBE])
                key, kind, ref, sign = lines.keys([short, long], steps, heavy)
                probe = kind & 3 == lines.PROBE
                assert set(key[~probe & (ref == 0)].tolist()) & set(key[(probe if t else ~probe) & (ref == 1)].tolist())
                assert int(sign[0] ^ sign[1]).bit_count() <= 2 * t
                assert any((lines.stretch(sign[:1], s, t) == lines.stretch(sign[1:], s, t)).all() for s in range(2 * t + 1))


def brute(rows, steps):
    """Each line against every earlier one; ``rows`` have different doc_ids."""
    places = []
    for k, (d, t) in enumerate(rows):
        for i, x in enumerate([] if t is None else t.split("\n")):
            if x.split():
                places.append(((d is None, d or 0), i, k, x.split()))
    gone = set()
    for p in places:
        for q in places:
            if q[:3] < p[:3] and (q[3] == p[3] or distance(q[3], p[3]) <= lines.allowed(min(len(q[3]), len(p[3])), steps)):
                gone.add((p[2], p[1]))
                break
    out = []
    for k, (d, t) in enumerate(rows):
        own = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(own) if (k, i) not in gone]
        out.append((d, len(own), len(own) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 6)))
    common = [[word() for _ in range(n)] for n in (5, 8, 9, 12, 19, 20, 21, 40)]
    hot = "every page of this long book ends with the very same line".split()
    rows = [(None, " ".join(common[3])), (1, None), (2, ""), (3, "short\nshort\n short \n\nshört"), (4, " ".join(word() for _ in range(3000)))]
    rows.append((5, f"{rows[-1][1]} more"))
    for d in range(10, 70):
        text = []
        for _ in range(rng.randrange(1, 5)):
            r = rng.random()
            text.append(" ".join(rng.choice(common) if r < 0.2 else edited(rng, rng.choice(common), rng.randrange(1, 4)) if r < 0.6 else [word() for _ in range(rng.randrange(1, 25))]))
        text.append(" ".join(hot) if d % 3 else f"  {' '.join(hot[:-1])}\t {d:04d} " if d % 2 else " ".join([*hot[:-4], f"{d}x", f"{d}y", f"{d}z", "line"]))
        rows.append((d, "\n".join(text)))
    return rows


def test_against_brute_force(spark):
    for seed, steps, look, one_in, large in ((1, lines.STEPS, 8, 64, 256), (2, lines.STEPS, 1, 1, 4), (3, ((4, 1), (9, 2), (14, 3)), 1, 64, 4), (4, ((6, 1),), 3, 2, 256)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string").repartition(3)
        out = lines.remove_lines(docs, steps, first_look=look, block_bytes=800, bucket_bytes=4000 if one_in == 64 else 80, one_in=one_in, large=large)
        got = sorted([(r["row"]["doc_id"], r["n_lines"], r["n_removed"], r["kept_text"]) for r in out.collect()], key=repr)
        assert got == brute(rows, steps)


def test_equal_ids_repeated_rows_and_empty_table(spark):
    rows = [(1, "the same line in the same row of both"), (1, "the same line in the same row of both"), (1, "one\nthe same line in the same row of both"), (1, "two\none"), (None, "two"), (None, "three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lines.remove_lines(docs, block_bytes=10).collect()
    assert sum(r["n_lines"] - r["n_removed"] for r in out) == 4 and len(out) == 6
    assert {x for r in out for x in r["kept_text"].split("\n") if x} == {"one", "two", "three", rows[0][1]}
    assert lines.remove_lines(docs.limit(0)).count() == 0


def test_keys_meet_in_one_step_for_all_kinds_of_rows(spark):
    docs = spark.createDataFrame([(d, t) for d, t in corpus(1) if d is not None], "doc_id long, text string")
    out = lines.remove_lines(docs, first_look=1, block_bytes=800, bucket_bytes=4000)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Final Plan" in final and final.count(" meet(") == 1


def test_small_groups_at_once_equal_groups_one_by_one(monkeypatch):
    distinct = sorted({x for _, t in corpus(5) if t for x in t.encode().split(b"\n") if x})
    at = np.arange(len(distinct)) % 3
    parts = [[x for x, k in zip(distinct, at) if k == b] for b in range(3)]
    none = np.zeros(0, np.uint64)
    offers = [lines.offer(b, lines.places(key, 1), ref) for b, p in enumerate(parts) for key, _, ref, _ in [lines.keys(p)]]
    answers = lines.wanted(0, lines.pa.concat_tables(offers))
    loads = []
    for b, p in enumerate(parts):
        mine = answers.filter(lines.pc.equal(answers.column("to_block"), b))
        loads.append(lines._send(b, p, np.arange(len(p)) * 7 % 11, np.arange(len(p), dtype=np.int32), mine, lines.STEPS, 1, none))
    loads = lines.pa.concat_tables(loads)
    for look in (0, 1, 3):
        found = []
        for small in (lines.SMALL, 0):
            monkeypatch.setattr(lines, "SMALL", small)
            first = lines._meet(0, loads, look)
            still = {(r["block"], r["ref"]) for r in first.to_pylist() if r["other_block"] == -2}
            found.append([sorted(map(tuple, (r.values() for r in t.to_pylist()))) for t in (first, lines._meet(0, loads, look, still))])
        monkeypatch.undo()
        assert found[0] == found[1] and found[0][0] and (look or found[0][1])


def test_blanks_between_words():
    for text in (b"", b"a  b", b" \t a\v\fb\r\n\r\n  c     d ", b"a\x1cb\xc2\x85"):
        assert [x.split() for x in lines._plain(text).split(b"\n")] == [x.split() for x in text.split(b"\n")] and b"  " not in lines._plain(text)
