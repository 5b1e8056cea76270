import random

import numpy as np

from tidemark.llm import decontaminate as d


def words(text):
    return [w for w in (x.strip(d.MARKS) for x in (text or "").encode().lower().split()) if w]


def plain_tiles(a, b, least):
    """Greedy tiling by trying every pair of places."""
    used_a, used_b, covered = set(), set(), 0
    while True:
        best = []
        longest = least - 1
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > longest:
                    longest, best = n, [(i, j)]
                elif n == longest and n >= least:
                    best.append((i, j))
        if not best:
            return covered
        for i, j in best:
            if not (used_a & set(range(i, i + longest)) or used_b & set(range(j, j + longest))):
                used_a |= set(range(i, i + longest))
                used_b |= set(range(j, j + longest))
                covered += longest


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(12, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "one two three"), (None, "x y z"), (None, " ".join(text(25))), (60, "w1 w2 w3"), (61, "w1, W2 w3!")]
    assert items[-3][0] is None
    docs = [(70, items[-3][1]), (71, "say x y z"), (72, "about w1 w2 w3 w4"), (1, None), (2, ""), (3, "one, TWO three!"), (4, "one two"), (None, items[0][1])]
    for i in range(60):
        item = rng.choice(items[:12])[1].split()
        kind = i % 5
        if kind == 0:
            body = text(80)
        elif kind == 1:
            body = text(20) + item + text(20)
        elif kind == 2:
            k = len(item) // 2
            body = item[k:] + text(7) + item[:k]
        elif kind == 3:
            body = [w.upper() + "," if rng.random() < 0.5 else w for w in item]
            body[len(body) // 2] = "changed"
        else:
            body = [w if n % 4 else "other" for n, w in enumerate(item)]
        docs.append((100 + i, (" " if i % 2 else "\n").join(body)))
    return items, docs + [docs[6]]


def test_against_brute_force(spark):
    items, docs = corpus()
    want = []
    for doc_id, text in docs:
        a, hits = words(text), []
        for item_id, item in items:
            b = words(item)
            if b:
                covered = plain_tiles(a, b, min(5, len(b)))
                if covered >= 0.8 * len(b):
                    hits.append((-covered / len(b), item_id is None, item_id or 0))
        best = min(hits) if hits else None
        want.append((doc_id, int(bool(hits)), best and (None if best[1] else best[2]), best and round(-best[0], 9)))
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, _t1 string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["contaminated"], r["item_id"], r["coverage"] and round(r["coverage"], 9)) for r in d.flag(frame, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[1:3] for r in want if r[0] in (70, 71)} == {(1, None)} and next(r[2] for r in want if r[0] == 72) == 60
    kept = d.keep_clean(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(not w[1] for w in want)


def test_tiles_against_all_pairs_and_repetitive_texts(spark):
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(1, 40))] for _ in range(2))
        size = min(3, len(b))
        hits = [(i, j) for i in range(len(a) - size + 1) for j in range(len(b) - size + 1) if a[i : i + size] == b[j : j + size]]
        i, j = (np.array([h[k] for h in hits], dtype=np.int64) for k in (0, 1))
        assert sum(n for _, _, n in d.tiles(i, j, size)) == plain_tiles(a, b, size)
    docs = spark.createDataFrame([(1, "again " * 20_000), (2, "word " * 3 + "again " * 30), (3, "x " * 20_000 + "again " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "again " * 50)], "item_id long, text string")
    assert sorted((r["doc_id"], r["contaminated"], r["coverage"]) for r in d.flag(docs, bench).collect()) == [(1, 1, 1.0), (2, 0, None), (3, 1, 1.0)]


def test_many_found_texts_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b"), (1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(4, "b c d e f")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in d.flag(docs, bench).collect() if r["contaminated"]) == [(1, 4), (1, 4)]
    assert [r["doc_id"] for r in d.keep_clean(docs, bench).collect()] == [2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["item_id"] for r in d.flag(docs, bench).collect()] == [None]
    assert d.flag(docs.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
