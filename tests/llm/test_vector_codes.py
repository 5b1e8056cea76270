import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import vector_codes


def brute(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and the codebooks of vectors of one length, with every distance computed."""
    kept = sorted(((math.inf if i is None else i, [math.floor(1024 * x) for x in v]) for i, v in rows))
    d = len(kept[0][1])
    cuts = [(i * d // parts, (i + 1) * d // parts) for i in range(parts)]
    books = [[v[a:b] for _, v in kept[:entries]] for a, b in cuts]
    near = lambda p, book: min((sum((x - y) ** 2 for x, y in zip(p, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for k, (a, b) in enumerate(cuts):
            own = {}
            for _, v in kept:
                own.setdefault(near(v[a:b], books[k])[1], []).append(v[a:b])
            books[k] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else e for i, e in enumerate(books[k])]
    mark = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = []
    for i, v in rows:
        w = [math.floor(1024 * x) for x in v]
        best = [near(w[a:b], books[k]) for k, (a, b) in enumerate(cuts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(x for x, _ in best), mark))
    return out


def coded(spark, rows, **how):
    df = spark.createDataFrame([(i, v, t, 1) for i, v, t in rows], "vec_id long, embedding array<float>, label int, code int").repartition(3)
    return vector_codes.with_label_error(vector_codes.encode(df, "vec_id", "embedding", "label", **how))


def test_annulus_equals_all_distances_and_evaluates_fewer():
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (200, 5))
    entries[50:80] = entries[10]  # equal entries: the lowest index
    entries[90] = 0
    rows = np.concatenate([rng.integers(-300, 300, (500, 5)), entries[:20], np.zeros((1, 5), dtype=np.int64)])
    code, far, tried = vector_codes.Annulus(entries).nearest(rows)
    whole = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()
    assert tried < 0.9 * whole.size


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(400), [float(np.float32(rng.gauss(0, 0.2))) for _ in range(10)], rng.choice([None, 1, 2])) for _ in range(380)]
    rows += [(None, [0.5] * 10, 1)] * 3 + [(1000 + i, [0.125] * 10, 7) for i in range(200)] + [rows[0], rows[0]]
    bad = [(5000, None, 1), (5001, [0.1, None] * 5, 1), (5002, [float("nan")] * 10, 2), (5003, [float("-inf")] * 10, None)]
    got = coded(spark, rows + bad).collect()
    want = brute([(i, v) for i, v, _ in rows])
    by = {}
    for (_, _, e, _), (_, _, label) in zip(want, rows):
        by[label] = by.get(label, 0) + e
    assert sorted(map(repr, ((r["id"], r["code"], r["error"], r["codebooks_sha256"], r["label_error"]) for r in got))) == sorted(map(repr, ((*w, by[r[2]]) for w, r in zip(want, rows))))


def test_few_rows_lengths_and_empty_tables(spark):
    short, long = [(i, [0.1 * i, -0.2]) for i in range(5)], [(i, [0.3 * i] * 8) for i in range(3)]
    got = coded(spark, [(i, v, 0) for i, v in short + long] + [(9, [], 0)]).collect()
    want = brute(short) + brute(long)
    assert sorted((r["id"], r["code"], r["error"], r["codebooks_sha256"]) for r in got if r["id"] != 9) == sorted(want)
    assert [(r["code"], r["error"]) for r in got if r["id"] == 9] == [("00000000", 0)]
    assert coded(spark, []).count() == 0 and coded(spark, [(1, None, 1)]).count() == 0


def test_numbers_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="doesn't fit into 64 bits"):
        coded(spark, [(1, [1e30, 1.0, 1.0, 1.0], 0), (2, [0.0] * 4, 0)])
