import random

from tidemark.llm import substring


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Und", "é", "a b"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))] for _ in range(6)]
    rows = [(None, " ".join(passages[0])), (3, None), (4, ""), (5, "Und " * 400), (9, "Und " * 30), (11, "short text")]
    for d in range(20, 120):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary[:4] if rng.random() < 0.3 else vocabulary) for _ in range(rng.randrange(1, 40))]
        rows.append((d, (" " if d % 2 else "\n ").join(text)))
    rows += [rows[20], rows[21], (rows[22][0], rows[30][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    for one_in in (1, 2, 64):
        assert (len(substring.heavy_minimisers(docs, 13, 3, 400, one_in)) > 0) == (one_in < 64)
        out = substring.remove_repeats(docs, block_bytes=5000, bucket_bytes=400 if one_in < 64 else 4000, one_in=one_in)
        assert sorted([tuple(r) for r in out.collect()], key=repr) == brute(rows, 13)


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
