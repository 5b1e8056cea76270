import random
from collections import defaultdict

import xxhash
from pyspark.sql import types as T

from tidemark.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("key", T.StringType())])


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(prints)):
        groups[find(i)].append(prints[i][0])
    return {d: min(g) for g in groups.values() for d in g}


def test_code_reaches_every_close_pair():
    nearest, near = simhash.code_keys()
    rng = random.Random(1)
    for _ in range(3000):
        x = rng.getrandbits(16)
        y = x ^ (1 << rng.randrange(16)) if rng.random() < 0.9 else x
        assert nearest[x] in near[y]
    assert {int((r >= 0).sum()) for r in near} <= {1, 6}


def test_links_equal_brute_force(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randrange(5)):
            for _ in range(rng.randrange(1, 5)):
                base ^= 1 << rng.randrange(64)
            prints.add(base)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    unsigned = lambda x: x & (1 << 64) - 1
    assert found == {(min(a, b), max(a, b)) for (a,) in signed for (b,) in signed if a < b and (unsigned(a) ^ unsigned(b)).bit_count() <= 3}


def test_documents_against_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Émile", "ÉCOLE", "a b", "\x1cq"]
    texts = [None, "", " \t\n", "One", "one", "one two", "x " * 5000]
    for _ in range(25):
        t = [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        texts.append(" ".join(t))
        if rng.random() < 0.6:
            t[rng.randrange(len(t))] = "changed"
            texts.append("\n".join(t))
    texts += texts[7:12]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    plain = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in out} == dict(plain)
    assert {r["doc_id"]: r["component_id"] for r in out} == plain_components(plain)


def test_rows_without_an_id(spark):
    same, other = "the river rose over night", "another text of its own that nobody repeats"
    rows = [(None, same, "x", "x"), (7, same, "x", "x"), (5, same, "x", "x"), (None, other, "x", "x"), (None, None, "x", "x"), (9, " ", "x", "x")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in out) == sorted([("None", "5"), ("7", "5"), ("5", "5"), ("None", "None"), ("None", "9"), ("9", "9")])


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
