import random
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.llm import packing


def test_boundaries_equal_exhaustive_search():
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        k = rng.randrange(1, 5)

        def padding(upper):
            return sum(n * (min(u for u in upper if u >= x) - x) for x, n in zip(lengths, counts))

        best = min(padding((*c, lengths[-1])) for c in combinations(lengths[:-1], min(k, len(lengths)) - 1))
        got = packing.boundaries(lengths, counts, k)
        assert got[-1] == lengths[-1] and padding(got) == best and len(got) == min(k, len(lengths))


def test_pieces_and_batches(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 70)), "x") for i in range(300)] + [(None, None, "x"), (5, "", "x"), (5, "", "x"), (7, "long " * 500, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    out = packing.pack(docs, packing.word_tokens(F.col("text")), max_len=64, buckets=4, token_budget=256).collect()
    total = sum(len((t or "").split()) + 1 for _, t, _ in rows)
    assert sum(r["n_tokens"] for r in out) == total
    seen = set()
    for r in out:
        assert r["n_tokens"] <= r["padded_len"] <= 64 and r["start_token"] == 64 * r["piece"]
        place = (r["bucket"], r["batch"], r["slot"])
        assert place not in seen and r["slot"] < 256 // r["padded_len"]
        seen.add(place)
    for b in {r["bucket"] for r in out}:
        own = sorted(p[1:] for p in seen if p[0] == b)
        room = 256 // next(r["padded_len"] for r in out if r["bucket"] == b)
        assert own == [(i // room, i % room) for i in range(len(own))]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, packing.word_tokens(F.col("text"))).count() == 0
