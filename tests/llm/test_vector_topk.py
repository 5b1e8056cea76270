import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import vector_topk


def brute(rows, k=5):
    """Each query row against every other row."""
    want = []
    for at, (q, x) in enumerate(rows):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for n, (i, v) in enumerate(rows) if n != at and len(v) == len(x))
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(want)


def test_against_brute_force_with_hot_odd_and_repeated_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.25] * 6) for i in range(400, 600)] + [(700, None), (750, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (800, [float("nan")] * 6), (850, [float("inf")] * 6), (None, [0.1] * 6), (900, [0.5, 0.5]), (901, [0.1, 0.9]), (950, [])]
    rows += [(1000, [90.0] * 6), (1000, [-90.0] * 6), (1000, [1e6, 1.0, 1.0, 1.0, 1.0, 1.0])] + [(50, rows[50][1])] * 6 + [(7, rows[50][1])] * 2 + [(50, rows[3][1]), (450, [0.25] * 6), (100, [0.25] * 6)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, cell int").repartition(3)
    vectors = vector_topk.quantized(df, "vec_id", "embedding")
    whole = [(r["id"], r["v"]) for r in vectors.collect()]
    assert not {700, 750, 800, 850} & {i for i, _ in whole}
    assert sorted(map(tuple, vector_topk.top_k_inner(vectors, F.col("id") % 50 == 0, 5).collect())) == brute(whole)


def test_one_id_in_seven_rows(spark):
    rows = [(50, [1.0, 0.0])] * 7 + [(51, [1.0, 0.5]), (52, [0.5, 0.5]), (53, [1.0, 0.0])]
    vectors = vector_topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = sorted(map(tuple, vector_topk.top_k_inner(vectors, F.col("id") % 50 == 0, 5).collect()))
    assert got == brute([(i, [int(256 * x) for x in v]) for i, v in rows]) and len(got) == 35


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_topk.top_k_inner(vector_topk.quantized(df, "vec_id", "embedding"), F.col("id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("large", [1e30, 1e10])
def test_numbers_beyond_64_bits_are_an_error(spark, large):
    rows = [(50, [large, 1.0]), (51, [large, 2.0]), (52, [0.0, 1.0])]
    vectors = vector_topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    with pytest.raises(Exception, match="doesn't fit into 64 bits"):
        vector_topk.top_k_inner(vectors, F.col("id") % 50 == 0, 5).collect()


def test_large_components_with_scores_that_fit(spark):
    rows = [(50, [3e5, 1.0, -2e5]), (51, [4e5, 2.0, 1.0]), (52, [-1e5, 1.0, 5e5]), (100, [7.0, -7e5, 1.0])]
    vectors = vector_topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert sorted(map(tuple, vector_topk.top_k_inner(vectors, F.col("id") % 50 == 0, 5).collect())) == brute([(i, [int(256 * x) for x in v]) for i, v in rows])
