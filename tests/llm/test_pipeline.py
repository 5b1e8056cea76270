import random

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("corpus"))
    words = ["".join(rng.choice(["ta", "re", "mi", "no", "la"]) for _ in range(3)) for _ in range(300)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    bench = [(i, text(3)) for i in range(5)]
    docs = [(d, text(rng.randrange(2, 9))) for d in range(200)]
    junk = {d for d in range(0, 200, 7)}
    docs = [(d, " ".join(w.upper() + "!!$" for w in t.split()) if d in junk else t) for d, t in docs]
    docs += [(300, text(2) + "\n" + bench[2][1]), (301, docs[5][1]), (302, docs[5][1] + " more"), (303, None), (304, "")]
    rows = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(d not in junk), 0) for d in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_do_their_part(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {d for d in range(200) if d % 7}
    assert len(good - set(seen["quality_classifier"])) <= 1 and len(set(range(0, 200, 7)) & set(seen["quality_classifier"])) <= 1
    lines = seen["line_dedup"]
    assert set(lines) == set(seen["quality_classifier"]) and lines[301]["text"] == "" and lines[5]["text"].count("\n") >= 1 and lines[301]["n_chars"] == 0
    near = seen["near_duplicates"]
    assert 5 in near and sum(not r["text"] for r in near.values()) <= 1 and len(good - set(near)) <= 2
    assert 300 in near and 300 not in seen["decontamination"] and set(near) - set(seen["decontamination"]) == {300}
    assert set(seen["packing"]) == set(seen["decontamination"])


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


def test_sql_of_the_operators(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got, want = QUERIES[name](spark, sf), con.sql(sql)
        order = sorted(want.columns)
        pick = lambda columns, rows: sorted(repr([r[columns.index(c)] for c in order]) for r in rows)
        assert sorted(got.columns) == order and pick(got.columns, [tuple(r) for r in got.collect()]) == pick(want.columns, want.fetchall()), name
