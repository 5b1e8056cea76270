import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import gru, gru_lm, quality, toxicity
from tidemark.llm.common import is_held_out


def test_gradients_of_the_recurrent_layer():
    rng = np.random.default_rng(1)
    a, wh = rng.standard_normal((5, 3, 12)).astype(np.float32), (rng.standard_normal((4, 12)) * 0.5).astype(np.float32)
    keep, h = np.ones((5, 3), np.float32), rng.standard_normal((3, 4)).astype(np.float32)
    keep[2, 1] = 0
    target = rng.standard_normal((5, 3, 4)).astype(np.float32)
    states, kept = gru.forward(a, wh, h, keep)
    da, dwh = gru.backward(target, kept, wh, keep)
    assert np.allclose(states, gru.run(a, wh, h, keep), atol=1e-6)
    loss = lambda x, w: float((gru.forward(x, w, h, keep)[0].astype(np.float64) * target).sum())
    for where, grad, which in (((1, 1, 5), da, 0), ((4, 0, 11), da, 0), ((2, 7), dwh, 1), ((0, 1), dwh, 1)):
        both = []
        for e in (1e-2, -1e-2):
            x, w = a.copy(), wh.copy()
            (x if which == 0 else w)[where] += e
            both.append(loss(x, w))
        assert abs((both[0] - both[1]) / 2e-2 - grad[where]) < 2e-2


def texts(n, seed):
    rng = random.Random(seed)
    topics = [[f"{p}{i}" for i in range(40)] for p in ("alpha", "beta", "gamma")]
    return [" ".join(rng.choice(rng.choice([t, t, t, topics[0]])) for _ in range(rng.randrange(5, 80))) for t in (rng.choice(topics) for _ in range(n))]


def test_language_model_base_and_gain(spark):
    rows = [(i, t) for i, t in enumerate(texts(400, 2))] + [(1000, None), (1001, ""), (1002, "ALPHA1 unseen-word É"), (3, "alpha1"), (None, "beta2"), (1003, "gamma3 " * 4000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int").repartition(3)
    out = gru_lm.score_documents(docs, is_held_out(1)).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    total, kinds = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(t))
    want = sorted((repr(d), held(d), len(tokens(t)), sum(w in count for w in tokens(t)), total, round(base(t), 6)) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    unseen = [r for r in out if r["held_out"] and r["n_tokens"] > 10 and r["doc_id"] != 1003]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_tied_counts_fill_the_table(spark):
    """The most frequent words, ties by their bytes, whatever their counts have in common."""
    counts = [(f"w{i:02}".encode(), 1) for i in range(40)] + [(f"x{i}".encode(), 5) for i in range(3)]
    df = spark.createDataFrame(counts, "word binary, c long").repartition(3)
    for room in (2, 30, 43, 50):
        v = gru_lm.vocabulary(df, table_words=room)
        assert list(v.words) == [w for w, _ in sorted(counts, key=lambda r: (-r[1], r[0]))][:room] and (v.total, v.base_mass) == (55, 55 + 0.5 * 44)


def test_language_model_is_a_distribution():
    words = [b"w%d" % i for i in range(50)]
    v = gru_lm.Vocabulary(words, list(range(50, 0, -1)), 1275, 50, {gru_lm.ending(w): (0, 0) for w in words}, 20)
    for e in range(gru_lm.ENDINGS):
        own = [i for i in range(20, 50) if gru_lm.ending(words[i]) == e]
        v.mass[e] = sum(50 - i for i in own) + 0.5 * (len(own) + 1)
    w = gru_lm.fresh(v)
    rng = np.random.default_rng(0)
    for k in ("wc", "ww"):
        w[k] += rng.standard_normal(w[k].shape).astype(np.float32)
    total = sum(math.exp(gru_lm.log_probabilities(w, [np.array([3, 22, u])], v)[0] - gru_lm.log_probabilities(w, [np.array([3, 22])], v)[0]) for u in range(v.outputs + gru_lm.ENDINGS))
    assert abs(total - 1) < 1e-4


def test_language_model_against_one_word_at_a_time():
    rng = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(50)]
    v = gru_lm.Vocabulary(words, list(range(50, 0, -1)), 1275, 50, {}, 20)
    w = {k: (x + 0.3 * rng.standard_normal(x.shape)).astype(np.float32) for k, x in gru_lm.fresh(v).items()}
    texts = [rng.integers(0, v.outputs + gru_lm.ENDINGS, n).astype(np.int32) for n in (1, 7, 300, 40)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, want = gru_lm.WIDTH, []
    for s in texts:
        h, sum_, last = np.zeros(n), 0.0, v.outputs + gru_lm.ENDINGS
        for u in s.tolist():
            a, g = w["emb"][last].astype(float) @ w["wx"] + w["b"], h @ w["wh"]
            r, z = sigmoid(a[:n] + g[:n]), sigmoid(a[n : 2 * n] + g[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :]) + z * h
            x = h @ w["wc"] + w["bc"]
            kind = u // v.size if u < v.outputs else v.classes + u - v.outputs
            sum_ += x[kind] - np.log(np.exp(x).sum())
            if u < v.outputs:
                x = h @ w["ww"][kind] + w["bw"][kind]
                sum_ += x[u % v.size] - np.log(np.exp(x).sum())
            last = u
        want.append(sum_)
    assert np.allclose(gru_lm.log_probabilities(w, texts, v), want, rtol=1e-4, atol=1e-3)


def test_language_model_learns_from_every_training_document():
    assert math.isclose(sum(gru_lm.ROUNDS), 1) and len(gru_lm.ROUNDS) == len(gru_lm.RATES)
    assert np.concatenate(gru_lm.pieces(np.arange(10_001))).tolist() == list(range(10_001))
    assert gru_lm.outputs_for(10**8) > gru_lm.outputs_for(10**7) and gru_lm.outputs_for(10**12) == gru_lm.MOST_OUTPUTS


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = gru_lm.score_documents(docs, F.lit(True)).collect()
    assert [(r["train_tokens"], r["n_known"], abs(round(r["base_score"], 9))) for r in out] == [(0, 0, 0.0)] * 2
    assert gru_lm.score_documents(docs.limit(0), is_held_out(1)).count() == 0


def toxic_rows():
    rng = random.Random(5)
    plain, bad = [f"word{i}" for i in range(200)], ["vileness", "nastyish", "horridly"]
    rows, labels = [], []
    for d in range(700):
        t = [rng.choice(plain) for _ in range(rng.randrange(3, 150))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((d, " ".join(t)))
        labels.append((d, 1 - y if d % 50 == 0 else y, 1))
    return rows, labels


def test_toxicity_held_out_accuracy_and_odd_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + [(900, None), (901, ""), (None, "vileness"), (902, "word1 " * 9000 + "vileness nastyish " + "word2 " * 900), (5, rows[5][1])]], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(d, t, q) for d, t, q in labels] + [(None, 1, 1), (901, None, 1), (4, labels[4][1], 0)], "doc_id long, toxic int, quality int")
    out = toxicity.score_documents(docs, marks, is_held_out(0)).collect()
    assert len(out) == 705 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    truth = {d: y for d, y, _ in labels if d % 50}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.93
    assert next(r["predicted"] for r in out if r["doc_id"] == 902) == 1
    assert toxicity.score_documents(docs, marks, is_held_out(0), sample_bytes=1).count() == 705


def test_gradients_of_attention_embeddings_and_layers(monkeypatch):
    seen = {}

    class Recorder:
        def __init__(self, weights, rate):
            pass

        def step(self, grads):
            seen.update({k: np.array(g, dtype=float) for k, g in grads.items()})

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["abc", "abd", "xyz", "longer", "words!", "q"]) for _ in range(n)).encode() for n in (3, 12, 55, 1)]
    words, net = toxicity.Words(texts), toxicity.Network([b"abc", b"xyz"])
    grid, sizes, _ = words.windows()
    y = np.array([i % 2 for i in range(len(grid))], dtype=np.float32)
    monkeypatch.setattr(toxicity.gru, "Adam", Recorder)
    net.learn(words, grid, sizes, y, 1, 0.1, 0)

    def loss():
        z, _ = net.logits(words)
        return float(np.mean(np.log1p(np.exp(np.where(y == 1, -z, z)))))

    assert set(seen) == set(net.w)
    for k, g in seen.items():
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            place, old = np.unravel_index(at, g.shape), net.w[k].ravel()[at]
            both = []
            for e in (2e-3, -2e-3):
                net.w[k][place] = old + e
                both.append(loss())
            net.w[k][place] = old
            assert abs((both[0] - both[1]) / 4e-3 - g[place]) < 0.03 * abs(g[place]) + 2e-4, k


def test_a_documents_score_is_that_of_its_most_toxic_window():
    rows, labels = toxic_rows()
    texts, y = [t.encode() for _, t in rows], np.array([t for _, t, _ in labels])
    net, a, b = toxicity.fit(texts, y, np.ones(len(y)), passes=1, epochs=2)
    some = [b"word1 " * 100 + b"vileness nastyish", b"", b"word7"]
    found, owner = net.logits(toxicity.Words(some))
    for k, t in enumerate(some):
        words = t.split()
        count = 1 + max(0, -(-(len(words) - toxicity.WINDOW) // toxicity.STRIDE))
        alone = [net.logits(toxicity.Words([b" ".join(words[i * toxicity.STRIDE : i * toxicity.STRIDE + toxicity.WINDOW])]))[0] for i in range(count)]
        assert np.allclose(max(float(z.max()) for z in alone), toxicity._largest(found, owner, 3)[k], atol=1e-4)


def test_toxicity_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score_documents(docs, none, is_held_out(0)).collect()] == [0.0]
    assert toxicity.score_documents(docs.limit(0), none, is_held_out(0)).count() == 0


def test_quality_held_out_accuracy_and_columns(spark):
    rng = random.Random(7)
    syllables = ["ta", "re", "mi", "no", "la", "so"]
    rows, truth = [], {}
    for d in range(600):
        t = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(rng.randrange(10, 90))]
        truth[d] = int(rng.random() < 0.8)
        if not truth[d]:
            t = [w.upper() + "!!" for w in t] if rng.random() < 0.5 else [w + "$%" for w in t]
        rows.append((d, " ".join(t), rng.choice(["a", "b", None]), rng.choice(["en", "de"]), None if d % 9 == 0 else sum(map(len, t)), 0.25))
    rows += [(900, None, None, None, None, None), (901, "", "a", "en", 0, 1.0), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double")
    labels = spark.createDataFrame([(d, y, 0) for d, y in truth.items() if d < 300], "doc_id long, quality int, toxic int")
    out = quality.score_documents(docs, labels).collect()
    assert len(out) == len(rows) and set(docs.columns) < set(out[0].asDict()) and "_score" in out[0].asDict()
    unseen = [r for r in out if 300 <= r["doc_id"] < 600]
    assert sum(r["keep"] == truth[r["doc_id"]] for r in unseen) / len(unseen) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in out)


def test_exchange_of_labels_between_the_views_helps():
    gains = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = (rng.random(2300) < 0.5).astype(int)
        # the views are independent given the class, and there are few labels
        views = [(rng.standard_normal((2300, 20)) + np.where(y, 1, -1)[:, None] * 0.45).astype(np.float32) for _ in range(2)]
        known = np.where(np.arange(2300) < 32, y, np.where(np.arange(2300) < 1800, -1, 9))
        used = known != 9
        right = []
        for rounds in (0, 4):
            m = quality.CoTrained([v[used] for v in views], known[used], np.ones(int(used.sum())), rounds=rounds)
            right.append(float(np.mean([(s[~used] >= 0.5) == y[~used] for s in m.scores(views)[:2]])))
        gains.append(right[1] - right[0])
    assert sum(gains) / len(gains) > 0.01


def test_quality_scores_one_document_at_a_time(spark):
    docs = [("a good text of some words", "s", "en", 20), (None, None, None, None), ("BAD!! BAD!! 123", "t", "de", 15)]
    rng = np.random.default_rng(1)
    m = quality.CoTrained([rng.random((40, quality.TEXT_DIM)).astype(np.float32), rng.random((40, quality.PAGE_DIM)).astype(np.float32)], np.arange(40) % 2, np.ones(40))
    views = [np.array([quality.text_view((t or "").encode()) for t, *_ in docs]), np.array([quality.page_view((t or "").encode(), *rest) for t, *rest in docs])]
    for k in range(3):
        logits = [a * float(((v[k] - n.mean) * n.scale) @ n.w + n.b) + b for (a, b), n, v in zip(m.platt, m.models, views)]
        want = [1 / (1 + math.exp(-z)) for z in (*logits, m.joint[0] * sum(logits) + m.joint[1])]
        assert np.allclose([float(s[k]) for s in m.scores(views)], want, atol=1e-5)


def test_quality_fit_takes_little_more_memory_than_its_sample():
    rng = np.random.default_rng(2)
    y = np.where(np.arange(4000) < 800, np.arange(4000) % 2, -1)
    text = (rng.random((4000, quality.TEXT_DIM)) + 0.2 * (np.arange(4000) % 2)[:, None]).astype(np.float16)
    page = rng.random((4000, quality.PAGE_DIM)).astype(np.float32)
    tracemalloc.start()
    m = quality.CoTrained([text, page], y, np.ones(4000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * text.nbytes
    single = quality.CoTrained([text.astype(np.float32), page], y, np.ones(4000))
    assert all(np.array_equal(a, b) for a, b in zip(m.scores([text, page]), single.scores([text, page])))


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "s", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == 1 and quality.keep_good(docs.limit(0), labels).count() == 0


def test_layer_with_gates_apart_equals_the_plain_one():
    rng = np.random.default_rng(4)
    time, rows, width = 6, 5, 4
    a, wh = rng.standard_normal((time, rows, 3 * width)).astype(np.float32), rng.standard_normal((width, 3 * width)).astype(np.float32)
    keep, d = (rng.random((time, rows)) > 0.3).astype(np.float32), rng.standard_normal((time, rows, width)).astype(np.float32)
    a[0, 0], a[1, 1] = 300, -300  # far beyond what exp holds
    h = rng.standard_normal((rows, width)).astype(np.float32)
    states, kept = gru.forward(a, wh, h, keep)
    da, dwh = gru.backward(d, kept, wh, keep)
    layer = gru.Layer(time + 2, rows, width)
    parts = gru.apart(a.reshape(-1, 3 * width)).reshape(3, time, rows, width)
    assert np.allclose(layer.forward(parts, gru.apart(wh), h, keep == 0), states, atol=1e-6)
    da_apart, dwh_apart = layer.backward(d, gru.apart(wh), keep == 0)
    assert np.allclose(gru.together(da_apart.reshape(3, -1, width)).reshape(da.shape), da, atol=1e-5)
    assert np.allclose(gru.together(dwh_apart), dwh, atol=1e-5)


def test_words_of_a_batch_in_slices(monkeypatch):
    monkeypatch.setattr(gru_lm, "SLICE_BYTES", 8)
    texts = ["", None, " A  b\n", "É\x1cX y  C\tc\vd\fe\rF ", "word" * 9, None, "\n", "end"]
    batch = gru_lm.pa.RecordBatch.from_arrays([gru_lm.pa.array(texts, gru_lm.pa.string())], ["text"])
    found, slices = {}, 0
    for first, sizes, words in gru_lm._words(batch):
        ends, slices = np.cumsum(sizes), slices + 1
        found |= {first + i: words.to_pylist()[end - n : end] for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist()))}
    assert slices > 2 and found == {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
