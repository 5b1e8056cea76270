import random
import re

import numpy as np

from tidemark.llm import secrets

WORDS = "the river rose over night and Every warning reached people near gauge Station before noon Sunday".split()


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def keys(rng, n):
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))


def prose(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(rng, n):
    """Texts with findings of the base patterns among numbers, addresses and names that are none."""
    out = []
    for i in range(n):
        a, b = prose(rng), prose(rng)
        secret = [f'token = "{hexes(rng, 40)}"', f"AKIA{keys(rng, 16)}", f"password: {rng.choice('GHKMxyz')}{hexes(rng, 4)}{keys(rng, 7)}", hexes(rng, 32), f"api_key='{keys(rng, 9)}x9'"][i % 5]
        other = [f"{rng.randrange(10**15, 10**16)}", f"mail{i}@example.com", f"555-{rng.randrange(1000, 9999)}", f"{rng.randrange(99)}.{rng.randrange(999)} SSverenung{i % 7}Teil", f"2024-{10 + i % 3}-{10 + i % 19}"][i % 5 if i % 2 else (i + 2) % 5]
        out.append(f"{a} {other} {b}" if i % 3 == 0 else f"{a} {secret} {b}" if i % 3 == 1 else f"{a} {other} {b} {secret}")
    return out


def plain_base(text):
    """Every position tried for each kind, one after the other."""
    found = []
    start = re.compile(r"""(?:password|passwd|secret|token|api_key|apikey)["']? *[:=] *["']?""", re.I | re.A)
    at = 0
    while at < len(text):
        m = start.match(text, at)
        end = m.end() if m else 0
        while m and end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] in "+/_.=-"):
            end += 1
        if m and end > m.end():
            found += [(at, 0, end)] * (end - m.end() >= 6)
            at = end
        else:
            at += 1
    for kind, first, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = at + len(first)
            while text.startswith(first, at) and end < len(text) and text[end] in chars:
                end += 1
            if text.startswith(first, at) and end > at + len(first):
                found += [(at, kind, end)] * (end - at >= least)
                at = end
            else:
                at += 1
    return sorted(found)


def test_base_spans_are_leftmost_and_don_t_overlap():
    rng = random.Random(4)
    bits = ["token", "PassWord", "passwd", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "AKIA", keys(rng, 16), hexes(rng, 24), "abc", "x.y-z", "é", "ſecret", "to\u212aen", "\n", "secret=token: abcdef", "==ab"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for t in texts:
        assert [(s, k, e) for s, k, e, _ in secrets.base_spans(t)] == plain_base(t), t
    assert secrets.base_spans("secret=token: abcdef") == [] and secrets.base_spans("to\u212aen=abcdef") == []


def test_windows_cover_the_whole_candidate():
    text = "x" * 5 + " " + "a1" * 50 + "\né" + "tail"
    ((start, end, bits, found),) = secrets.candidates(text, [(0, 2, 8, 0), (105, 0, 110, 106)])
    assert (start, end, bits) == (6, 106, 4) and len(found) == 4 and all(len(w) == secrets.WIDE for w in found)
    assert "".join(w[secrets.BEFORE : secrets.BEFORE + secrets.VALUE] for w in found).rstrip("\0") == "a1" * 50
    assert found[0].startswith("\0" * 18 + "xxxxx ") and found[3].endswith("\nétail\0\0")
    assert secrets.codes(found)[3, -8:].tolist()[:3] == [96, 96, ord("t") - 31]


def test_gradients():
    rng = np.random.default_rng(2)
    net = secrets.Network(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y, weight = rng.integers(0, secrets.CODES, (6, secrets.WIDE)), rng.integers(0, 2, (6, 3)).astype(float), rng.random((6, 3)) + 0.5
    _, g = net.gradients(x, y, weight)
    for name in net.w:
        for at in {tuple(rng.integers(0, n) for n in net.w[name].shape) for _ in range(6)} | {tuple(np.unravel_index(np.abs(g[name]).argmax(), g[name].shape))}:
            kept, both = net.w[name][at], []
            for e in (1e-5, -1e-5):
                net.w[name][at] = kept + e
                both.append(net.gradients(x, y, weight)[0])
            net.w[name][at] = kept
            assert abs((both[0] - both[1]) / 2e-5 - g[name][at]) < 1e-4, (name, at)


def test_threshold_keeps_recall():
    logit = np.array([5.0, 4.0, 3.0, 1.0, 2.0, 0.0])
    found = np.array([True, True, True, True, False, False])
    assert secrets.threshold(logit, found, 1.0) == 0.5 and secrets.threshold(logit, found, 0.75) == 2.5
    assert secrets.threshold(logit[:4], found[:4], 1.0) == 0.0


def test_what_the_patterns_miss_is_added_and_clean_texts_are_left_alone(spark):
    rng = random.Random(12)
    rows = list(enumerate(corpus(rng, 900)))
    missed = [(2000 + i, f"{prose(rng)} {value} {prose(rng)}") for i, value in enumerate([hexes(rng, 40).upper() for _ in range(10)])]
    clean = [(3000 + i, f"{prose(rng)} {rng.randrange(10**15, 10**16)} {prose(rng)} mail{i}@example.com 555-{1000 + i}") for i in range(60)]
    odd = [(4000, None), (4001, ""), (None, f"secret: {keys(rng, 10)}"), (4002, "lorem " * 200_000 + "token=abcdef12"), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "k") for r in rows + missed + clean + odd], "doc_id long, text string, base string").repartition(3)
    got = secrets.find_secrets(df, "doc_id", "text").collect()
    assert len(got) == len(rows + missed + clean + odd)
    by = {r["id"]: r for r in got}
    for i, t in rows + missed + clean + odd:
        assert [(s["start"], s["kind"], s["end"]) for s in by[i]["base"]] == plain_base(t or "") if i != 4002 else len(by[i]["base"]) == 1
    assert sum(bool(by[i]["added"]) for i, _ in missed) >= 5
    assert not [by[i] for i, _ in clean if by[i]["added"]]
    assert sum(bool(by[i]["added"]) for i, _ in rows) <= 9  # of 900
    assert by[4000]["base"] == by[4001]["added"] == []


def test_without_findings_and_empty(spark):
    df = spark.createDataFrame([(1, "no 1234567890 finding"), (2, None)], "doc_id long, text string")
    assert [(r["base"], r["added"]) for r in secrets.find_secrets(df, "doc_id", "text").collect()] == [([], [])] * 2
    assert secrets.find_secrets(df.where("doc_id > 5"), "doc_id", "text").count() == 0


def test_candidates_are_scored_as_by_the_model():
    rng = random.Random(6)
    found = [(w, bits) for t in corpus(rng, 400) for _, _, bits, ws in secrets.candidates(t, secrets.base_spans(t)) for w in ws]
    model = secrets.train([w for w, _ in found], np.array([b for _, b in found]))
    t = f"{prose(rng)} {hexes(rng, 70).upper()} end token='{keys(rng, 12)}1'"
    base = secrets.base_spans(t)
    want = []
    for s, e, _, ws in secrets.candidates(t, base):
        best = np.max([model.scores([w])[0] for w in ws], axis=0) - model.least
        if best.max() >= 0 and not any(bs < e and be > s for bs, _, be, _ in base):
            want.append((s, int(best.argmax()), e))
    shape = [{"start": s, "end": e, "label": b, "windows": w} for s, e, b, w in secrets.candidates(t, base)]
    assert secrets._added(model, shape, [{"start": s, "kind": k, "end": e} for s, k, e, _ in base]) == want


def test_all_windows_are_learnt_from_and_parts_agree_with_one(spark):
    rng = random.Random(8)
    found = sorted({w: bits for t in corpus(rng, 900) for _, _, bits, ws in secrets.candidates(t, secrets.base_spans(t)) for w in ws}.items())
    seen = spark.createDataFrame(found, "window string, label int").repartition(3)
    bits = np.array([b for _, b in found])
    y = (bits[:, None] >> np.arange(3)) & 1
    for size in (10**6, 300):
        model = secrets.learnt(seen, size=size)
        z = secrets.unseen_logits(model.nets, [w for w, _ in found])
        for k in range(3):
            scale, shift = secrets._platt(z[:, k], y[:, k].astype(float), np.ones(len(z)))
            assert np.allclose([model.scale[k], model.shift[k]], [scale, shift], atol=1e-3)
            t = secrets.threshold(z[:, k], y[:, k] > 0, secrets.RECALL)
            assert np.isclose(model.least[k], max(0.5, 1 / (1 + np.exp(-(model.scale[k] * t + model.shift[k])))), atol=1e-4)
            over = model.scores([w for w, _ in found])[:, k] >= model.least[k]
            assert over[y[:, k] > 0].mean() >= 0.99 and over[y[:, k] == 0].mean() < 0.01
    again = secrets.learnt(seen.repartition(7), size=300)
    assert np.array_equal(again.least, model.least) and np.array_equal(secrets._flat(again.nets), secrets._flat(model.nets))


def test_thresholds_and_calibration_are_of_all_windows(spark):
    """More findings than were once looked at: the places of thresholds are counted in all of them."""
    rng = np.random.default_rng(3)
    z = rng.standard_normal((9000, 3)).astype(np.float32)
    bits = rng.integers(0, 8, 9000)
    z[bits & 1 == 1, 0] += 2
    rows = [(p, z[p::5].tobytes(), bits[p::5].astype(np.uint8).tobytes()) for p in range(5)]
    judged = spark.createDataFrame(rows, "part int, z binary, label binary")
    y = ((bits[:, None] >> np.arange(3)) & 1) > 0
    got = secrets.thresholds(judged, {k: int(y[:, k].sum()) for k in range(3)}, 0.99)
    assert [got[k] for k in range(3)] == [secrets.threshold(z[:, k].astype(float), y[:, k], 0.99) for k in range(3)]
    want = [secrets._platt(z[:, k].astype(float), y[:, k].astype(float), np.ones(9000)) for k in range(3)]
    assert np.allclose(np.array(secrets.calibrated(judged)).T, want, atol=1e-6)
    x = np.array([-1e30, -2.5, -0.0, 0.0, 1e-30, 3.0], np.float32)
    assert (np.diff(secrets.ordered(x)) >= 0).all() and [secrets._number(int(i)) for i in secrets.ordered(x)] == x.tolist()
