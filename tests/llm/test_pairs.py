import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolith.llm import cooccurrence, leaks, mixing, nearest, spans, vectors


def test_nearest_like_brute_force(spark, sizes):
    rng = random.Random(4)
    left = [(f"a{i}", rng.choice(["x", "y", None]), rng.choice([None, *range(0, 400, 3)])) for i in range(60)]
    right = [(f"b{i}", rng.choice(["x", "x", "y", "z"]), rng.choice([None, *range(0, 400, 5)])) for i in range(60)]
    left += left[:3]
    cols = "id string, entity string, t long"
    got = nearest.nearest_in_time(spark.createDataFrame(left, cols).withColumnRenamed("id", "anchor_id"), spark.createDataFrame(right, cols).withColumnRenamed("id", "matched_id"), 20)
    want = set()
    for a, e, t in set(left):
        near = [(abs(t - u), b) for b, f, u in right if e is not None and t is not None and u is not None and e == f and abs(t - u) <= 20]
        if near:
            want.add((a, min(near)[1], min(near)[0]))
    assert {tuple(r) for r in got.collect()} == want
    empty = spark.createDataFrame([], "matched_id string, entity string, t long")
    assert nearest.nearest_in_time(spark.createDataFrame(left, cols).withColumnRenamed("id", "anchor_id"), empty, 5).count() == 0


def test_pair_counts_like_brute_force(spark):
    rng = random.Random(6)
    rows = [("r", f"c{c}", f"f{f}") for c in range(60) for f in rng.sample(range(14), rng.choice([1, 2, 3, 9]))]
    rows += [("r", f"c{c}", x) for c in range(8) for x in ("p", "q")] + [("r", None, "p"), (None, "c", "p"), ("r", "c1", None)] + rows[:5]
    d = spark.createDataFrame(rows, "g string, b string, i string")
    inc = cooccurrence.incidence(d, "g", "b", "i").cache()
    got = cooccurrence.names(d, cooccurrence.pair_counts(inc), "g", "i").select("a", "b", "c").collect()
    sets = {}
    for g, b, i in rows:
        if None not in (g, b, i):
            sets.setdefault(i, set()).add(b)
    total, want = len(set().union(*sets.values())), set()
    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if a < b and c >= 4 and c >= 0.5 * min(len(sets[a]), len(sets[b])) and c * total >= 2 * len(sets[a]) * len(sets[b]):
                want.add((a, b, c))
    assert {tuple(r) for r in got} == want and ("p", "q", 8) in {tuple(r) for r in got}
    s = cooccurrence.surprise(inc, cooccurrence.pair_counts(inc)).collect()
    assert len(s) == len(want) and all(0 <= r.p_value <= r.q_value <= 1 for r in s)
    assert cooccurrence.pair_counts(inc.limit(0)).count() == 0


def test_tail_is_the_poisson_binomial_one():
    p, many = np.array([0.1, 0.4]), np.array([6, 5])
    rng = np.random.default_rng(0)
    draws = rng.binomial(6, 0.1, 400_000) + rng.binomial(5, 0.4, 400_000)
    for c in (0, 1, 3, 6):
        assert abs(cooccurrence.poisson_binomial_tail(p, many, c) - (draws >= c).mean()) < 4e-3


def test_fit_keeps_degrees():
    import pandas as pd

    d = pd.DataFrame({"g": 1, "side": [0, 0, 1, 1], "degree": [2, 5, 1, 4], "many": [7, 4, 6, 7]})
    f = cooccurrence._fit(d)
    x, y = f[f["side"] == 0], f[f["side"] == 1]
    for _, a in x.iterrows():
        assert abs(sum(b["many"] * a["fit"] * b["fit"] / (1 + a["fit"] * b["fit"]) for _, b in y.iterrows()) - a["degree"]) < 1e-4


def test_leaks_like_brute_force(spark):
    import re

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["Äpfel", "naïve"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 12, 20, 30])))) for i in range(12)] + [(98, None), (99, "")]
    items.append((50, items[3][1]))
    docs = []
    for d in range(40):
        body = rng.choices(vocab, k=rng.choice([0, 5, 60]))
        if d % 3 == 0:
            w = rng.choice(items[:12])[1].split()
            k = rng.randrange(len(w))
            body = body[:20] + [x.upper() + "," for x in w[k : k + 14]] + body[20:]
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "x_" + items[3][1])]
    words = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    want = set()
    for d, t in docs:
        grams = {tuple(words(t)[k : k + 12]) for k in range(len(words(t)) - 11)}
        for i, s in items:
            w = words(s)
            if d is not None and any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                want.add((d, i))
    got = leaks.leaked(spark.createDataFrame(docs, "d long, text string"), "d", "text", spark.createDataFrame(items, "i long, body string"), "i", "body")
    assert {tuple(r) for r in got.collect()} == want and want


def test_spans_like_brute_force(spark):
    rng = random.Random(9)
    letters = "abcdefghij é\U0001f600"
    text = lambda n: "".join(rng.choices(letters, k=n))
    long_, short, edge = text(700), text(380), text(400)
    docs = [(i, text(rng.choice([100, 500, 900]))) for i in range(8)]
    docs += [(20, text(90) + long_ + text(50)), (21, long_[100:640]), (22, text(30) + long_[300:] + edge), (23, short + text(300)), (24, text(200) + short), (25, edge), (26, edge), (27, None), (28, ""), (29, "z" * 900), (30, "y" + "z" * 450)]
    have = [(d, {t[i : i + 400] for i in range(len(t) - 399)}) for d, t in docs if t]
    want = {(a, b) for a, x in have for b, y in have if a < b and x & y}
    d = spark.createDataFrame(docs, "doc long, text string")
    assert {tuple(r) for r in spans.sharing_pairs(d).collect()} == want
    cover = {r.doc: r.shared_chars for r in spans.shared_characters(d).collect()}
    for doc, t in docs:
        marks, others = set(), set().union(*(x for e, x in have if e != doc))
        for i in range(len(t or "") - 399):
            if t[i : i + 400] in others:
                marks |= set(range(i, i + 400))
        assert cover[doc] == len(marks), doc
    assert spans.sharing_pairs(d.limit(0)).count() == 0


def test_seats_by_highest_quotients():
    def plain(w, caps, n):
        out = [0] * len(w)
        for _ in range(n):
            ok = [i for i in range(len(w)) if w[i] > 0 and out[i] < caps[i]]
            if not ok:
                break
            i = max(ok, key=lambda i: (w[i] / (2 * out[i] + 1), -i))
            out[i] += 1
        return out

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 7)
        w, caps, seats = [rng.choice([0, 1, 2.5, 7, 11]) for _ in range(n)], [rng.randrange(0, 30) for _ in range(n)], rng.randrange(0, 60)
        assert mixing.sainte_lague(w, caps, seats) == plain(w, caps, seats)


def test_mix_reaches_targets_and_caps(spark):
    rng = random.Random(2)
    docs = [(i, "big" if i % 4 else "small", rng.randrange(1, 300)) for i in range(4000)] + [(9001, None, 5), (9002, "big", 0), (9003, "lost", 10)]
    d = spark.createDataFrame(docs, "doc long, source string, tokens long")
    goal = spark.createDataFrame([("big", 1.0, 1), ("small", 1.0, 2), ("absent", 3.0, 2), ("lost", None, 1)], "source string, target_weight double, max_repeats int")
    out, report = mixing.mix(d, goal, block_tokens=500, shard_tokens=60_000, total_tokens=300_000)
    rows = out.collect()
    assert all(r.repeats <= {"big": 1, "small": 2}[r.source] for r in rows) and len({r.doc for r in rows}) == len(rows)
    share = {r.source: r.reached_share for r in report.collect()}
    assert abs(share["big"] - 0.5) < 0.03 and abs(share["small"] - 0.5) < 0.03 and share["absent"] == 0 and share["lost"] == 0
    again, _ = mixing.mix(d, goal, block_tokens=500, shard_tokens=60_000, total_tokens=300_000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_tokens_round_trip():
    enc = mixing._encoder(mixing.TOKENIZER)
    for t in ("Fix the naïve retry,\n\n  don't  panic 42!", "", "\u00a0x\U0001f600"):
        assert enc.decode(enc.encode_ordinary(t)) == t


@pytest.mark.parametrize("n", [0, 1, 900])
def test_vectors_recall(spark, n):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 16))
    if n > 100:
        x[100:140] = x[:40] + rng.normal(scale=0.05, size=(40, 16))
        x[140:150] = x[0]
    rows = [(f"v{i:04d}", [float(y) for y in r]) for i, r in enumerate(x)]
    bad = [("n", None), ("s", [1.0]), ("z", [0.0] * 16), ("q", [float("nan")] * 16), (None, [1.0] * 16), ("i", [float("inf")] + [1.0] * 15)]
    d = spark.createDataFrame(rows + bad + rows[:3], "id string, v array<double>")
    got = {}
    for r in vectors.similar(vectors.usable(d, "id", "v", 16)).collect():
        got.setdefault(r.id, []).append(r.other)
    if n < 2:
        assert not got
        return
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(s[i, int(o[1:])] >= np.sort(s[i])[-5] - 1e-3 for i in range(n) for o in got[f"v{i:04d}"])
    assert hits / (5 * n) >= 0.9 and all(len(v) == 5 for v in got.values()) and len(got) == n
    assert got["v0000"] == [f"v{i:04d}" for i in range(140, 145)]
