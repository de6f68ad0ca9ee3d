import random

from repolith.llm import spans


def _docs():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choices("abcdefghij é\U0001f600", k=n))
    common = text(900)
    return [(1, text(90) + common + text(50)), (2, common[100:640] + text(70)), (3, text(800)), (4, common), (5, common), (6, text(30) + common[300:]), (7, common[:390])]


def test_locate_finds_every_occurrence():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab", k=400)) for _ in range(5)] + ["", "aaaa" * 40]
    phrases = sorted({t[i : i + n] for t in texts for i in (0, 33, 90) for n in (8, 70, 100) if len(t) > i + n} | {"a" * 70})
    got = spans.locate(texts, phrases)
    assert got == [{i for p in phrases for i in range(len(t)) if t.startswith(p, i)} for t in texts]


def test_automata_place_the_passages(spark, monkeypatch):
    """Without what the automata find there are no rows: nothing else knows where passages are."""
    d = spark.createDataFrame(_docs(), "doc long, text string").coalesce(1)
    want = {tuple(r) for r in spans.sharing_pairs(d).collect()}
    assert want == {(a, b) for a in (1, 2, 4, 5, 6) for b in (1, 2, 4, 5, 6) if a < b and {a, b} != {2, 6}}
    monkeypatch.setattr(spans, "locate", lambda texts, phrases: [set() for _ in texts])
    blind = spans._located(400)
    import pandas as pd

    batch = pd.DataFrame({"doc": [1], "text": [_docs()[0][1]], "keys": [[0]]})
    assert all(b.empty for b in blind(iter([batch])))


def test_links_and_classes(spark):
    d = spark.createDataFrame(_docs() + [(8, None), (None, _docs()[0][1])], "doc long, text string")
    pairs = {tuple(r) for r in spans.sharing_pairs(d).collect()}
    links = {r.doc: (r.rep, r.links) for r in spans.link_counts(d).collect()}
    assert links[5][0] == 4 and set(links) == {1, 2, 3, 4, 5, 6}
    assert all(n == sum(doc in p for p in pairs) for doc, (_, n) in links.items())
    reps = {tuple(r) for r in spans.sharing_classes(d)[0].collect()}
    assert reps == {p for p in pairs if 5 not in p}
