import numpy as np
import pytest

from repolith.llm import vectors


def test_pack_is_exact():
    rng = np.random.default_rng(1)
    x = np.vstack([np.round(rng.normal(size=(5, 7)), 4), np.round(rng.normal(size=(5, 7)) * 100, 5), rng.normal(size=(5, 7)).astype("f4"), rng.normal(size=(5, 7)), np.full((1, 7), 1e300), np.full((1, 7), 5e-324), np.zeros((1, 7)), np.arange(7)[None, :] * 1.0])
    rows = vectors.pack(x)
    assert (vectors.unpack(rows) == x).all()
    assert [len(r) for r in rows[:5]] == [15] * 5 and [len(r) for r in rows[5:10]] == [29] * 5 and len(rows[-1]) == 15
    assert vectors.unpack([]).shape[0] == 0


@pytest.mark.parametrize("at_least", [None, 0.9])
def test_recall_with_many_more_shards_than_probes(spark, at_least):
    """100 shards, of which 27 are searched for five nearest, and about four for those of 0.9 or more."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 32))
    # families of near copies around half of the rows, besides rows that resemble none
    x = np.vstack([base] + [base[:750] + rng.normal(scale=0.25, size=(750, 32)) for _ in range(3)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    d = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r.id, r.other) for r in vectors.similar(vectors.usable(d, "id", "v", 32), at_least=at_least, shards=100).collect()}
    best = np.argsort(-s, 1)[:, :5]
    want = {(i, int(j)) for i in range(len(x)) for j in best[i] if at_least is None or s[i, j] >= at_least}
    assert len(want) > 5000 and len(got & want) / len(want) >= (0.9 if at_least is None else 0.995)
    assert at_least is None or not got - want


def test_one_task_holds_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 60)
    monkeypatch.setattr(vectors, "ASKING", 80)
    x = np.random.default_rng(2).normal(size=(600, 8))
    d = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = vectors.similar(vectors.usable(d, "id", "v", 8), shards=2).collect()
    assert sum(s[r.id, r.other] >= np.sort(s[r.id])[-5] - 1e-12 for r in out) / 3000 >= 0.99
