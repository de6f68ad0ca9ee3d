import numpy as np

from repolith.llm import vectors


def test_search_keeps_pace_with_the_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SPREAD", 1)  # 30 shards
    x = np.random.default_rng(5).normal(size=(900, 8))
    d = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = vectors.similar(vectors.usable(d, "id", "v", 8)).collect()
    assert max(abs(r.similarity - s[r.id, r.other]) for r in out) < 1e-12
    assert sum(s[r.id, r.other] >= np.sort(s[r.id])[-5] - 1e-12 for r in out) / 4500 >= 0.9
