import random

import numpy as np
from pyspark.sql import functions as F

from repolith.llm import cooccurrence


def test_tails_like_convolution():
    rng = np.random.default_rng(1)
    many = np.array([3.0, 10, 40, 7, 200])
    p = np.vstack([rng.uniform(0, 0.4, size=(30, 5)), rng.uniform(0, 1e-4, size=(30, 5)), np.full((1, 5), 0.999)])
    for c in (0, 1, 2, 5, 30, 140, 260, 261):
        got = cooccurrence.upper_tails(p, many, np.full(len(p), c))
        want = np.array([cooccurrence.poisson_binomial_tail(r, many, c) for r in p])
        assert np.abs(got - want).max() < 1e-9
        # plain convolution adds up from one end, so only tails it can resolve are compared
        small = (want > 1e-200) & (want < 1e-3)
        assert not small.any() or np.abs(got[small] / want[small] - 1).max() < 1e-6, c


def test_classes_are_narrow(spark):
    n = [1, 2, 63, 64, 65, 127, 128, 129, 1000, 10**6, 2**40, 2**40 + 2**35]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(cooccurrence.degree_class(F.col("n"))).collect()]
    assert got == sorted(got) and got[:7] == [1, 2, 63, 64, 65, 127, 128] and got[7] == 128 and got[-1] < 64 * 36 and len(set(got[8:])) == 4


def test_false_discovery_counts_all_pairs(spark, sizes):
    """q of every pair is that of Benjamini and Hochberg over all pairs of items, met or not."""
    rng = random.Random(3)
    rows = [("r", f"c{c}", f"f{f}") for c in range(80) for f in rng.sample(range(12), rng.choice([1, 2, 3, 6]))]
    d = spark.createDataFrame(rows, "g string, b string, i string")
    inc = cooccurrence.incidence(d, "g", "b", "i").cache()
    out = cooccurrence.surprise(inc, cooccurrence.all_pairs(inc)).collect()
    tests, low = 12 * 11 / 2, 1.0
    order = sorted(out, key=lambda r: r.p_value)
    for k in range(len(order) - 1, -1, -1):
        low = min(low, order[k].p_value * tests / (k + 1))
        assert abs(order[k].q_value - low) < 1e-9
    # the count expected is the sum over baskets of both chances under the fitted model
    model = cooccurrence.null_model(inc).collect()
    x = {r["class"]: r.fit for r in model if r.side == 0}
    for r in out:
        want = sum(b.many * (x[r.n_i] * b.fit / (1 + x[r.n_i] * b.fit)) * (x[r.n_j] * b.fit / (1 + x[r.n_j] * b.fit)) for b in model if b.side == 1)
        assert abs(r.expected - want) < 1e-9
    # and the model keeps every item's frequency
    for k, fit in x.items():
        assert abs(sum(b.many * fit * b.fit / (1 + fit * b.fit) for b in model if b.side == 1) - k) < 1e-5
