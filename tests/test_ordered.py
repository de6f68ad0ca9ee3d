import random

import pytest
from pyspark.sql import functions as F

from repolith.operators import ordered
from repolith.operators.ordered import neighbours


@pytest.mark.parametrize("whole", [False, True])
def test_like_plain_lists(spark, whole):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), t, rng.choice([None, *range(9)])) for t in range(80)]
    d = spark.createDataFrame(rows, "k string, t long, v long")
    got = neighbours(d, ["k"], ["t"], F.floor(F.col("t") / 7), prev=["v"], nxt=["v"], before_max=["v"], after_min=["v"], up_to_max=["v"], up_to_sum=["v"], number="n", whole=whole).collect()
    for r in got:
        own = [x for x in rows if x[0] == r.k]
        i = [x[1] for x in own].index(r.t)
        before, after = [x[2] for x in own[:i] if x[2] is not None], [x[2] for x in own[i + 1 :] if x[2] is not None]
        upto = before + ([own[i][2]] if own[i][2] is not None else [])
        assert r.prev_v == (own[i - 1][2] if i else None) and r.next_v == (own[i + 1][2] if i + 1 < len(own) else None)
        assert r.max_before_v == max(before, default=None) and r.min_after_v == min(after, default=None) and r.max_upto_v == max(upto, default=None) and r.n == i and (r.sum_upto_v or 0) == sum(upto)
    assert len(got) == 80


def test_counts_keys(spark, monkeypatch):
    d = spark.createDataFrame([("a",)] * 5 + [(None,)], "k string")
    assert ordered.fits(d, ["k"]) and ordered.fits(d.limit(0), ["k"])
    monkeypatch.setattr(ordered, "MOST", 4)
    assert not ordered.fits(d, ["k"])


def test_one_hot_day_is_split(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MOST", 10)
    rows = [("a", 86_400_000_000 * 7 + 1_000_000 * t, t) for t in range(300)] + [("a", None, -1), ("b", 5, 0)]
    d = spark.createDataFrame(rows, "k string, t long, v long")
    out = neighbours(d, ["k"], ["t"], ordered.by_time("t"), prev=["v"], up_to_sum=["v"], number="n").collect()
    assert sorted((r.k, r.n, r.v, r.prev_v) for r in out) == [("a", 0, -1, None), *[("a", t + 1, t, t - 1) for t in range(300)], ("b", 0, 0, None)]
    assert {r.sum_upto_v for r in out if r.v == 299} == {299 * 150 - 1}
