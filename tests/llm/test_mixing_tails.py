import random

import pytest

from repolith.llm import mixing


@pytest.mark.parametrize("weights", [(0.5, 0.5), (0.2, 0.8), (0.7, 0.3)])
def test_shares_hold_for_heavy_tails(spark, weights):
    """One source of ten very long documents, one of many short ones, one of both."""
    rng = random.Random(4)
    rows = [(i, "long", 200_000) for i in range(10)] + [(100 + i, "short", rng.randrange(50, 900)) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc long, source string, tokens long")
    goal = spark.createDataFrame([("long", weights[0], 2), ("short", weights[1], 2)], "source string, target_weight double, max_repeats int")
    out, report = mixing.mix(d, goal, total_tokens=2_000_000)
    share = {r.source: r.reached_share for r in report.collect()}
    assert abs(share["long"] - weights[0]) < 0.01 and all(r.repeats <= 2 for r in out.collect())


def test_long_and_short_documents_of_one_source(spark):
    rng = random.Random(5)
    rows = [(i, s, int(rng.paretovariate(1.1) * 100)) for i, s in enumerate(["a", "b", "c"] * 2000)]
    d = spark.createDataFrame(rows, "doc long, source string, tokens long")
    goal = spark.createDataFrame([("a", 3.0, 1), ("b", 1.0, 1), ("c", 2.0, 1)], "source string, target_weight double, max_repeats int")
    total = sum(r[2] for r in rows) // 3
    share = {r.source: r.reached_share for r in mixing.mix(d, goal, total_tokens=total)[1].collect()}
    assert abs(share["a"] - 0.5) < 0.01 and abs(share["b"] - 1 / 6) < 0.01 and abs(share["c"] - 1 / 3) < 0.01


def test_nothing_to_draw_from(spark):
    d = spark.createDataFrame([], "doc long, source string, tokens long")
    goal = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    out, report = mixing.mix(d, goal)
    assert out.count() == 0 and report.collect()[0].reached_share == 0
