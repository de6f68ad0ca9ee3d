import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolith.operators import intervals


def brute(rows):
    out, by = set(), {}
    for k, s, e in rows:
        e = intervals.OPEN if e is None else e
        if k is not None and s is not None and s < e:
            by.setdefault(k, []).append((s, e))
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for i, (s, e) in enumerate(merged):
            out.add((k, "period", s, -1 if e == intervals.OPEN else e))
            if i:
                out.add((k, "gap", merged[i - 1][1], s))
    return out


def merged(spark, rows, **kw):
    d = spark.createDataFrame(rows, "k string, s long, e long")
    return sorted(tuple(r) for r in intervals.merged_periods(d, ["k"], "s", "e", **kw).collect())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 60))), max_size=14))
def test_merged_like_brute_force(spark, sizes, rows):
    assert merged(spark, rows, bucket_us=10) == sorted(brute(rows))


def test_hot_key_over_several_tiles(spark, sizes):
    rng = random.Random(3)
    rows = [("hot", s := rng.randrange(20_000), s + rng.randrange(1, 9)) for _ in range(1500)]
    assert merged(spark, rows, bucket_us=1000) == sorted(brute(rows))


def test_dyadic_blocks_cover_exactly(spark, sizes):
    d = spark.createDataFrame([(a, b) for a in range(0, 12) for b in range(a, 14)], "a long, b long")
    got = intervals.dyadic_blocks(d, "a", "b").withColumn("x", F.explode(F.expr("sequence(shiftleft(idx, level), shiftleft(idx + 1, level) - 1)"))).groupBy("a", "b").agg(F.sort_array(F.collect_list("x")).alias("l")).collect()
    assert all(r.l == list(range(r.a, r.b)) for r in got) and len(got) == sum(1 for a in range(12) for b in range(a + 1, 14))


def test_stays_ignore_what_does_not_fit(spark, sizes):
    rows = [("i", 1, " ENTER", 10), ("i", 1, "enter", 20), ("i", 1, "Leave", 30), ("i", 1, "leave", 40), ("i", 1, "leave", 30), ("i", 2, "leave", 5), ("i", 2, "enter", 50), ("i", 3, "enter", None), ("i", 3, "gone", 7), (None, 3, "enter", 7)]
    d = spark.createDataFrame(rows, "issue string, sprint long, kind string, us long").withColumn("at", F.timestamp_micros("us")).withColumn("start", F.lit("clash"))
    assert sorted(map(tuple, intervals.stays(d, ["issue", "sprint"], "kind", "at").collect())) == [("i", 1, 10, 30), ("i", 2, 50, None)]


def test_empty(spark, sizes):
    assert merged(spark, []) == []
    d = spark.createDataFrame([], "issue string, kind string, at timestamp")
    assert intervals.stays(d, ["issue"], "kind", "at").count() == 0


@pytest.mark.parametrize("end", [None, 5])
def test_touching_intervals_are_one(spark, sizes, end):
    assert merged(spark, [("a", 1, 3), ("a", 3, end), ("a", 1, 3)]) == [("a", "period", 1, end or -1)]
