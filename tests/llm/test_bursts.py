from repolith.llm import nearest


def test_bursts_and_voids_meet_few(spark, sizes):
    """Half of the times come a microsecond apart, half a minute apart: a mean slot would hold the whole burst."""
    n, minute = 3000, 60_000_000
    times = [k for k in range(n)] + [10**9 + k * minute for k in range(n)]
    right = spark.createDataFrame([("e", 2 * t, f"m{i:05d}") for i, t in enumerate(times)], "entity string, t long, matched_id string")
    left = spark.createDataFrame([("e", 2 * t + 1, f"a{i:05d}") for i, t in enumerate(times)], "entity string, t long, anchor_id string")
    got = {r.anchor_id: (r.matched_id, r.distance_us) for r in nearest.nearest_in_time(left, right, 5 * minute).collect()}
    assert got == {f"a{i:05d}": (f"m{i:05d}", 1) for i in range(2 * n)}
    rows = [("e", 2 * t - 1, 2 * t, t) for t in times] + [("e", 10**13, 10**13 + 10**9, 1)]
    intervals = spark.createDataFrame(rows, "entity string, lo long, hi long, rt long")
    assert nearest._met(left, intervals).count() < 2 * n * (nearest.WIDEN + 1) * 3
