from datetime import datetime

from repolith.llm import queries


def test_surprise_of_all_pairs(spark, tmp_path):
    # b is in more than half of the commits, and a, b have a lift below 2
    rows = [(f"s{k}", p) for k in range(8) for p in ["b", "a" if k < 6 else "c", "d" if k in (0, 7) else "e"]]
    spark.createDataFrame([("r", sha, p, datetime(2025, 1, 1)) for sha, p in rows], "repo string, sha string, path string, committed_at timestamp").write.parquet(str(tmp_path / "commit_changes.parquet"))
    out = queries.p7_surprise(spark, str(tmp_path)).collect()
    assert {(r.path_a, r.path_b): r.c for r in out} == {("a", "b"): 6, ("b", "c"): 2, ("b", "d"): 2, ("b", "e"): 6, ("a", "d"): 1, ("c", "d"): 1, ("a", "e"): 5, ("c", "e"): 1}
    order, low = sorted(out, key=lambda r: r.p_value), 1.0
    for k in range(len(order) - 1, -1, -1):
        low = min(low, order[k].p_value * 10 / (k + 1))  # five files, ten tests
        assert abs(order[k].q_value - low) < 1e-9
