import random
from datetime import datetime

from repolith.llm import cooccurrence, queries


def test_found_pairs_are_tested_among_all(spark, tmp_path, monkeypatch):
    """p7_found goes through counts, null, tails and false discovery of every pair, then takes those at the thresholds."""
    rng = random.Random(5)
    rows = [(f"s{c}", f"f{f}") for c in range(60) for f in rng.sample(range(14), rng.choice([1, 2, 3, 6]))] + [(f"s{c}", x) for c in range(8) for x in ("p", "q")]
    spark.createDataFrame([("r", sha, p, datetime(2025, 1, 1)) for sha, p in rows], "repo string, sha string, path string, committed_at timestamp").write.parquet(str(tmp_path / "commit_changes.parquet"))
    seen, surprise = [], cooccurrence.surprise
    monkeypatch.setattr(cooccurrence, "surprise", lambda inc, pairs: seen.append(surprise(inc, pairs)) or seen[-1])
    out = queries.p7_found(spark, str(tmp_path))
    sets = {}
    for sha, p in rows:
        sets.setdefault(p, set()).add(sha)
    total, count = len(set().union(*sets.values())), {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    at = {(a, b) for (a, b), c in count.items() if c >= 4 and 2 * c >= min(len(sets[a]), len(sets[b])) and c * total >= 2 * len(sets[a]) * len(sets[b])}
    assert {(r.path_a, r.path_b) for r in out.collect()} == at and ("p", "q") in at
    assert len(seen) == 1 and "sum_upto_pairs" in out._jdf.queryExecution().optimizedPlan().toString()
    tested = sorted(seen[0].collect(), key=lambda r: r.p_value)
    assert len(tested) == sum(c > 0 for c in count.values()) > len(at)
    tests, low = len(sets) * (len(sets) - 1) / 2, 1.0
    for k in range(len(tested) - 1, -1, -1):
        low = min(low, tested[k].p_value * tests / (k + 1))
        assert abs(tested[k].q_value - low) < 1e-9


def test_tail_of_one_success_keeps_its_precision():
    import numpy as np

    p, many = np.array([[1e-17, 3e-18], [0.2, 0.5], [0.0, 0.0]]), np.array([3.0, 2.0])
    got = cooccurrence.upper_tails(p, many, np.ones(3))
    assert abs(got[0] / 3.6e-17 - 1) < 1e-12 and abs(got[1] - (1 - 0.8**3 * 0.5**2)) < 1e-12 and got[2] < 1e-290
