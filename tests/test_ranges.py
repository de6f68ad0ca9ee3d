import json
import random

from repolith.operators.ranges import overlap_join
from repolith.sources import manifests


def test_like_brute_force(spark):
    rng = random.Random(7)
    one = [(i, rng.choice(["x", "y", None]), a := rng.randrange(-50, 90), a + rng.choice([0, 3, 40, -1])) for i in range(40)] + [(99, "x", None, 3)]
    two = [(i, rng.choice(["x", "y"]), a := rng.randrange(-50, 90), a + rng.choice([0, 5, 70])) for i in range(40)]
    got = overlap_join(spark.createDataFrame(one, "i long, k string, a long, b long"), spark.createDataFrame(two, "j long, k string, c long, d long"), ["k"], ("a", "b"), ("c", "d"), 8).select("i", "j").collect()
    want = sorted((i, j) for i, k, a, b in one for j, m, c, d in two if k == m and a is not None and a <= b and a <= d and c <= b)
    assert sorted(map(tuple, got)) == want


def test_workspace(spark, tmp_path):
    for name, body in {"a": {"name": "a", "version": "1", "dependencies": {"b": "^1", "z": "1"}}, "b": {"name": "b", "private": True, "devDependencies": {"z": "2"}, "peerDependencies": {"z": "3"}}, "node_modules/c": {"name": "c"}}.items():
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "package.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "package.json").write_text("{")
    pkgs, deps = manifests.packages(spark, str(tmp_path))
    assert sorted((r.name, r.private) for r in pkgs.collect()) == [("a", False), ("b", True)]
    assert {(r.name, r.dependency, r.range, r.section) for r in deps.collect()} == {("a", "b", "^1", "dependencies"), ("a", "z", "1", "dependencies"), ("b", "z", "2", "devDependencies")}
    assert [(r.dependency, r.ranges) for r in manifests.mismatched(deps).collect()] == [("z", ["1", "2"])]
    assert [tuple(r) for r in manifests.local_links(pkgs, deps).collect()] == [("a", "b")]
    t = manifests.teams(spark, '[{"name": " T ", "repos": ["o/r "], "projects": ["P", "Q"]}, {"name": ""}]')
    assert sorted(map(tuple, t.collect())) == [("T", "o/r", "P"), ("T", "o/r", "Q")]
