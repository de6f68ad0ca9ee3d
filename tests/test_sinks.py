import json
import subprocess

import pytest

from repolith.api import TOOLS, Engine
from repolith.operators import greedy, rules
from repolith.sources import connectors, store, text
from repolith.streaming import events as ev


def test_merged_branches_and_unreadable_repositories(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=a", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "f").write_text("1\n")
    run("add", "."), run("commit", "-qm", "first"), run("checkout", "-qb", "side")
    (tmp_path / "g").write_text("2\n")
    run("add", "."), run("commit", "-qm", "on the side"), run("checkout", "-q", "main"), run("merge", "-q", "--no-ff", "-m", "joined", "side")
    connectors.register(spark)
    rows = spark.read.format("git_log").load(str(tmp_path)).collect()
    assert {(r.subject, r.path, r.is_merge) for r in rows} == {("first", "f", False), ("on the side", "g", False), ("joined", "g", True)}
    empty = tmp_path / "empty"
    empty.mkdir()
    subprocess.run(["git", "-C", str(empty), "init", "-q"], check=True)
    assert spark.read.format("git_log").load(str(empty)).count() == 0
    with pytest.raises(Exception, match="git log"):
        spark.read.format("git_log").load(str(tmp_path / "none")).count()


def test_snapshot_is_read_while_it_holds(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", None)], "path string, text string")
    listing = spark.createDataFrame([("a", 5), ("b", 6)], "path string, modified_us long")
    folder = f"{tmp_path}/s"
    assert store.read_snapshot(spark, folder, listing, 20) is None
    store.write_snapshot(files, folder, 10)
    assert store.read_snapshot(spark, folder, listing, 20).count() == 2
    assert store.read_snapshot(spark, folder, listing, 10**12) is None
    store.read_snapshot(spark, folder, listing, 20).withColumn("version", store.F.lit(0)).withColumn("written_us", store.F.lit(10)).write.parquet(f"{tmp_path}/old")
    assert store.read_snapshot(spark, f"{tmp_path}/old", listing, 20) is None


def test_index_sessions_and_commits(spark, tmp_path):
    schema = "doc string, idx long, value double"
    assert store.read_index(spark, f"{tmp_path}/i", schema).count() == 0
    store.write_index(spark.createDataFrame([("d", 1, 0.5)], schema), f"{tmp_path}/i")
    assert [tuple(r) for r in store.read_index(spark, f"{tmp_path}/i", schema).collect()] == [("d", 1, 0.5)]
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    store.append_sessions(one("s1"), f"{tmp_path}/h"), store.append_sessions(one("s2"), f"{tmp_path}/h")
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/h").collect()} == {"s1", "s2"}
    for x in ("c1", "c2"):
        store.sync_commits(one(x), one(x), one(x), f"{tmp_path}/g")
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/g/modified_in").collect()] == ["c2"]


def test_requests_and_deployments_from_pages(spark, tmp_path):
    (tmp_path / "r").mkdir()
    first = [{"number": 1, "title": "a", "state": "open", "updated_at": "2025-01-01T00:00:00Z"}, {"number": 2, "state": "closed", "updated_at": "2024-01-01T00:00:00Z"}]
    later = [{"number": 1, "title": "a", "state": "closed", "merged_at": "2025-01-03T00:00:00Z", "updated_at": "2025-01-03T00:00:00Z", "user": {"login": "u"}, "reviews": [{"submitted_at": "2025-01-02T05:00:00Z"}, {"submitted_at": "2025-01-02T01:00:00Z"}]}]
    (tmp_path / "r/0.json").write_text(json.dumps({"values": first}))
    (tmp_path / "r/0.json.link").write_text('<https://x/y/second.json>; rel="next"')
    (tmp_path / "r/second.json").write_text(json.dumps({"values": later}))
    connectors.register(spark)
    got = connectors.pull_requests(spark, [str(tmp_path / "r")], 1_730_000_000_000_000).collect()
    assert [(r.number, r.state, r.author, r.review_count, r.first_review.hour) for r in got] == [(1, "merged", "u", 2, 1)]
    assert spark.read.format("paged_json").option("budget_ms", -1).load(str(tmp_path / "r")).filter("truncated").count() == 1
    (tmp_path / "d").mkdir()
    rows = [{"id": 1, "environment": "Production", "created_at": "2025-01-01T00:00:00Z", "statuses": [{"state": "pending", "created_at": "2025-01-01T01:00:00Z"}, {"state": "error", "created_at": "2025-01-01T02:00:00Z"}]}, {"id": 2, "environment": "qa", "created_at": "2025-01-01T00:00:00Z"}, {"id": 3, "environment": "production", "created_at": "2025-01-01T00:00:00Z", "statuses": []}]
    (tmp_path / "d/0.json").write_text(json.dumps(rows))
    got = connectors.deployments(spark, [str(tmp_path / "d")], 0, ["PRODUCTION"]).collect()
    assert {(r.id, r.status) for r in got} == {(1, "failure"), (3, "unknown")}


def test_rules_of_every_type(spark):
    files = spark.createDataFrame([("src/a.ts",), ("lib/b.ts",), ("x.ts",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "lib/b"), ("src/a.ts", "fs"), ("lib/b.ts", "src/a"), (None, "fs")], "path string, source string")
    symbols = spark.createDataFrame([("src/a.ts", "class", "bad", None), ("lib/b.ts", "class", "Good", "text")], "path string, kind string, name string, documentation string")
    every = [
        {"id": "R1", "type": "no-import", "target": "fs", "scope": "src/**"}, {"id": "R2", "type": "require-import", "target": "lib/*", "scope": "*.ts"}, {"id": "R3", "type": "layer-boundary", "from": "lib/**", "to": "src/**"}, {"id": "R4", "type": "naming-pattern", "kind": "class", "pattern": "^[A-Z]"},
        {"id": "R5", "type": "max-dependencies", "most": 1}, {"id": "R6", "type": "annotation-required"}, {"id": "R7", "type": "file-pattern", "pattern": "**/*.ts"}, {"id": "R8", "type": "mine"}, {"id": "R9", "type": "unheard-of"},
    ]
    own = {"mine": lambda rule, f, i, s: f.filter("path like 'x%'").selectExpr("path", "'own' as detail")}
    broken = rules.violations(every, files, imports, symbols, own)
    got = {(r.rule, r.path) for r in broken.collect()}
    assert got == {("R1", "src/a.ts"), ("R2", "lib/b.ts"), ("R2", "x.ts"), ("R3", "lib/b.ts"), ("R4", "src/a.ts"), ("R5", "src/a.ts"), ("R6", "src/a.ts"), ("R7", "x.ts"), ("R8", "x.ts")}
    assert {r.rule for r in rules.passed(every, broken).collect()} == {"R9"}
    parsed = text.rules_of("## INV-001: No files\n- type: no-import\n- target: `fs`\n")
    assert {r.path for r in rules.violations(parsed, files, imports, symbols).collect()} == {"src/a.ts"}
    assert rules.violations([], files, imports, symbols).count() == 0


def test_costs_of_tests(spark):
    tests = spark.createDataFrame([("a_test.py",), ("integration/b.py",), ("c.py",)], "path string")
    runs = spark.createDataFrame([("c.py", 4.0, k < 2) for k in range(5)] + [("a_test.py", 6.0, True)], "path string, seconds double, failed boolean")
    assert {tuple(r) for r in greedy.test_costs(tests, runs).collect()} == {("a_test.py", 6.0, 0.0), ("integration/b.py", 10.0, 0.0), ("c.py", 4.0, 0.4)}
    assert {r.seconds for r in greedy.test_costs(tests).collect()} == {2.0, 10.0}


def test_reports_follow_changes(spark, tmp_path):
    schema = "path string, type string, at long"
    spark.createDataFrame([("a", "add", 1), ("a", "change", 3), ("b", "add", 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    deps = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, user string")
    ev.reanalysed(ev.stream(spark, f"{tmp_path}/in", schema), {"users": lambda d: d.join(deps, "path")}, lambda n, d, i: seen.extend((n, r.path, r.user, r.type) for r in d.collect()), f"{tmp_path}/c").awaitTermination()
    assert set(seen) == {("users", "a", "x", "change"), ("users", "b", "y", "add")}


@pytest.mark.parametrize("style,want", [("tree", "a\n  b\n    c"), ("html", "a &rarr; b")])
def test_more_renderers(spark, style, want):
    assert want in store.render_edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string"), style)


def test_tools_run_reports(spark):
    engine = Engine(spark, "/root/testdata/sf0.001")
    assert {t[0] for t in TOOLS.values() if t[0]} <= set(engine.reports())
    assert engine.call("volatility").columns == ["repo", "path", "volatility", "fragility"]
    assert engine.call("graph_stats").count() == 6 and engine.call("sql", text="select count(*) n from docs").first().n > 0
    with pytest.raises(ValueError):
        engine.call("volatility", colour="red")
    with pytest.raises(ValueError):
        engine.call("nothing")
