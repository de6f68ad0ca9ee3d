"""Queries over small tables whose right rows a cut of the input would lose."""

from datetime import datetime, timedelta

from repolith.plans import ALL, graphs, search

QUERIES = {k: q for m in ALL for k, q in m.QUERIES.items()}
FILES = "file_id long, repo string, path string, file_text string, symbols array<struct<name: string, kind: string, line: int, end_line: int, exported: boolean, documentation: string>>"


def parts(spark, tmp_path, brands):
    spark.createDataFrame([(i, b, 1) for i, b in brands.items()], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_package_cycle_of_any_modules(spark, tmp_path):
    d = parts(spark, tmp_path, {1: "B", 2: "A", 5: "B"})  # 2 -> 1 and 5 -> 2
    assert {tuple(r) for r in graphs.gr_09_package_cycles(spark, d).collect()} == {("a", "b"), ("b", "b")}


def test_hot_paths_from_every_entry(spark, tmp_path):
    d = parts(spark, tmp_path, {i: "B" for i in [3, 5, *(2**k for k in range(14))]})
    far = [2**k for k in range(13, -1, -1)] + [0]
    want = [(3, 0, 3, "3>1>0"), (5, 0, 3, "5>1>0"), (8192, 0, 15, ">".join(map(str, far)))]
    assert sorted(map(tuple, graphs.gr_10_hot_paths(spark, d).collect())) == want


def test_package_used_by_an_odd_module(spark, tmp_path):
    d = parts(spark, tmp_path, {1: "B", 3: "A"})  # 3 -> 1
    assert [r.layer for r in QUERIES["mon_01_unused_packages"](spark, d).collect()] == ["a"]


def test_every_line_has_its_symbol(spark, tmp_path):
    rows = [(1, "r", "a.py", "x = 1\ny = 2\n\nz = 3", [("f", "function", 2, 2), ("g", "class", 2, 2), ("g", "function", 2, 2), ("h", "function", 4, 4)])]
    spark.createDataFrame([(*r[:4], [(*y, True, None) for y in r[4]]) for r in rows], FILES).write.parquet(str(tmp_path / "files.parquet"))
    assert sorted(map(tuple, QUERIES["jn_11_containing_symbol"](spark, str(tmp_path)).collect())) == [(1, 2, "g"), (1, 3, "g"), (1, 4, "h")]


def commits(spark, tmp_path, rows):
    kinds = "repo string, sha string, path string, additions long, deletions long, author string, committed_at timestamp, is_merge boolean, status string"
    spark.createDataFrame([("r", sha, path, 1, 0, "x", at, False, "m") for sha, path, at in rows], kinds).write.parquet(str(tmp_path / "commit_changes.parquet"))
    spark.createDataFrame([], FILES).write.parquet(str(tmp_path / "files.parquet"))  # no file imports another
    return str(tmp_path)


def test_large_commits_count(spark, tmp_path):
    at = datetime(2025, 1, 1)
    d = commits(spark, tmp_path, [(f"s{k}", p, at) for k in range(4) for p in ["a", "b", *(f"{k}/{i}" for i in range(25))]])
    assert [tuple(r) for r in QUERIES["jn_17_co_change"](spark, d).collect()] == [("r", "a", "b", 4)]
    assert [tuple(r) for r in QUERIES["cog_04_implicit_coupling"](spark, d).collect()] == [("r", "a", "b", 100.0)]
    assert [tuple(r) for r in search.tmp_04_clusters(spark, d).collect()] == [("r", "a", "b")]


def test_trajectory_to_the_last_commit(spark, tmp_path):
    d = commits(spark, tmp_path, [(f"s{k:02d}", "a", datetime(2025, 1, 1) + timedelta(days=k)) for k in range(40)])
    assert sorted((r.k, r.sha) for r in QUERIES["drf_03_trajectory"](spark, d).collect()) == [(k + 1, f"s{k:02d}") for k in range(40)]


def test_direct_dependencies_are_not_implicit(spark, tmp_path):
    at = datetime(2025, 1, 1)
    rows = [(f"s{k}", p, at) for k in range(4) for p in ["src/a.ts", "src/b.ts", "src/c.ts"]]
    kinds = "repo string, sha string, path string, additions long, deletions long, author string, committed_at timestamp, is_merge boolean, status string"
    spark.createDataFrame([("r", sha, path, 1, 0, "x", t, False, "m") for sha, path, t in rows], kinds).write.parquet(str(tmp_path / "commit_changes.parquet"))
    texts = {"src/a.ts": "import { b } from './b';\nexport function f() { return b(); }\n", "src/b.ts": "export function b() {}\n", "src/c.ts": ""}
    spark.createDataFrame([(i, "r", p, t, []) for i, (p, t) in enumerate(texts.items())], FILES).write.parquet(str(tmp_path / "files.parquet"))
    d = str(tmp_path)
    assert {(r.path_a, r.path_b) for r in QUERIES["cog_04_implicit_coupling"](spark, d).collect()} == {("src/a.ts", "src/c.ts"), ("src/b.ts", "src/c.ts")}
    assert [(r.source, r.target) for r in QUERIES["jn_01_import_resolution"](spark, d).collect()] == [("./b", "src/b.ts")]
