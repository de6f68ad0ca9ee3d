import json
import subprocess

import pytest

from repolith.sources import code, connectors, store, text


def test_parse_and_resolve(spark):
    files = [
        ("src/a.ts", "import { b } from './b.js';\nimport x from 'lodash';\nexport class A {\n  run(x) {\n  }\n}\nexport const go = (a) => 1;\n"),
        ("src/b.ts", "function hidden() {}\n"), ("p/m.py", "from .n import q\nimport p.n\nclass C:\n    def m(self): pass\ndef _h(): pass\n"), ("p/n.py", ""),
        ("x.rs", "use crate::y::Z;\nimpl A for B {\n    pub fn f() {}\n}\n"), ("src/y/Z.rs", "x"), ("q.txt", "class A"), ("n.go", None),
    ]
    d = spark.createDataFrame(files, "path string, text string")
    rows = code.parse(d).cache()
    sym = {(r.path, r.name, r.kind, r.exported, r.parent) for r in rows.filter("what = 'symbol'").collect()}
    assert {("src/a.ts", "A", "class", True, None), ("src/a.ts", "run", "method", False, "A"), ("src/a.ts", "go", "function", True, None), ("src/b.ts", "hidden", "function", False, None), ("p/m.py", "m", "method", True, "C"), ("p/m.py", "_h", "function", False, None), ("x.rs", "f", "method", True, "B")} <= sym
    got = {(r.path, r.target) for r in code.resolve(rows, d).collect()}
    assert got == {("src/a.ts", "src/b.ts"), ("p/m.py", "p/n.py"), ("x.rs", "src/y/Z.rs")}


def test_own_provider(spark):
    code.register(code.Provider("toy", ("toy",), symbols=(("function", r"^fun (?P<name>\w+)"),)))
    assert next(code.provider_for("a.toy").rows("a.toy", "fun f"))[3] == "f"


def test_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.py").write_text("def f(): pass")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "node_modules" / "c.js").write_text("no")
    assert [tuple(r) for r in code.scan(spark, str(tmp_path)).collect()] == [("a.py", "def f(): pass")]


def test_diffs(spark):
    d = "diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ f\n a\n+b\n-c\n+d\n@@ -9 +10 @@\n-x\n+y\ndiff --git a/z b/z\n@@ -0,0 +1,2 @@\n+1\n+2"
    rows = text.diff_hunks(spark.createDataFrame([(1, d), (2, None), (3, "")], "id long, t string"), "id", "t").orderBy("hunk").collect()
    assert [(r.path, r.old_start, r.old_lines, r.new_start, r.new_lines, r.added, r.removed) for r in rows] == [("x.py", 1, 2, 1, 3, 2, 1), ("x.py", 9, 1, 10, 1, 1, 1), ("z", 0, 0, 1, 2, 2, 0)]


def test_sections_rules_and_links(spark):
    m = "# One\nintro\n## Two, sub\nbody\n### Deep\nx\n# Three\n"
    got = {r.slug: r.body for r in text.sections(spark.createDataFrame([(1, m), (2, None)], "id long, t string"), "id", "t").collect()}
    assert got == {"one": "intro\n## Two, sub\nbody\n### Deep\nx", "two-sub": "body\n### Deep\nx", "deep": "x", "three": ""}
    assert text.rules_of("## INV-001: No cycles\n- **Severity:** high\n- from: `src/**`\n## INV-002: Names\n") == [{"id": "INV-001", "title": "No cycles", "severity": "high", "from": "src/**"}, {"id": "INV-002", "title": "Names"}]
    assert text.next_link('<http://x/1>; rel="prev", <http://x/3?a=b>; rel="next"') == "http://x/3?a=b" and text.next_link(None) is None


def test_git_log(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=a", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "f.txt").write_text("1\n2\n")
    run("add", "."), run("commit", "-qm", "first")
    (tmp_path / "f.txt").write_text("1\n")
    run("commit", "-qam", 'Revert "first"')
    connectors.register(spark)
    rows = spark.read.format("git_log").load(str(tmp_path)).collect()
    assert {(r.subject, r.path, r.additions, r.deletions, r.is_revert) for r in rows} == {("first", "f.txt", 2, 0, False), ('Revert "first"', "f.txt", 0, 1, True)}


def test_pages(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps({"values": [1, 2], "next": "b.json"}))
    (tmp_path / "b.json").write_text(json.dumps({"values": [3], "next": "0.json"}))
    connectors.register(spark)
    assert [r.value for r in spark.read.format("paged_json").load(str(tmp_path)).orderBy("value").collect()] == ["1", "2", "3"]
    cut = spark.read.format("paged_json").option("max", 2).load(str(tmp_path)).collect()
    assert [(r.value, r.truncated) for r in sorted(cut)] == [("1", False), ("2", True)]


def test_snapshots(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, text string")
    old, new = files([("a", "1"), ("b", "2"), ("c", None)]), files([("a", "1"), ("b", "x"), ("d", "")])
    got = dict(map(tuple, store.changed(store.fingerprints(old), store.fingerprints(new)).collect()))
    assert got == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    listing = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "path string, modified_us long")
    assert store.snapshot_is_valid(old, listing, 10, 20) and not store.snapshot_is_valid(old, listing, 6, 20) and not store.snapshot_is_valid(new, listing, 10, 20) and not store.snapshot_is_valid(old, listing, 10, 10**12)


def test_graph_store(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "path string, name string")
    store.write_graph({"symbols": rows([("a", "x"), ("b", "y"), ("c", "z")])}, str(tmp_path))
    store.upsert_graph(spark, {"symbols": rows([("a", "x2")])}, rows([("a", ""), ("b", "")]), str(tmp_path))
    read = lambda: sorted((r.path, r.name) for r in spark.read.parquet(f"{tmp_path}/symbols").collect())
    assert read() == [("a", "x2"), ("c", "z")]
    store.upsert_graph(spark, {"symbols": rows([("a", "x2")])}, rows([("a", "")]), str(tmp_path))
    assert read() == [("a", "x2"), ("c", "z")]
    assert sorted(map(tuple, store.merged(rows([("a", "1"), ("b", "2")]), rows([("a", "3")]), "path").collect())) == [("a", "3"), ("b", "2")]


@pytest.mark.parametrize("style", ["mermaid", "dot", "ascii", "json"])
def test_renderers(spark, style):
    out = store.render_edges(spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string"), style, 1)
    assert "a" in out and "b" in out and '"c"' not in out
    assert "fix it" in store.render_changelog(spark.createDataFrame([("bugfix", "fix it")], "kind string, title string"), "plain")
