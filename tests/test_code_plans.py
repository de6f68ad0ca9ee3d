"""Imports, symbols, calls and what is resolved from them, on a small tree with every kind of link."""

import pytest

from repolith.plans import ALL

QUERIES = {k: q for m in ALL for k, q in m.QUERIES.items()}
FILES = "file_id long, repo string, path string, file_text string, symbols array<struct<name: string, kind: string, line: int, end_line: int, exported: boolean, documentation: string>>"
TREE = {
    "src/a.ts": "import { b as bee, other } from './lib/b.js';\nimport main from '../main';\nexport class A extends Base implements Shape {\n  run(x: number) {\n    return bee(x);\n  }\n}\nexport const go = (n: number) => other(n);\n",
    "src/lib/b.ts": "export function b() {\n  return helper();\n}\nexport function other() {}\nfunction helper() {}\nexport class Base {}\n",
    "main.ts": "const z = 1;\nexport default function start() {}\n",
    "pkg/x.py": "from .y import f\nfrom ..top import g as gg\nimport pkg.sub\nclass K(Base):\n    def m(self):\n        return f(gg())\n",
    "pkg/y.py": "def f(v):\n    return v\n",
    "pkg/sub/__init__.py": "",
    "top.py": "def g():\n    return 1\n\ndef _hidden():\n    return g()\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\tu "internal/util"\n)\n\ntype T struct{}\n\nfunc (t *T) Do() { Run() }\nfunc Run() {}\n',
    "internal/util.go": "package util\n",
    "src/core/Job.java": "package core;\nimport core.Base;\npublic class Job extends Base {\n  public void run() { go(); }\n}\n",
    "src/core/Base.java": "package core;\npublic abstract class Base {}\n",
    "src/lib.rs": "mod util;\nuse crate::util::thing;\npub struct S;\nimpl Shape for S {\n    pub fn area(&self) -> u32 { thing() }\n}\n",
    "src/util.rs": "pub fn thing() -> u32 { 1 }\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    spark.createDataFrame([(i, "o/r", p, t, []) for i, (p, t) in enumerate(TREE.items())] + [(99, "o/r", "z.ts", None, None)], FILES).write.parquet(str(d / "files.parquet"))
    return str(d)


def rows(spark, tree, name, *cols):
    return {tuple(r[c] for c in cols) for r in QUERIES[name](spark, tree).collect()}


def test_imports_meet_files(spark, tree):
    got = {s: t for s, t in rows(spark, tree, "jn_01_import_resolution", "source", "target")}
    assert got == {"./lib/b.js": "src/lib/b.ts", "../main": "main.ts", ".y": "pkg/y.py", "..top": "top.py", "pkg.sub": "pkg/sub/__init__.py", "fmt": None, "internal/util": "internal/util.go", "core.Base": "src/core/Base.java", "util": "src/util.rs", "crate::util::thing": None}


def test_symbols_know_their_parent(spark, tree):
    got = rows(spark, tree, "src_05_symbols", "name", "kind", "exported", "parent")
    assert {("run", "method", False, "A"), ("go", "function", True, ""), ("K", "class", True, ""), ("m", "method", True, "K"), ("_hidden", "function", False, ""), ("Do", "method", True, "T"), ("run", "method", True, "Job"), ("area", "method", True, "S"), ("helper", "function", False, "")} <= got


def test_calls_meet_symbols(spark, tree):
    got = rows(spark, tree, "jn_07_call_targets", "path", "caller", "callee", "target_path")
    assert ("src/a.ts", "go", "other", "src/lib/b.ts") in got and ("src/lib.rs", "area", "thing", "src/util.rs") in got and ("cmd/main.go", "Do", "Run", "cmd/main.go") in got
    assert ("src/lib/b.ts", "b", "helper", "src/lib/b.ts") in got and ("pkg/x.py", "m", "f", "pkg/y.py") in got and ("top.py", "_hidden", "g", "top.py") in got


def test_inheritance_prefers_the_own_file(spark, tree):
    got = rows(spark, tree, "jn_08_inheritance", "name", "relation", "base", "target_path")
    assert ("A", "extends", "Base", "src/core/Base.java") in got and ("A", "implements", "Shape", None) in got and ("Job", "extends", "Base", "src/core/Base.java") in got and ("S", "implements", "Shape", None) in got


def test_bindings(spark, tree):
    got = rows(spark, tree, "jn_10_bindings", "bound", "specifier", "is_default", "symbol", "target")
    assert {("bee", "b", False, "b", "src/lib/b.ts"), ("other", "other", False, "other", "src/lib/b.ts"), ("main", "default", True, "start", "main.ts"), ("gg", "g", False, "g", "top.py")} <= got


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], FILES).write.parquet(str(tmp_path / "files.parquet"))
    for name in ("src_05_symbols", "src_05_imports", "src_05_calls", "jn_01_import_resolution", "jn_07_call_targets", "jn_10_bindings", "cpx_05_file_score", "cpx_04_symbol_cognitive"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0
