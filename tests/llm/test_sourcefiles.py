import ast

import pytest

from repolith.llm import sourcefiles
from repolith.llm.syntax import LANGUAGES, parses, ranking

GOOD = {
    "typescript": ["", "// only\n", "const f = async <T extends object>(a: T, {b, c = 2}: {b: number; c?: number}): Promise<Map<string, T[]>> => { return new Map(); };", "export default class A<T> extends B<T> implements C { private readonly x?: number = 1; constructor(private y: string) { super(); } get z(): number { return this.x!; } static async *g() {} [k: string]: any; }", "type A = { [K in keyof B]?: B[K] } | ((x: number) => void);\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number }", "const s = `a ${b ? `in ${c}` : '}'}`; const r = /[/{(]+\\/x/g.test(s)\nlet y = a / b / c", "label: for (const [k, v] of Object.entries(x)) { if (k) continue label; else break }"],
    "javascript": ["#!/usr/bin/env node\n'use strict'", "import a, { b as c } from './x.js'; export * from 'y'; export { c as default };", "function* g({a, ...rest} = {}, [b,,c] = []) { yield* a?.b?.[c]?.(rest) ?? 1 ** 2 }", "try { x() } catch { y() } finally { z() }\ndo { i++ } while (i < 3)\nswitch (a) { case 1: case 'b': break; default: { } }", "const o = { async m() {}, get p() { return 1 }, [q]: 2, 'r': 3, ...s, t }"],
    "python": ["", "# c\n", "async def f(a, /, b=1, *, c: int = 2) -> None:\n    async with x as y: pass\n", "match x:\n    case {'a': 1}: pass\n"],
    "go": ["package a", "", "// c", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\tm map[K]V `json:\"m\"`\n\tsync.Mutex\n}\n\nfunc (t *T[K, V]) Get(k K) (v V, ok bool) {\n\tif v, ok = t.m[k]; ok {\n\t\treturn\n\t}\n\tfor i, x := range []int{1, 2} {\n\t\tgo func() { ch <- i }()\n\t\tselect {\n\t\tcase y := <-ch:\n\t\t\t_ = y\n\t\tdefault:\n\t\t}\n\t}\n\tswitch z := any(x).(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\treturn v, ok\n}\n"],
    "java": ["", "package a.b; import static x.Y.*; @A(b = \"{\") public final class C<T extends D & E> extends F<T> implements G { static { } private int[] x = {1, 2}, y; <U> C(U u) throws H { this.x = new int[3]; } abstract void m(final int... a); }", "record P(int x, int y) { } sealed interface S permits P { default void f() { var z = switch (1) { case 1 -> 2; default -> { yield 3; } }; } }", "enum E { A(1) { void f() {} }, B; E() {} E(int i) {} }", "class A { void f() { for (int i = 0, j = 1; i < j; i++, j--) ; for (String s : l) { } try (var r = g()) { } catch (X | Y e) { } finally { } Runnable q = () -> { }; String t = \"\"\"\n  { \"\"\"; o = (String) p; List<? super A>[] w = (a) -> b::c; synchronized (this) { } do x--; while (x > 0); } }"],
    "rust": ["", "#![allow(x)]\nuse a::{b, c::*, d as _};\npub(crate) fn f<'a, T: A + 'a, const N: usize>(x: &'a mut [T; N], (y, _): (u8, &str)) -> Result<impl Fn(i32) -> T, Box<dyn E>> where T: Clone { let z = match x { Some(A { b, .. }) if b > 1 => { 1 } 1..=5 | 7 => 2, _ => return Err(e)?, }; if let Some(q) = z && true { } else { loop { break 'l 3; } } let w = |a: u8, b| -> u8 { a + b }; for i in 0..n { v[i] += 1 as u8; } x.iter().map(|x| x?).collect::<Vec<_>>() }", "impl<T> A<T> for B { type X = Y; const Z: u8 = 1; fn f(&self) -> Self { Self { a: 1, ..Default::default() } } } mod m { macro_rules! q { ($x:expr) => { $x } } } enum E { A(u8), B { c: u8 }, C = 3 } static S: &str = r#\"{\"#; trait T: U { fn f(self: Box<Self>); }", "fn main() { let c = '\\''; let d = b'{'; println!(\"{}\", c); vec![1; 2]; unsafe { *p = 1 } let Some(x) = y else { panic!() }; }"],
}
BAD = {
    "typescript": ["const x = ;", "function f( { return }", "class A { foo() { }", "import { a from 'x';", "<<<<<<< ours\nlet a = 1;\n", "let s = 'open", "/* open", "interface A { x: }", "if (a { b }"],
    "javascript": ["const x: number = 1;", "let a = (1, 2;", "for (const a of) {}", "return }", "const f = (a =>", "`open ${a}"],
    "python": ["def f(:\n  pass", "x = (1", "<<<<<<< a\n", "  x = 1\n y = 2"],
    "go": ["func f() {}", "package a\nfunc f() { x := }", "package a\nvar x = [2]int{1 2}", "package a\nfunc f() {", "package a\nimport {\n\"x\"\n}"],
    "java": ["class A { void f() { return } }", "class A { int x = 1 }", "package a\nclass A {}", "class A { void f( { } }", "class A { } }", "void f() { x(; }"],
    "rust": ["fn f( { }", "fn f() { let x = ; }", "struct A { b u8 }", "fn f() -> { }", "impl A { fn f(&self) { }", "fn f() { match x { 1 = 2 } }"],
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_syntax(language):
    for t in GOOD[language]:
        assert parses(t, language), t
        assert parses(t.replace("\n", "\r\n"), language), t
    for t in BAD[language]:
        assert not parses(t, language), t


def test_foreign_languages_fail_and_rank():
    for own in LANGUAGES:
        longest = max(GOOD[own], key=len)
        for other in LANGUAGES:
            if other != own and {own, other} != {"javascript", "typescript"}:
                assert not parses(longest, other), (own, other)
    assert ranking("def f(self):\n    return None\n")[0] == "python" and ranking("package a\nfunc f() { x := 1 }")[0] == "go"


FILES = [
    (1, "r", "a.ts", "/** Opens the door for visitors. */\nexport async function openDoor(a = {b: 1}) {\n  return 1;\n}\n\n/** Closes all the doors now.\n * @param x y */\nconst close = ({a, b}: {a: number}): void => {};\n\n/** TODO write this text down */\nfunction todo() {}\n\n// Not a real comment here.\nfunction plain() {}\nclass A {\n  /** Counts the visitors of today. */\n  @log('x)')\n  @once\n  static count(x) { return /[{(]/.test(x); }\n  /** the count of the visitors */\n  countVisitors() {}\n}\nconst s = `\n/** Inside a template literal only */\nfunction no() {}\n`;\n"),
    (2, "r", "b.py", "@deco\ndef f(a='x:', b=(1, 2)) -> int:\n    # note\n    r'''Adds two numbers together.\n\n    Args:\n        a: one\n    '''\n    return 1\n\nclass C:\n    async def g(self):\n        \"Too short here\"\n    def h(self):\n        '''Joined'''.strip()\n    def k(self):\n        x = 1\n        '''Not a docstring at all'''\n"),
    (3, "r", "c.go", "package a\n\n// Run starts the whole engine.\nfunc Run() {}\n\n// Stop ends the whole engine.\n\nfunc Stop() {}\n\n// Close shuts the door\n// behind all visitors.\nfunc (d *Door) Close() error { return nil }\n"),
    (4, "r", "d.rs", "/// Parses the given input text.\n///\n/// # Errors\n/// Never.\n#[inline]\n#[cfg(feature = \"x\")]\npub fn parse(s: &str) {}\nimpl A {\n    /// Gives the length of it.\n    pub(crate) unsafe fn len(&self) {}\n}\n//// Four slashes are no documentation.\nfn four() {}\n"),
    (5, "r", "E.java", "class E {\n  /** Finds the nearest open door. */\n  @Timed(\"a)\")\n  public static <T> List<T> find(int x) { return null; }\n  /** Just a field of it. */\n  private int y = 1;\n}\n"),
    (6, "r", "f.js", "/** Breaks before the end of it. */\nfunction broken( {\n"),
    (7, None, "g.js", None), (8, "r", "h.txt", "text"), (9, "r", "i.py", ""), (10, None, None, "x"),
]
SCHEMA = "file_id long, repo string, path string, file_text string"


def test_verdicts(spark):
    d = spark.createDataFrame([*FILES, (11, "r", "j.go", "import a from 'b';\nconst x = () => 1;\n"), FILES[5]], SCHEMA)
    v = sourcefiles.verdicts(d)
    got = {r.file_id: r.verdict for r in v.collect()}
    assert got == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "ok", 6: "corrupt", 7: "ok", 8: "unknown", 9: "ok", 10: "unknown", 11: "wrong_extension"}
    rate = {(r.repo, r.language): (r.files, r.bad_files) for r in sourcefiles.bad_rates(v).collect()}
    assert rate["r", "javascript"] == (1, 1) and rate["r", "go"] == (2, 1)
    assert sourcefiles.verdicts(d.limit(0)).count() == 0


def test_documented(spark):
    d = spark.createDataFrame([*FILES, FILES[0]], SCHEMA)
    rows = sourcefiles.documented(d).collect()
    good = {(r.file_id, r.symbol_name, r.line, r.kind) for r in rows if r.meaningful}
    assert good == {(1, "openDoor", 2, "function"), (1, "close", 8, "arrow"), (1, "count", 19, "method"), (2, "f", 2, "function"), (3, "Run", 4, "function"), (3, "Close", 12, "method"), (4, "parse", 7, "function"), (4, "len", 10, "method"), (5, "find", 4, "method")}
    text = {r.symbol_name: r.description for r in rows}
    assert text["f"] == "Adds two numbers together." and text["parse"] == "Parses the given input text." and text["close"] == "Closes all the doors now." and text["Close"] == "Close shuts the door behind all visitors."
    assert {r.symbol_name for r in rows if not r.meaningful} == {"todo", "countVisitors", "g"}
    assert sourcefiles.documented(d.limit(0)).count() == 0


def test_docstrings_agree_with_the_parser(spark):
    text = FILES[1][3]
    want = {(n.name, n.lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(n) is not None}
    got = {(r.symbol_name, r.line) for r in sourcefiles.documented(spark.createDataFrame([FILES[1]], SCHEMA)).collect()}
    assert got == want
