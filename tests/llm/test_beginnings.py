import pytest

from repolith.llm.syntax import parses, ranking

VALID = [
    ("java", "module a.b { requires java.base; exports a.b.c to d, e; provides p.Q with r.S; }"), ("java", "open module a { }"), ("java", "import x.Y;\n@Deprecated module m { uses a.B; opens q; }"),
    ("java", "void main() { }"), ("java", "String greet(int a) { return \"x\"; }\nint n = 3;"), ("java", "public/* */class A {}"), ("java", "int module = 07, open = 0, with = 0x8;"), ("java", "import module java.base;\nclass A { int to; }"),
    ("rust", "/* /* */ */ fn f() {}"), ("rust", "fn f() { let x = 5u8 + 1_000 + 0xffu32 + 1e3f64; }"),
    ("go", "package /* c */ a"), ("go", "package\nmain\n"), ("javascript", "using x = f();"), ("javascript", "async function g() { await using y = h(); for (using z of w) {} }"), ("javascript", "using = 3;"),
    ("typescript", "let x = <number>y;"), ("typescript", "const f = <T>(x: T) => x;"), ("typescript", "let v = <const>['a'];"), ("python", "impl in x\n"), ("python", "var if a else b\n"),
]
BROKEN = [("java", "class A { int x = 08; }"), ("java", "module a { requires ; }"), ("java", "void main() {"), ("rust", "fn f() { let 5x; }"), ("rust", "fn f() { let x = 0b12; }"), ("go", "package"), ("javascript", "using x;"), ("javascript", "let x = <number>y;"), ("python", "impl X\n")]


@pytest.mark.parametrize("language,text", VALID)
def test_valid_beginnings(language, text):
    assert parses(text, language)


@pytest.mark.parametrize("language,text", BROKEN)
def test_broken_texts(language, text):
    assert not parses(text, language)


def test_ranking_reads_tokens_only():
    assert ranking('# fn let mut impl pub use ::\ndef f(self):\n    """func := package nil"""\n    return None\n')[0] == "python"
    assert ranking("fn f() -> u8 { let mut x = a::b(); match x { _ => 1 } }")[0] == "rust"
    assert ranking("") == ranking("// def elif None\n") and ranking("")[0] == "typescript"
