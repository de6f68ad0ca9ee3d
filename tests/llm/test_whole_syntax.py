import pytest

from repolith.llm.syntax import parses


@pytest.mark.parametrize("text", ["use ::std::fmt;\n", "use {a, b};\n", "extern { fn f(); }\n", "/* a /* b */ c */\nfn f() {}\n", "/* a /* b */ c */", ";\nfn f() {}", "m ! { }\n"])
def test_rust_may_begin_so(text):
    assert parses(text, "rust")


@pytest.mark.parametrize("text", ["use ;\n", "extern = 1\n", "/* a /* b */ fn f() {}\n", "auto = 1\n", "union.x()\n"])
def test_rust_may_not_begin_so(text):
    assert not parses(text, "rust")
