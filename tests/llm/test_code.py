import ast

from repolith.llm import sourcefiles

PY = '''import os

@deco(1)
def outer(a,
          b=(1,
2)):
    """Adds two numbers to each other."""
    def inner(x):
        ''' + "'''Gives the number back as it is.'''" + '''
        return """text
at the margin"""

    # a comment
# another at the margin
    return (a +
b)


class K:
    async def go(self):
        """Goes on until it is done."""
        if self:
            return 1

        return 2
    x = 1

def last():
    """Closes the file without a newline."""
    return 3'''
TS = """export class A {
  /** Adds two numbers to each other. */
  @dec({ a: 1 })
  add(a: { x: number }, b: number): { y: number } {
    const s = "}";
    return { y: a.x + b };
  }
  /** Is declared here without a body. */
  abstract later(x: number[]): void;
}
/** Doubles the number that is given. */
export const twice = (x: number) => x * 2;
/** Calls back with the number given. */
const call = async (f: F): Promise<Z> => {
  return { z: await f() };
};
/** Same line as its documentation comment. */ function same() { return `${1}}`; }
"""
GO = """package a

// Get returns the value that is kept.
func (m *M) Get(k string) interface{} {
	if k == "}" {
		return nil
	}
	return m[k]
}
"""
RUST = """impl A {
    /// Sums the four bytes that are given.
    #[inline]
    pub fn sum(&self, x: [u8; 4]) -> u32 {
        x.iter().map(|b| { *b as u32 }).sum()
    }
}
trait T {
    /// Has no body in this trait.
    fn f(&self, x: [u8; 4]) -> u32;
}
"""
JAVA = """class A {
    /** Runs the job that was given. */
    @Override
    public void run(int[] a) throws E {
        for (int x : a) { go(x); }
    }
}
"""


def test_code_of_functions(spark):
    rows = [(1, "a.py", PY), (2, "a.ts", TS), (3, "a.go", GO), (4, "a.rs", RUST), (5, "A.java", JAVA), (6, "b.py", ""), (7, "b.ts", None), (8, "b.go", "package")]
    got = {(r.file_id, r.symbol_name): r for r in sourcefiles.documented(spark.createDataFrame(rows + rows[:1], "file_id long, path string, file_text string"), code=True).collect()}
    lines = PY.split("\n")
    for node in ast.walk(ast.parse(PY)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            r = got[1, node.name]
            assert (r.line, r.end_line) == (node.lineno, node.end_lineno), node.name
            assert r.code == "\n".join(lines[node.lineno - 1 : node.end_lineno]).strip()
    code = {k[1]: (r.line, r.end_line, r.code) for k, r in got.items() if k[0] > 1}
    assert code["add"] == (4, 7, "\n".join(TS.split("\n")[3:7]).strip())
    assert "later" not in code  # members without a body aren't methods of a class
    assert code["twice"][2].startswith("export const twice = (x: number) => x * 2") and code["twice"][1] == 12
    assert code["call"] == (14, 16, "\n".join(TS.split("\n")[13:16]).rstrip(";"))
    assert code["same"] == (17, 17, "function same() { return `${1}}`; }")
    assert code["Get"] == (4, 9, "\n".join(GO.split("\n")[3:9]))
    assert code["sum"] == (4, 6, "\n".join(RUST.split("\n")[3:6]).strip()) and code["f"][:2] == (10, 10)
    assert code["run"] == (4, 6, "\n".join(JAVA.split("\n")[3:6]).strip())
    assert len(got) == 12
