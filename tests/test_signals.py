"""Complexity signals: those of the SQL, from a plan that doesn't grow with the mentions of its relations."""

import duckdb

from repolith.plans import metrics

FILES = "file_id long, repo string, path string, file_text string"
BRANCHES = "".join(f"  if (x > {i} && y) {{\n    for (;;) {{ this.run({i}); }}\n  }}\n" for i in range(20))
TREE = {
    "src/deep.ts": "import { f } from './flat';\nexport class Deep {\n  run(x: number) {\n" + BRANCHES + "  }\n}\n",
    "src/flat.ts": "export function f() {\n" + "  g();\n" * 110 + "}\nexport const open = (n: number) => {\n  /* never\n closed {\n",
    "src/many.ts": "".join(f"import a{i} from 'm{i}';\n" for i in range(12)) + "export const z = 1;\n",
    "src/closing.java": "}\n}\npublic class A {\n  public void b() { } }\n  public void c() {\n  }\n}\n",
    "pkg/long.py": "from .y import f\nclass K(Base):\n    def m(self):\n" + "        if a and b or c:\n            pass\n" * 60 + "def last():\n    return 1",
    "pkg/y.py": "def f(v):\n    return v\n",
    "main.go": 'package main\n\nimport (\n\t"fmt"\n\t"pkg"\n)\n\nfunc Run() {\n\tif x {\n\t\tgo y()\n\t}\n}\n',
    "lib.rs": "mod util;\nimpl Shape for S {\n    pub fn area(&self) -> u32 { match x { _ => { 1 } } }\n}\n",
    "notes.md": "# if for\n",
    "empty.py": "",
}


def test_signals_like_their_sql(spark, tmp_path):
    rows = [(i, "o/r", p, t) for i, (p, t) in enumerate(TREE.items())] + [(0, "O/R.git", "src/deep.ts", TREE["src/deep.ts"]), (50, "o/r", "nothing.ts", None), (51, None, "src/deep.ts", TREE["src/deep.ts"])]
    spark.createDataFrame(rows, FILES).write.parquet(str(tmp_path / "files.parquet"))
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    out = metrics.QUERIES["cpx_07_signals"](spark, str(tmp_path))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
    # stated anew at every mention, the lines of the files were read 54 times
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 9
    c = duckdb.connect()
    c.execute(f"create view files as select * from '{tmp_path}/files.parquet/*.parquet'")
    want = sorted(c.execute(metrics.SQL["cpx_07_signals"]).fetchall())
    assert sorted(map(tuple, out.collect())) == want and {"complex-symbol", "long-function", "high-cyclomatic", "high-cognitive", "high-coupling", "instability-zone"} <= {r for _, r in want}


def test_signals_of_no_files(spark, tmp_path):
    spark.createDataFrame([], FILES).write.parquet(str(tmp_path / "files.parquet"))
    assert metrics.QUERIES["cpx_07_signals"](spark, str(tmp_path)).count() == 0
