"""Source trees: scan, language providers, imports/exports/symbols, import resolution."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never scanned.
IGNORED = "node_modules dist build .git coverage vendor __pycache__ target bin obj .venv venv".split()

ROW = "path string, language string, what string, name string, kind string, source string, line int, exported boolean, parent string"


@dataclass
class Provider:
    """How a language is read line by line: patterns are (kind, regex with group ``name``)."""

    language: str
    extensions: tuple[str, ...]
    imports: tuple[str, ...] = ()
    symbols: tuple[tuple[str, str], ...] = ()
    exported: str = r""
    hidden: str = r"(?!)"
    basenames: tuple[str, ...] = ()
    entry_points: tuple[str, ...] = ()
    candidates: tuple[str, ...] = ("{p}",)
    compiled: list = field(default_factory=list, repr=False)

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        if not self.compiled:
            self.compiled = [[re.compile(p) for p in self.imports], [(k, re.compile(p)) for k, p in self.symbols], re.compile(self.exported), re.compile(self.hidden)]
        imports, symbols, exported, hidden = self.compiled
        parent, indent = None, 0
        for n, line in enumerate(text.splitlines(), 1):
            for p in imports:
                if m := p.search(line):
                    yield (path, self.language, "import", None, None, m["name"], n, False, None)
                    break
            for kind, p in symbols:
                if m := p.search(line):
                    deep = len(line) - len(line.lstrip())
                    if kind in ("class", "interface", "impl"):
                        parent, indent = m["name"], deep
                    elif deep <= indent:
                        parent = None
                    if kind != "impl":
                        out = bool(exported.search(line)) and not hidden.search(m["name"])
                        yield (path, self.language, "symbol", m["name"], "method" if kind == "function" and parent and deep > indent else kind, None, n, out, parent if kind not in ("class", "interface") else None)
                    break


_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_PROVIDERS: dict[str, Provider] = {}


def register(p: Provider) -> None:
    """Add a provider or replace the one of its language."""
    _PROVIDERS[p.language] = p


register(Provider("typescript", ("ts", "tsx", "js", "jsx", "mjs"), (r"^\s*import\b.*?['\"](?P<name>[^'\"]+)['\"]", r"\brequire\(['\"](?P<name>[^'\"]+)['\"]\)", r"^\s*export\b.*\bfrom\s+['\"](?P<name>[^'\"]+)['\"]"), (("class", rf"\bclass\s+{_NAME}"), ("interface", rf"^\s*(?:export\s+)?interface\s+{_NAME}"), ("type", rf"^\s*(?:export\s+)?type\s+{_NAME}\s*[=<]"), ("enum", rf"\benum\s+{_NAME}"), ("function", rf"\bfunction\s*\*?\s*{_NAME}"), ("function", rf"\bconst\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)[^=]*|\w+)\s*=>"), ("function", rf"^\s+(?:(?:static|async|public|private|protected)\s+)*(?!if|for|while|switch|catch|return){_NAME}\([^)]*\)[^;]*\{{\s*$")), r"^\s*export\b", candidates=("{p}", "{p}.ts", "{p}.tsx", "{p}.js", "{p}/index.ts", "{p}/index.js", "{s}.ts", "{s}.tsx"), entry_points=(r"\.(?:get|post|put|delete)\(", r"\bcreateServer\(")))
register(Provider("python", ("py",), (r"^\s*from\s+(?P<name>[.\w]+)\s+import", r"^\s*import\s+(?P<name>[\w.]+)"), (("class", rf"^\s*class\s+{_NAME}"), ("function", rf"^\s*(?:async\s+)?def\s+{_NAME}")), r"", r"^_", candidates=("{p}.py", "{p}/__init__.py"), entry_points=(r"@\w+\.route", r"__main__")))
register(Provider("go", ("go",), (r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<name>[^\"]+)\"\s*$",), (("class", rf"^type\s+{_NAME}\s+struct"), ("interface", rf"^type\s+{_NAME}\s+interface"), ("type", rf"^type\s+{_NAME}\s"), ("function", rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}"), ("namespace", rf"^package\s+{_NAME}")), r"", r"^[^A-Z]", candidates=("{p}.go", "internal/{b}.go"), entry_points=(r"func main\(",)))
register(Provider("java", ("java",), (r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+)",), (("class", rf"\b(?:class|record)\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("function", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], .?]+\s+{_NAME}\s*\([^;]*$")), r"\bpublic\b", candidates=("src/main/java/{d}.java", "src/{d}.java", "{d}.java"), entry_points=(r"@(?:Get|Post|Request)Mapping", r"static void main")))
register(Provider("rust", ("rs",), (r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:]+)", r"^\s*(?:pub\s+)?mod\s+(?P<name>\w+)\s*;"), (("impl", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?{_NAME}"), ("class", rf"\bstruct\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("interface", rf"\btrait\s+{_NAME}"), ("function", rf"\bfn\s+{_NAME}")), r"^\s*pub\b", candidates=("src/{m}.rs", "src/{m}/mod.rs", "{m}.rs"), entry_points=(r"fn main\(",)))
register(Provider("ruby", ("rb",), (r"^\s*(?:require|require_relative|load)\s+['\"](?P<name>[^'\"]+)",), (("class", rf"^\s*class\s+{_NAME}"), ("namespace", rf"^\s*module\s+{_NAME}"), ("function", rf"^\s*def\s+(?:self\.)?{_NAME}")), r"", r"^_", basenames=("Rakefile", "Gemfile"), candidates=("{p}.rb", "{p}", "lib/{p}.rb")))
register(Provider("csharp", ("cs",), (r"^\s*using\s+(?P<name>[\w.]+)\s*;",), (("class", rf"\b(?:class|struct|record)\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("function", rf"^\s+(?:(?:public|private|protected|internal|static|async|override|virtual)\s+)+[\w<>\[\], ?]+\s+{_NAME}\s*\(")), r"\bpublic\b", candidates=("{d}.cs", "src/{d}.cs")))
register(Provider("kotlin", ("kt", "kts"), (r"^\s*import\s+(?P<name>[\w.]+)",), (("class", rf"\b(?:class|object)\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}"), ("property", rf"^\s*(?:\w+\s+)*va[lr]\s+{_NAME}")), r"^(?!.*\bprivate\b)", candidates=("{d}.kt", "src/main/kotlin/{d}.kt")))
register(Provider("swift", ("swift",), (r"^\s*import\s+(?P<name>\w+)",), (("class", rf"\b(?:class|struct|actor)\s+{_NAME}"), ("interface", rf"\bprotocol\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("function", rf"\bfunc\s+{_NAME}")), r"\b(?:public|open)\b", candidates=("{p}.swift",)))
register(Provider("php", ("php",), (r"^\s*use\s+(?P<name>[\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?['\"](?P<name>[^'\"]+)"), (("class", rf"\bclass\s+{_NAME}"), ("interface", rf"\b(?:interface|trait)\s+{_NAME}"), ("function", rf"\bfunction\s+{_NAME}")), r"^(?!.*\bprivate\b)", candidates=("{p}", "{p}.php", "{p}/index.php", "src/{p}.php")))
register(Provider("cpp", ("c", "cc", "cpp", "h", "hpp"), (r"^\s*#\s*include\s*[<\"](?P<name>[^>\"]+)",), (("class", rf"^\s*(?:class|struct)\s+{_NAME}[^;]*$"), ("enum", rf"\benum\s+(?:class\s+)?{_NAME}"), ("function", rf"^[\w:*&<>, ]+\s+\**{_NAME}\s*\([^;]*$")), r"", candidates=("{p}", "{p}.h", "include/{p}")))


def provider_for(path: str) -> Provider | None:
    base = path.rpartition("/")[2]
    ext = base.rpartition(".")[2].lower() if "." in base else ""
    return next((p for p in _PROVIDERS.values() if ext in p.extensions or base in p.basenames), None)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of a tree's files in supported languages, ignored folders left out; bytes that aren't text are replaced."""
    names = sorted({f"*.{e}" for p in _PROVIDERS.values() for e in p.extensions} | {b for p in _PROVIDERS.values() for b in p.basenames})
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    skip = "(?:^|/)(?:" + "|".join(map(re.escape, IGNORED)) + ")/"
    rel = F.regexp_replace("path", f"^(?:file:)?/*{re.escape(root.strip('/'))}/", "")
    return d.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text")).filter(~F.col("path").rlike(skip))


def parse(files: DataFrame) -> DataFrame:
    """Imports and symbols of (path, text) rows; unknown extensions, null and empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in ROW.split(", ")]
        for d in batches:
            rows = []
            for path, text in zip(d["path"], d["text"]):
                p = provider_for(path) if path and text else None
                rows += p.rows(path, text) if p else []
            yield pd.DataFrame(rows, columns=cols)

    return files.select("path", "text").mapInPandas(run, ROW)


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source, line, target): the first candidate of each import that is a file of the tree.

    Candidates are numbered and met by an equi join; repeated imports are kept apart by line.
    """

    def candidates(path: str, language: str, source: str) -> list[str]:
        p = _PROVIDERS.get(language)
        if not p or not source:
            return []
        folder = path.rpartition("/")[0]
        if language == "python" and source.startswith("."):
            up = len(source) - len(source.lstrip("."))
            base = folder.split("/")[: len(folder.split("/")) - up + 1]
            target = "/".join([*base, *source.lstrip(".").split(".")])
        elif language == "python":
            target = source.replace(".", "/")
        elif source.startswith("."):
            parts: list[str] = []
            for x in f"{folder}/{source}".split("/"):
                if x == "..":
                    parts = parts[:-1]
                elif x not in (".", ""):
                    parts.append(x)
            target = "/".join(parts)
        else:
            target = source
        d, m = source.replace(".", "/").replace("\\", "/"), "/".join(x for x in source.split("::") if x not in ("crate", "self", "super"))
        keys = {"p": target, "s": re.sub(r"\.jsx?$", "", target), "b": source.rpartition("/")[2], "d": d, "m": m}
        return list(dict.fromkeys(c.format(**keys) for c in p.candidates))

    @F.pandas_udf("array<string>")
    def options(path: pd.Series, language: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([candidates(*x) for x in zip(path, language, source)])

    i = imports.filter("what = 'import'").select("path", "language", "source", "line")
    c = i.select("path", "source", "line", F.posexplode(options("path", "language", "source")).alias("place", "target"))
    hit = c.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return hit.groupBy("path", "source", "line").agg(F.min_by("target", "place").alias("target"))
