"""Source files that do not parse, and functions with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from repolith.session import cut


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from repolith.llm.syntax import EXTENSIONS, LANGUAGES, parses, ranking

    for d in batches:
        out = []
        for path, text in zip(d["path"], d["file_text"]):
            own = EXTENSIONS.get((path or "").rpartition(".")[2].lower())
            text = text or ""
            ranked = ranking(text)
            shapes: dict = {}
            good = {k: parses(text, k, shapes) for k in ([own] if own else []) + [k for k in ranked if k != own]}
            fits = [k for k in ranked if good[k]]
            if own is None:
                verdict = "unknown"
            elif good[own]:
                verdict = "ok"
            else:
                verdict = "wrong_extension" if fits else "corrupt"
            out.append((own, ranked[0], fits, verdict))
        v = pd.DataFrame(out, columns=["language", "likeliest", "parses_as", "verdict"])
        yield pd.concat([d[["file_id", "repo"]].reset_index(drop=True), v], axis=1)


def verdicts(files: DataFrame) -> DataFrame:
    """Parse every file with all grammars, the likeliest by its tokens first.

    ``files``: file_id, repo, path, file_text. Gives file_id, repo, language (of the
    extension), likeliest (by tokens), parses_as and verdict: ``ok`` if the text is valid
    for its extension, ``wrong_extension`` if only for other languages, ``corrupt`` if for
    none, ``unknown`` for an unsupported extension. A null text counts as empty, which is
    valid. One row per input row.
    """
    kinds = "file_id long, repo string, language string, likeliest string, parses_as array<string>, verdict string"
    return files.select("file_id", "repo", "path", "file_text").mapInPandas(_verdicts, kinds)


def bad_rates(verdict: DataFrame) -> DataFrame:
    """Per repository and language: files, bad ones, their share. A repeated file counts once."""
    one = verdict.groupBy("file_id", "repo", "language").agg(F.max(F.col("verdict").isin("wrong_extension", "corrupt").cast("int")).alias("bad"), F.max((F.col("verdict") == "wrong_extension").cast("int")).alias("foreign"))
    n = one.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("bad").alias("bad_files"), F.sum("foreign").alias("wrong_extension_files"))
    return n.withColumn("bad_share", F.col("bad_files") / F.col("files"))


# --- functions and their documentation


def _valid_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from repolith.llm.syntax import EXTENSIONS, parses

    for d in batches:
        langs = [EXTENSIONS.get((p or "").rpartition(".")[2].lower()) for p in d["path"]]
        keep = [bool(k) and bool(t) and parses(t, k) for k, t in zip(langs, d["file_text"])]
        d = d.assign(language=langs)[keep]
        yield d[["file_id", "language", "file_text"]]


_STR = r"\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_BLOCK = r"/\*[\s\S]*?\*/"
#: Strings that end on their line go with the code around them; a Java text block isn't one.
_DOUBLE, _SINGLE = r"\"(?!\"\")(?:[^\"\\\n]|\\[^\n])*+\"", r"'(?:[^'\\\n]|\\[^\n])*+'"
#: Coarse tokens that together are the whole text. Order matters.
_LEXERS = {
    "script": rf"{_BLOCK}|//[^\n]*|(?:[^\"'`/{{}}]++|{_DOUBLE}|{_SINGLE})++|{_STR}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{(?:[^{{}}`\"']|{_STR}|`[^`]*`|\{{[^{{}}]*\}})*+\}})*+`"
    r"|(?<=[=(,:;!&|?\[{}>]\s{0,4}|return\s{1,4})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*|[{}]|[\s\S]",
    "go": rf"//[^\n]*(?:\n[ \t]*//[^\n]*)*+|{_BLOCK}|(?:[^\"'`/{{}}]++|{_DOUBLE})++|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*+)'|[{{}}]|[\s\S]",
    "java": rf"{_BLOCK}|//[^\n]*|(?:[^\"'/{{}}]++|{_DOUBLE}|{_SINGLE})++|\"\"\"[\s\S]*?\"\"\"|{_STR}|[{{}}]|[\s\S]",
    "rust": rf"///(?!/)[^\n]*(?:\n[ \t]*///(?!/)[^\n]*)*+|//[^\n]*|{_BLOCK}|(?:[^\"'/{{}}r]|\Br|r(?![#\"])|{_DOUBLE})++|\br(#+)\"[\s\S]*?\"\1|\br\"[^\"]*\"|\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\"|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F{{}}_]*+)'|[{{}}]|[\s\S]",
    "python": r"(?<![\w.])(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?:\[[^\]]*\])?[ \t]*\((?:[^()\"'#]|\"[^\"\n]*\"|'[^'\n]*'|#[^\n]*|\((?:[^()]|\([^()]*\))*+\))*+\)(?:[^:\n\"'#\[]|\[[^\]]*\]|\"[^\"\n]*\"|'[^'\n]*')*+:(?:[ \t]*(?:#[^\n]*)?\n)*+[ \t]*(?:[rRuU](?=[\"']))?"
    r"|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
    rf"|{_STR}|#[^\n]*|(?:[^\"'#ad]|(?<=\w)[ad]|[ad](?!(?:sync[ \t]+def|ef)[ \t]))++|[\s\S]",
}
_ANNOTATION = r"@[\w$.]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?\s*"
#: What may stand between the documentation and the declaration; the declaration with its name.
_HEADS = {
    "script": (
        rf"^((?:{_ANNOTATION})*)",
        r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*[<(]",
        r"^(?:export\s+)?const\s+([\w$]+)\s*(?::(?:[^=]|=>)*?)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::(?:[^=]|=(?!>))+?)?|[\w$]+)\s*=>",
        r"^(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set|accessor)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|return|function|new|await|super|typeof|with|import|throw|yield)\b)(#?[\w$]+)\s*\??\s*(?:<[^(]*>)?\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::[\s\S]+)?$",
    ),
    "go": (r"^()", r"^func\s*(?:\([\s\S]*?\)\s*)??(\w+)\s*[\[(]"),
    "java": (
        rf"^((?:{_ANNOTATION})*)",
        r"^(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+|" + _ANNOTATION + r")*(?:<[^(]*?>\s*)?(?!(?:return|new|else|throw|package|import|case|assert|yield)\b)[\w$.]+(?:\s*<[^()]*>)?(?:\s*\[\s*\])*(?:\.\.\.)?\s+([\w$]+)\s*\(",
    ),
    "rust": (r"^((?:#!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]\s*)*)", r"^(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe)\s+|extern\s+(?:\"\"\s+)?)*fn\s+(?:r#)?(\w+)"),
}
_SECTION = r"(?s)(?:^|\n)[ \t]*(?:[@:]|\#{1,6}[ \t]+(?:Arguments?|Args|Parameters?|Params|Returns?|Yields?|Errors?|Raises|Throws|Exceptions?|Panics|Safety)\b|(?:Arguments?|Args|Parameters?|Params|Keyword Args|Returns?|Yields?|Errors?|Raises|Throws|Exceptions?)[ \t]*(?::|\n[ \t]*-{3,})).*$"
#: Words that don't describe, besides the function's own name.
FILLERS = ["the", "a", "an", "of", "for", "to"]


def _lexed(t: Column) -> Column:
    whole = lambda k: F.regexp_extract_all(t, F.lit(_LEXERS[k]), F.lit(0))
    return (
        F.when(F.col("language").isin("typescript", "javascript"), whole("script")).when(F.col("language") == "python", whole("python"))
        .when(F.col("language") == "go", whole("go")).when(F.col("language") == "java", whole("java")).otherwise(whole("rust"))
    )


def _coalesced(*cols: Column) -> Column:
    """The first that isn't the empty string."""
    out = cols[-1]
    for c in reversed(cols[:-1]):
        out = F.when(c != "", c).otherwise(out)
    return out


def documented(files: DataFrame, code: bool = False) -> DataFrame:
    """``functions`` of each file, once however often it is repeated."""
    return functions(files, code).distinct()


def functions(files: DataFrame, code: bool = False) -> DataFrame:
    """Functions and methods of valid files with their documentation comment.

    ``files``: file_id, path, file_text. Gives file_id, language, symbol_name, kind
    (function, method or arrow), line, description (without comment marks, up to the first
    section) and meaningful. Files that don't parse, null and empty texts give no rows; a
    repeated file gives its rows again.

    The text is lexed into coarse tokens (comments, strings, braces, the code between),
    one row each. Running sums give a token's line, its brace and its parenthesis (of Go, bracket too) depth.
    Documentation opens an island that ends at the next brace outside parentheses; its
    tokens make up the declaration's head. A docstring is the string right after a
    ``def`` head, found with lag.

    With ``code`` come end_line and code, the declaration with its body. Braces of one depth
    alternate, so a block ends at the next brace of its depth; blocks that follow one
    another on a line (a type, then the body) are one island. An expression or a declaration without body ends at
    its semicolon or line. In Python a body ends before the next line that isn't deeper
    than its ``def``; lines within strings and brackets don't count.
    """
    valid = files.select("file_id", "path", "file_text").mapInPandas(_valid_texts, "file_id long, language string, file_text string")
    t = valid.withColumn("uid", F.monotonically_increasing_id()).withColumn("file_text", F.regexp_replace("file_text", "\r\n?", "\n")).repartition("uid")
    t = cut(t) if code else t
    w = Window.partitionBy("uid").orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    c, py = F.col("tok"), F.col("language") == "python"
    starts = lambda s: F.startswith(c, F.lit(s))
    lexed = lambda d: d.select("uid", "file_id", "language", F.posexplode(_lexed(F.col("file_text"))).alias("pos", "tok"))
    lines = F.length("tok") - F.length(F.replace("tok", F.lit("\n")))
    line = F.lit(1) + F.coalesce(F.sum("nl").over(before), F.lit(0))
    is_string = (starts('"') | starts("'") | starts("`")) & (F.length("tok") > 1)
    script, go, rust = F.col("language").isin("typescript", "javascript", "java"), F.col("language") == "go", F.col("language") == "rust"
    # documentation above: the tokens of the island that begins with it, up to and with the closing brace
    is_doc = (script & starts("/**") & (F.length("tok") > 4)) | (go & starts("//")) | (rust & starts("///") & ~starts("////"))
    is_comment = starts("//") | starts("/*")
    # a token of its own is only a string that holds a line end, a template or a raw string
    longer = F.length("tok") > 1
    quoted = F.when(py, is_string).when(starts("`"), longer).when(starts('"'), longer & ~c.rlike("^" + _DOUBLE)).when(starts("'"), longer & (go | rust | ~c.rlike("^" + _SINGLE))).otherwise(rust & c.rlike(r'^r#*"'))
    # what stands in the strings of a line doesn't count
    plain = F.when(py | (F.instr("tok", '"') == 0) & (F.instr("tok", "'") == 0), c).when(go | rust, F.regexp_replace("tok", _DOUBLE, '""')).otherwise(F.regexp_replace("tok", f"{_DOUBLE}|{_SINGLE}", '""'))
    brace = (c == "{") | (c == "}")
    tok = lexed(t).withColumns({"is_doc": ~py & is_doc, "class": F.when(is_comment, "c").when(quoted, "s").when(brace, "b").otherwise("w"), "size": F.length("tok"), "nl": lines})
    # what travels of a comment is a mark, of a string its lines
    marks = F.when(F.col("class") == "c", "\x01").when(F.col("class") == "s", F.concat(F.lit('"'), F.repeat(F.lit("\n"), F.col("nl")), F.lit('"'))).when(F.col("class") == "w", plain).otherwise(c)
    tok = tok.withColumn("tok", F.when(py | F.col("is_doc"), c).otherwise(marks))
    paren = F.length(F.replace("tok", F.lit(")"))) - F.length(F.replace("tok", F.lit("(")))
    # of Go, brackets too: a constraint may hold braces
    square = F.length(F.replace("tok", F.lit("]"))) - F.length(F.replace("tok", F.lit("[")))
    paren = F.when((F.col("class") == "w") & ~py, paren + F.when(go, square).otherwise(0)).otherwise(0)
    tok = tok.withColumns({
        "line": line, "parens": F.sum(paren).over(upto), "depth": F.coalesce(F.sum(F.when(c == "{", 1).when(c == "}", -1)).over(before), F.lit(0)),
        "head": F.when(py, F.lag("tok").over(w)), "then": F.when(py, F.lead("tok").over(w)),
    })
    tok = tok.withColumn("doc", F.last(F.when(F.col("is_doc"), F.struct("pos", "parens")), ignorenulls=True).over(upto))
    closing = (F.col("class") == "b") & (F.col("parens") == F.col("doc.parens"))
    if code:
        tok = _block_ends(tok, w)
    tok = tok.withColumn("closed", F.coalesce(F.max(F.when(closing, F.col("pos"))).over(before), F.lit(-1)))
    # documentation inside: a string right after a def head that nothing is done with
    is_def = F.col("head").rlike(r"^(?:async[ \t]+)?def[ \t]")
    ends = F.col("then").isNull() | F.col("then").rlike(r"^[ \t]*(?:\n|;|#|$)")
    isle = tok.filter(F.when(py, is_string & is_def & ends).otherwise(F.col("doc").isNotNull() & (F.col("closed") < F.col("doc.pos"))))
    is_text = F.col("is_doc") | py
    parts = F.array_sort(F.collect_list(F.when(~is_text, F.struct("pos", c.alias("x")))))
    isle = isle.groupBy("uid", "file_id", "language", F.when(py, F.col("pos")).otherwise(F.col("doc.pos")).alias("at")).agg(
        F.max("head").alias("head"), F.max(F.when(py, F.col("line"))).alias("doc_line"), F.max(F.when(is_text, c)).alias("raw"), F.max(F.when(is_text, F.col("line") + F.col("nl"))).alias("doc_end"), F.max(F.when(is_text, F.col("depth"))).alias("depth"), *([F.max_by("end", "pos").alias("end"), F.max_by("end_at", "pos").alias("end_at"), F.max(F.when(is_text, F.col("off") + F.col("size"))).alias("doc_off")] if code else []), F.array_join(F.transform(parts, lambda p: p["x"]), "").alias("rest")
    )
    isle = isle.filter(py | F.col("rest").rlike(r"^[ \t]*\n[ \t]*[^\s\x01]") | (script & F.col("rest").rlike(r"^[ \t]*[^\s\x01]")))
    isle = isle.withColumns({"body": F.regexp_replace(F.regexp_replace("rest", r"^\s+", ""), r"[{}]$", ""), "brace": F.substring("rest", -1, 1)})
    by = lambda k, i: F.regexp_extract(F.col("decl") if i else F.col("body"), _HEADS[k][i], 1)
    per = lambda f: F.when(F.col("language").isin("typescript", "javascript"), f("script")).when(go, f("go")).when(F.col("language") == "java", f("java")).otherwise(f("rust"))
    isle = isle.withColumn("skip", per(lambda k: by(k, 0))).withColumn("decl", F.substring(F.col("body"), F.length("skip") + 1, F.length("body")))
    method = F.when((F.col("depth") > 0) & (F.col("brace") == "{"), F.regexp_extract("decl", _HEADS["script"][3], 1)).otherwise("")
    func, arrow = by("script", 1), by("script", 2)
    js = F.col("language").isin("typescript", "javascript")
    name = F.when(js, _coalesced(func, arrow, method)).when(go, by("go", 1)).when(F.col("language") == "java", by("java", 1)).otherwise(by("rust", 1))
    lead_lines = F.length(F.regexp_extract("rest", r"^\s+", 0)) - F.length(F.replace(F.regexp_extract("rest", r"^\s+", 0), F.lit("\n")))
    skipped = F.length("skip") - F.length(F.replace("skip", F.lit("\n")))
    kind = F.when(js, F.when(func != "", "function").when(arrow != "", "arrow").otherwise("method")).when(go, F.when(F.col("decl").rlike(r"^func\s*\("), "method").otherwise("function")).when(F.col("language") == "java", "method").otherwise(F.when(F.col("depth") > 0, "method").otherwise("function"))
    text_of = F.when(go, F.regexp_replace("raw", r"(?m)^[ \t]*// ?", "")).when(rust, F.regexp_replace("raw", r"(?m)^[ \t]*/// ?", "")).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"^/\*\*+|\*+/$", ""), r"(?m)^[ \t]*\*+(?!/) ?", ""), r"^[ \t]+", ""))
    quotes = r"^(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')$"
    head_lines = F.length("head") - F.length(F.replace("head", F.lit("\n")))
    parts_of = {"block_end": F.when(~py & (F.col("brace") == "{"), F.col("end")), "block_line": F.col("end_at"), "loose": F.when(~py, _until_end(F.col("decl"), js & (arrow != ""))), "doc_off": F.when(~py, F.col("doc_off"))} if code else {}
    out = isle.select(
        "file_id", "language", F.when(py, F.regexp_extract("head", r"def[ \t]+(\w+)", 1)).otherwise(name).alias("symbol_name"),
        F.when(py, F.when(F.col("head").rlike(r"\(\s*(?:self|cls)\b"), "method").otherwise("function")).otherwise(kind).alias("kind"),
        F.when(py, F.col("doc_line") - head_lines).otherwise(F.col("doc_end") + lead_lines + skipped).cast("long").alias("line"),
        F.when(py, F.regexp_replace("raw", quotes, "")).otherwise(text_of).alias("text"), *(["uid"] if code else []), *[c.alias(k) for k, c in parts_of.items()],
    ).filter("symbol_name <> ''")
    out = out.withColumn("description", F.trim(F.regexp_replace(F.regexp_replace("text", _SECTION, ""), r"\s+", " "))).drop("text")
    out = out.withColumn("meaningful", meaningful(F.col("description"), F.col("symbol_name")))
    return _sliced(out, t, tok) if code else out


def _block_ends(tok: DataFrame, w: WindowSpec) -> DataFrame:
    """Add off (characters before the token) and, to opening braces, end and end_at: characters up to and line of the end of their block."""
    c, brace = F.col("tok"), F.col("class") == "b"
    level = F.when(brace, F.col("depth") - F.when(c == "}", 1).otherwise(0)).otherwise(-1)
    # on one line with the block before it, as a body is with a return type in braces
    joined = (F.lag("tok").over(w) == "}") | (F.lag("tok").over(w).rlike(r"^[ \t\[\]>]*$") & (F.lag("tok", 2).over(w) == "}"))
    tok = tok.withColumns({"off": F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "level": level, "fresh": F.when(brace & (c == "{") & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0)})
    at = Window.partitionBy("uid", "level").orderBy("pos")
    tok = tok.withColumn("run", F.sum("fresh").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("uid", "level", "run")
    closes = F.when(brace & (c == "}"), F.struct("pos", (F.col("off") + 1).alias("off"), "line"))
    return tok.withColumn("last", F.max(closes).over(whole)).withColumns({"end": F.when(brace, F.col("last.off")), "end_at": F.when(brace, F.col("last.line"))}).drop("last", "run", "fresh", "level")


def _until_end(decl: Column, arrow: Column) -> Column:
    """What of a head belongs to a declaration without a block of its own; null if a block follows."""
    plain = F.regexp_replace(decl, r"\[[^\[\]]*\]", "[]")
    # the expression of an arrow ends at a semicolon or where a line doesn't go on
    short = F.regexp_extract(decl, r"^[\s\S]*?=>\s*[^\s;][\s\S]*?(?=;|\n(?!\s*[.?:+*/%&|,)\]-])|$)", 0)
    return F.when(arrow & ~decl.rlike(r"=>\s*\(?\s*$"), short).when(~arrow & plain.rlike(";"), F.regexp_extract(decl, r"^[^;\[]*(?:\[[^\[\]]*\][^;\[]*)*;", 0))


def _sliced(found: DataFrame, t: DataFrame, tok: DataFrame) -> DataFrame:
    """Give declarations their end_line and code."""
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n")))
    loose_line = F.col("line") + newlines(F.coalesce("loose", F.lit("")))
    end_line = F.when(F.col("loose").isNotNull(), loose_line).otherwise(F.coalesce("block_line", F.col("line")))
    braces = found.filter("language <> 'python'").withColumn("end_line", end_line).withColumn("end", F.when(F.col("loose").isNull(), F.col("block_end")))
    defs = found.filter("language = 'python'")
    # python: every line closes the levels of def that aren't shallower than it
    masked = F.when(F.col("class") == "s", F.concat(F.lit("x"), F.repeat(F.lit("\n\x01"), newlines(F.col("tok"))))).when(F.startswith("tok", F.lit("#")), F.lit("")).otherwise(F.regexp_replace("tok", r"\"[^\"\n]*\"|'[^'\n]*'|#[^\n]*", ""))
    py = tok.filter("language = 'python'").groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", masked.alias("x")))), lambda p: p["x"]), "").alias("text"))
    lines = py.select("uid", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumns({"line": (F.col("n") + 1).cast("long"), "indent": F.length(F.regexp_extract("text", r"^[ \t]*", 0))})
    opened = F.length(F.regexp_replace("text", r"[^(\[{]", "")) - F.length(F.regexp_replace("text", r"[^)\]}]", ""))
    inside = F.coalesce(F.sum(opened).over(Window.partitionBy("uid").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    lines = lines.withColumn("inside", inside).filter(F.col("text").rlike(r"[^\s]"))
    starts = defs.select("uid", "line").distinct().join(lines.select("uid", "line", "indent"), ["uid", "line"])
    levels = starts.groupBy("uid").agg(F.collect_set("indent").alias("levels"))
    # the line after a def's header may be inside of brackets; the last line that holds anything ends the body
    solid = lines.join(levels, "uid").withColumn("closes", F.when(F.col("inside") | F.startswith("text", F.lit("\x01")), F.array().cast("array<int>")).otherwise(F.filter("levels", lambda k: k >= F.col("indent"))))
    solid = solid.withColumn("before", F.lag("line").over(Window.partitionBy("uid").orderBy("line")))
    last = lines.groupBy("uid").agg(F.max("line").alias("last"))
    events = solid.select("uid", "line", "before", F.explode("closes").alias("level"))
    events = events.withColumn("next_before", F.lead("before").over(Window.partitionBy("uid", "level").orderBy("line")))
    ends = starts.withColumnRenamed("indent", "level").join(events, ["uid", "line", "level"], "left").join(last, "uid")
    defs = defs.join(ends.select("uid", "line", F.coalesce("next_before", "last").alias("end_line")), ["uid", "line"]).withColumn("end", F.lit(None).cast("long"))
    d = braces.unionByName(defs).join(t.select("uid", "file_text"), "uid")
    d = d.withColumn("begin", F.greatest(F.expr("case when line > 1 then length(substring_index(file_text, '\n', int(line - 1))) + 1 else 0 end"), F.coalesce("doc_off", F.lit(0))))
    d = d.withColumn("end", F.coalesce("end", F.expr("length(substring_index(file_text, '\n', int(end_line)))")))
    code = F.regexp_replace(F.substring("file_text", F.col("begin") + 1, F.col("end") - F.col("begin")), r"^[ \t]*\n?[ \t]*|\s+$", "")
    return d.select("file_id", "language", "symbol_name", "kind", "line", F.col("end_line").cast("long").alias("end_line"), "description", "meaningful", code.alias("code"))


def meaningful(text: Column, name: Column) -> Column:
    """At least four words, no TODO, FIXME, XXX or TBD at the start, more than the name and fillers."""
    counted = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]\S*"))
    parts = F.split(F.lower(F.regexp_replace(name, r"([\p{Ll}\d])(\p{Lu})|(\p{Lu})(\p{Lu}\p{Ll})|_", "$1$3 $2$4")), r"\s+")
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    own = F.concat(F.array(*map(F.lit, FILLERS)), F.array(F.lower(name)), parts)
    return (counted >= 4) & ~text.rlike(r"^(?i:TODO|FIXME|XXX|TBD)\b") & (F.size(F.array_except(words, own)) > 0)
