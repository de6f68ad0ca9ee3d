"""The supported languages, their ranking by tokens, and the verdict on a text."""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from collections import Counter

from repolith.llm.syntax import golang, java, rust, script
from repolith.llm.syntax.golang import GO
from repolith.llm.syntax.java import JAVA
from repolith.llm.syntax.rust import RUST
from repolith.llm.syntax.script import JAVASCRIPT, TYPESCRIPT

LANGUAGES = ["typescript", "javascript", "python", "go", "java", "rust"]
EXTENSIONS = {"ts": "typescript", "js": "javascript", "py": "python", "go": "go", "java": "java", "rs": "rust"}
_GRAMMARS = {"typescript": TYPESCRIPT, "javascript": JAVASCRIPT, "go": GO, "java": JAVA, "rust": RUST}

#: Comments and literals, which say nothing of the language, and the tokens that may.
_TOKENS = re.compile(r"//[^\n]*|\#(?![\[!])[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|([^\W\d]\w*|:=|::|->|=>|===|!==)")
_OPERATORS = {":=": ["go", "python"], "::": ["rust", "java"], "->": ["rust", "java", "python"], "=>": ["typescript", "javascript", "rust"], "===": ["typescript", "javascript"], "!==": ["typescript", "javascript"]}


def _weights() -> dict[str, dict[str, float]]:
    """Token to the languages that reserve it; one that few do says more."""
    typed = {"interface", "implements", "declare", "abstract", "public", "private", "protected", "readonly", "namespace", "module", "satisfies", "is", "keyof", "infer", "asserts", "unique", "override", "type", "enum"}
    words = {"typescript": set(script.TOKENS), "javascript": set(script.TOKENS) - typed, "python": {*keyword.kwlist}, "go": set(golang.TOKENS), "java": set(java.TOKENS), "rust": set(rust.TOKENS)}
    out: dict[str, dict[str, float]] = {}
    for t in {t for w in words.values() for t in w} | set(_OPERATORS):
        own = _OPERATORS.get(t) or [k for k in LANGUAGES if t in words[k]]
        out[t] = {k: 1 / len(own) for k in own}
    return out


_WEIGHTS = _weights()


def ranking(text: str) -> list[str]:
    """The languages, the likeliest first, by their reserved words and operators outside of comments and literals.

    A token that n languages reserve counts 1 / n for each; ties in the order of LANGUAGES.
    """
    score = dict.fromkeys(LANGUAGES, 0.0)
    for t, n in Counter(_TOKENS.findall(text)).items():
        for k, w in _WEIGHTS.get(t, {}).items():
            score[k] += w * n
    return sorted(LANGUAGES, key=lambda k: -score[k])


def _python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False


#: How a text that isn't empty can begin, comments aside; what begins otherwise fails at its first token.
_LINES = r"(?:\s++|//[^\n]*+|/\*[\s\S]*?\*/)*+"
_FLAT = r"(?:\s++|//[^\n]*+|/\*(?:[^/*]|\*(?!/)|/(?!\*))*+\*/)*+"
_NAME = r"[^\W\d][\w$]*"
_NAMES = rf"{_NAME}(?:{_LINES}\.{_LINES}(?:{_NAME}|\*))*"
#: A type and a name, as a method or a field begins that no class encloses.
_LOOSE = rf"(?!(?:const|import|package|return|throw|if|for|while|do|else|new|case|goto)\b){_NAMES}{_LINES}(?:<[^;{{}}()]*>)?(?:{_LINES}\[{_LINES}\])*{_LINES}{_NAME}{_LINES}[(=;,\[]"
_BEGIN = {
    "go": re.compile(_LINES + rf"package(?=[\s/]){_LINES}{_NAME}[ \t]*(?:;|\n|//|/\*|\Z)"),
    "java": re.compile(_LINES + rf"(?:\Z|;|@|<|(?:package|import(?:\s+(?:static|module))?){_LINES}{_NAMES}{_LINES};|(?:public|private|protected|static|final|abstract|strictfp|sealed|non|class|interface|enum|record|module|open|synchronized|native|transient|volatile|default)\b|{_LOOSE})"),
    # a comment with another one inside is left to the lexer, and so is all that may be an item
    "rust": re.compile(_FLAT + r"(?:\Z|/\*|;|\#|::|(?:use|extern|impl)\b|(?:pub|fn|struct|enum|union|trait|mod|const|static|type|unsafe|async|auto)\b(?!\s*[=.{:])|\w+(?:\s*::\s*\w+)*\s*!)"),
}
#: Two plain names in a row can't begin a script, unless the first is a word of the language.
_TWO = re.compile(_LINES + r"(?!(?:as|async|await|case|class|const|declare|default|delete|do|else|enum|export|extends|function|get|if|import|in|instanceof|interface|abstract|let|module|namespace|new|of|return|set|static|throw|type|typeof|using|var|void|while|with|yield)\b)[A-Za-z_$][\w$]*[ \t]+(?!(?:as|in|instanceof|of|satisfies)\b)[A-Za-z_$]")

_NOT_PYTHON = re.compile(r"(?:\s++|#[^\n]*+)*+(?:/|import\s*[{*\"']|(?:package|use|pub|fn|func|mod|export|const|let|var|function|interface|public|private|protected|struct|enum|impl)[ \t]+(?!(?:if|in|is|and|or|not)\b)\w)")
_ONLY_COMMENTS = re.compile(_LINES)
_BOM, _SHEBANG = "﻿", re.compile(r"\A#!(?!\[).*")


def parses(text: str, language: str, shapes: dict | None = None) -> bool:
    """Is the text valid syntax? An empty one is, and one that holds only comments.

    ``shapes`` keeps the token classes of a text between calls for the same text, so
    that JavaScript and TypeScript share their lexing.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = text[1:] if text.startswith(_BOM) else text
    if language == "python":
        return not _NOT_PYTHON.match(text) and _python(text)
    g = _GRAMMARS[language]
    if language in ("javascript", "typescript"):
        text = _SHEBANG.sub("", text)
        if _TWO.match(text):
            return False
        shapes = {} if shapes is None else shapes
        if "script" not in shapes:
            shapes["script"] = g.shape(text)
        return g.accepts(shapes["script"])
    if not _BEGIN[language].match(text):
        return not text.strip() or _ONLY_COMMENTS.fullmatch(text) is not None
    return g.parses(text)
