"""A parser that works on token classes and collapses brackets from the inside out.

A file is lexed into one character per token. The content of an innermost bracket pair is
matched against the grammar of every role such a pair can have (block, object literal,
parameter list, ...) and replaced by one character that stands for the set of roles it
fits. So each grammar rule sees a flat, short string, and as source code repeats its
shapes, nearly all of them are answered from a table.
"""

from __future__ import annotations

import re

import regex

#: Shapes a worker remembers before it starts afresh.
KEPT = 400_000
ERROR = "\0"
_INNER = re.compile(r"\([^(){}\[\]]*\)|\[[^(){}\[\]]*\]|\{[^(){}\[\]]*\}")
_OPEN = re.compile(r"[(){}\[\]\0]")
_KINDS = {"(": 0xE000, "[": 0xE100, "{": 0xE200}


class _Classes(dict):
    """Token to its class, worked out once a distinct token."""

    def __init__(self, classify):
        self.classify = classify

    def __missing__(self, token: str) -> str:
        c = self.classify(token)
        if len(self) < KEPT and len(token) < 64:
            self[token] = c
        return c


class _Run:
    """Patterns of one part of a run, followed by more or the last one, and what they said."""

    def __init__(self, inner, last):
        self.inner, self.last, self.known = inner, last, {}

    def is_part(self, c: str, final: bool) -> bool:
        key = (c, final)
        ok = self.known.get(key)
        if ok is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            ok = self.known[key] = (self.last.fullmatch(c) if final else self.inner.fullmatch(c + ERROR)) is not None
        return ok


class Grammar:
    """A language given by its lexer, its rules and the roles of its brackets.

    Rules are written with 'token' for a token, <rule> for a rule, @ROLE for a bracket of
    that role or a named set of tokens; blanks don't count.
    """

    def __init__(self, lexer: str, tokens: dict[str, str], sets: dict[str, str], roles: dict[str, list[tuple[str, str]]], rules: dict[str, str], top: str, classify, prepare=None, flat: str = "", parts: dict[str, tuple[str, str]] | None = None, stops: str = ";", glue: str = ""):
        self.lexer, self.prepare, self.flat = re.compile(lexer), prepare, set(flat.split())
        self.classes, self.known, self.tops = _Classes(classify), {}, {}
        self.names = dict(sets)
        for kind, own in roles.items():
            for bit, (name, _) in enumerate(own):
                chars = "".join(chr(_KINDS[kind] + m) for m in range(256) if m >> bit & 1)
                self.names[name] = self.names.get(name, "") + chars
        self.tokens = tokens
        used = "".join(f"(?P<{k}>{self._expand(v)})" for k, v in rules.items())
        comp = lambda p: regex.compile(f"(?(DEFINE){used})(?:{self._expand(p)})", regex.V0)
        self.roles = {kind: [(1 << bit, name in self.flat, comp(p)) for bit, (name, p) in enumerate(own)] for kind, own in roles.items()}
        self.top = comp(top)
        # runs of statements: each is looked up by itself, the whole pattern decides what is left
        self.stop, self.glue = re.compile(f"[{re.escape(stops)}\ue200-\ue2ff]"), set(glue)
        run = lambda name: name in parts and _Run(comp(f"(?:{parts[name][0]})\0"), comp(parts[name][1] or parts[name][0]))
        parts = parts or {}
        self.runs = {(kind, 1 << bit): run(name) for kind, own in roles.items() for bit, (name, _) in enumerate(own) if name in parts}
        self.top_run = run("TOP") or None

    def _expand(self, p: str) -> str:
        p = re.sub(r"@([A-Z]\w*)", lambda m: "[" + re.escape(self.names[m[1]]) + "]", p)
        p = re.sub(r"\s+", "", p)
        p = re.sub(r"'([^']+)'", lambda m: re.escape(self.tokens.get(m[1], m[1])), p)
        return re.sub(r"<(\w+)>", r"(?&\1)", p)

    def _in_parts(self, s: str, run: _Run) -> bool:
        """Is s a row of parts? False says only that looking at parts didn't show it."""
        ends = [m.end() for m in self.stop.finditer(s)]
        if not ends or ends[-1] < len(s):
            ends.append(len(s))
        i, at = 0, 0
        while i < len(s):
            for k in range(at, min(at + 6, len(ends))):
                e = ends[k]
                if e < len(s) and s[e] in self.glue:
                    continue
                if run.is_part(s[i:e], e == len(s)):
                    i, at = e, k + 1
                    break
            else:
                return False
        return True

    def _group(self, m: re.Match) -> str:
        s = m[0]
        c = self.known.get(s)
        if c is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            mask, inner = 0, s[1:-1]
            bare = inner.replace("\n", "")
            for bit, flat, p in self.roles[s[0]]:
                if flat and s[0] == "{" and ";" in inner:
                    continue  # lists in braces part with commas
                run = self.runs.get((s[0], bit))
                if run and self._in_parts(inner, run) or p.fullmatch(bare if flat else inner):
                    mask |= bit
            c = self.known[s] = chr(_KINDS[s[0]] + mask)
        return c

    def shape(self, text: str) -> str:
        return "".join(map(self.classes.__getitem__, self.lexer.findall(text)))

    def parses(self, text: str) -> bool:
        return self.accepts(self.shape(text))

    def accepts(self, s: str) -> bool:
        if ERROR in s:
            return False
        if self.prepare:
            s = self.prepare(s)
        while True:
            t = _INNER.sub(self._group, s)
            if t == s:
                break
            s = t
        if _OPEN.search(s):
            return False
        ok = self.tops.get(s)
        if ok is None:
            if len(self.tops) >= KEPT:
                self.tops.clear()
            ok = self.tops[s] = bool(self.top_run and self._in_parts(s, self.top_run)) or self.top.fullmatch(s) is not None
        return ok


def letters(words: str, first: int = 0x4E00) -> dict[str, str]:
    """A character of its own for each word."""
    return {w: chr(first + i) for i, w in enumerate(words.split())}
