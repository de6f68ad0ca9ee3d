"""Macros that let one statement run on Spark and on the oracle.

~match(x, 'p')  does x contain a match       ~sub(x, 'p', 'r')  replace all matches
~count(x, 'p')  number of matches            ~get(x, 'p')       first group of the first match
~r0 ~r1 ~r2 ~r4 (x)  rounding half up        ~div(a, b)         a / b, 0 where b is 0 or null
~day(x) ~hour(x)     whole days, hours       ~clamp(x)          into 0..100
~all(x, 'p')    first groups of all matches  ~each(list)        one row an entry
~held(x)        last x that isn't null, of the window that follows
~split(x, 'p')  parts between matches        ~len(list)         ~sha(x)  sha256 in hex
~names(x)       values of a group in order, by commas       ~seq(a, b)   whole numbers from a to b
~chr(n)              the character of that number
NOW                  the reports' present: 2025-12-01T00:00Z
"""

from __future__ import annotations

NOW = 1_764_547_200_000_000


def _args(s: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose parenthesis opens at ``at``, and where it ends."""
    depth, quoted, start, out = 0, False, at + 1, []
    for i in range(at, len(s)):
        c = s[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*out, s[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(s[start:i].strip())
            start = i + 1
    raise ValueError(f"unclosed call in {s[at : at + 40]}")


def _rounded(digits: int):
    f = float(10**digits)
    return lambda x: f"(cast(floor(({x})*{f}e0+0.5e0) as double)/{f}e0)"


_BOTH = {
    "r0": lambda x: f"cast(floor(({x})+0.5e0) as bigint)", "r1": _rounded(1), "r2": _rounded(2), "r4": _rounded(4), "div": lambda a, b: f"coalesce(({a})*1e0/nullif({b},0),0e0)",
    "day": lambda x: f"cast(floor(({x})/8.64e10) as bigint)", "hour": lambda x: f"cast(floor(({x})/3.6e9) as bigint)", "clamp": lambda x: f"greatest(0e0,least(100e0,{x}))",
}
_SPARK = {
    "all": lambda x, p: f"regexp_extract_all({x}, r{p}, 1)", "each": lambda x: f"explode({x})", "held": lambda x: f"last_value({x}) ignore nulls", "split": lambda x, p: f"split({x}, r{p})", "len": lambda x: f"cast(size({x}) as bigint)", "sha": lambda x: f"sha2({x}, 256)", "seq": lambda a, b: f"sequence({a}, {b})", "names": lambda x: f"array_join(array_sort(collect_list({x})), ',')",
    "chr": lambda x: f"char({x})", "match": lambda x, p: f"regexp_like({x}, r{p})", "sub": lambda x, p, r: f"regexp_replace({x}, r{p}, {r})", "count": lambda x, p: f"cast(regexp_count({x}, r{p}) as bigint)", "get": lambda x, p: f"regexp_extract({x}, r{p}, 1)"
}
_DUCK = {
    "all": lambda x, p: f"regexp_extract_all({x}, {p}, 1)", "each": lambda x: f"unnest({x})", "held": lambda x: f"last_value({x} ignore nulls)", "split": lambda x, p: f"regexp_split_to_array({x}, {p})", "len": lambda x: f"len({x})", "sha": lambda x: f"sha256({x})", "seq": lambda a, b: f"generate_series(cast({a} as bigint), cast({b} as bigint))", "names": lambda x: f"string_agg({x}, ',' order by {x})",
    "chr": lambda x: f"chr({x})", "match": lambda x, p: f"regexp_matches({x}, {p})", "sub": lambda x, p, r: f"regexp_replace({x}, {p}, {r}, 'g')", "count": lambda x, p: f"len(regexp_extract_all({x}, {p}))", "get": lambda x, p: f"regexp_extract({x}, {p}, 1)"
}


def _expand(s: str, macros: dict) -> str:
    out, i = "", 0
    while (j := s.find("~", i)) >= 0:
        k = s.index("(", j)
        args, end = _args(s, k)
        out += s[i:j] + macros[s[j + 1 : k]](*[_expand(a, macros) for a in args])
        i = end
    return (out + s[i:]).replace("NOW", str(NOW))


def spark_sql(s: str) -> str:
    return _expand(s, _BOTH | _SPARK)


def duck_sql(s: str) -> str:
    return _expand(s, _BOTH | _DUCK)
