"""Go."""

from __future__ import annotations

import re

from repolith.llm.syntax.engine import ERROR, Grammar, letters

TOKENS = letters("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
_OPS = {
    ":=": "D", "<-": "R", "...": "E", "++": "P", "--": "P", "==": "b", "!=": "b", "<=": "b", ">=": "b", "&&": "b", "||": "b", "<<": "b", ">>": "b", "&^": "b", "/": "b", "%": "b", "<": "b", ">": "b",
    "+": "p", "-": "p", "^": "p", "!": "u", "+=": "a", "-=": "a", "*=": "a", "/=": "a", "%=": "a", "&=": "a", "|=": "a", "^=": "a", "<<=": "a", ">>=": "a", "&^=": "a",
}
_PLAIN = set("(){}[];,.:=*&|~\n")
LEXER = (
    r"[ \t]*([A-Za-z_]\w*|[^\W\d]\w*|\n|//[^\n]*|/\*[\s\S]*?\*/|/\*|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[xuU0-7][0-9a-fA-F]*|.))'"
    r"|\d(?:[eEpP][+-]\d|[\w.])*|\.\d\w*|&\^=|<<=|>>=|\.\.\.|:=|<-|\+\+|--|==|!=|<=|>=|&&|\|\||<<|>>|&\^|[-+*/%&|^]=|\S)"
)


def _classify(t: str) -> str:
    c = t[0]
    if t in TOKENS:
        return TOKENS[t]
    if t in _PLAIN:
        return t
    if t in _OPS:
        return _OPS[t]
    if c.isalpha() or c == "_":
        return "i"
    if c.isdigit() or len(t) > 1 and c in "'.":
        return "L"
    if len(t) > 1 and c in '"`':
        return "S"
    if t.startswith("//"):
        return ""
    if t.startswith("/*"):
        return ("\n" if "\n" in t else "") if len(t) > 3 else ERROR
    return ERROR


_ENDS = "iLSP)]}" + "".join(TOKENS[w] for w in ("break", "continue", "fallthrough", "return"))
_SEMI, _REST = re.compile(f"(?<=[{re.escape(_ENDS)}])\n\n*"), re.compile("\n+")


def _prepare(s: str) -> str:
    return _REST.sub("", _SEMI.sub(";", s))


_RULES = {
    "lit": r"[LS]",
    "name": r"i (?:\.i)? @TARGS?",
    "type": r"(?: \* <type> | @EMPTYB <type> | @LENB <type> | 'map' @TARGS <type> | 'chan' R? <type> | R 'chan' <type> | 'func' @PARAMS <result>? | 'struct' @STRUCT | 'interface' @IFACE | <name> | @PTYPE )",
    "result": r"(?:@PARAMS | <type>)",
    "littype": r"(?: @EMPTYB <type> | @LENB <type> | 'map' @TARGS <type> | 'struct' @STRUCT | <name> )",
    "prim": r"(?: <lit> | 'func' @PARAMS <result>? @BLOCK | <littype> @LIT | (?:@EMPTYB|'map'|'chan'|'struct'|'interface'|'func') (?<=.) (?!) | (?=[@]) (?!) | @EMPTYB <type> @ARGS | (?='map'|'chan'|'interface') <type> (?:@ARGS|@LIT)? | i | @PEXPR | @PTYPE (?=@ANYP) )",
    "postfix": r"<prim> (?: \.i | \.@TASSERT | @INDEX | @TARGS | @ARGS )*",
    "unary": r"(?:[pu*&R])* <postfix>",
    "expr": r"<unary> (?:[bp*&|] <unary>)*",
    "exprs": r"<expr> (?:,<expr>)*",
    "ids": r"i (?:,i)*",
    "simple": r"(?: <exprs> (?: [D=a] (?:<exprs>) | P | R <expr> )? )",
    "range": r"(?: (?:<exprs> [D=])? 'range' <expr> )",
    "if": r"'if' (?:<simple>? ;)? <expr> @BLOCK (?:'else' (?:<if> | @BLOCK))?",
    "vspec": r"<ids> (?: <type> (?:=<exprs>)? | =<exprs>)",
    "cspec": r"<ids> (?:<type>? =<exprs>)?",
    "tspec": r"i @TPARAMS? =? <type>",
    "decl": r"(?: 'var' (?:<vspec>|@VARS) | 'const' (?:<cspec>|@CONSTS) | 'type' (?:<tspec>|@TYPES) )",
    "stmt": r"(?: 'return' <exprs>? | <if>"
    r" | 'for' (?: @BLOCK | <range> @BLOCK | <simple>? ; <expr>? ; <simple>? @BLOCK | <expr> @BLOCK )"
    r" | 'switch' (?:<simple>? ;)? (?: (?:iD)? <expr> )? @SWITCH | 'select' @SWITCH | (?:'go'|'defer') <expr>"
    r" | (?:'break'|'continue') i? | 'goto' i | 'fallthrough' | i : <stmt>? | <decl> | @BLOCK | <simple> )",
    "stmts": r"(?: (?>(?:<stmt>)?+ ;) )*+ (?:<stmt>)?+",
    "ispec": r"(?:i|\.)? S",
    "item": r"(?: <decl> | 'func' @PARAMS? i @TPARAMS? @PARAMS <result>? @BLOCK? )",
    "param": r"(?: i E? <type> | E? <type> )",
    "elem": r"(?: (?:(?:<expr>|@LIT) :)? (?:<expr> | @LIT) )",
    "field": r"(?: <ids> <type> S? | \*? <name> S? )",
    "term": r"(?: ~? <type> (?:\| ~? <type>)* )",
}
_RULES["prim"] = r"(?: <lit> | 'func' @PARAMS <result>? @BLOCK | <littype> @LIT | @EMPTYB <type> @ARGS | (?='map'|'chan'|'interface') <type> | i | @PEXPR | @PTYPE | @EMPTYB <type> | \* <type> )"
_ROLES = {
    "(": [
        ("PEXPR", r"<expr>"),
        ("ARGS", r"(?: (?:<expr>|<type>) (?:, <expr>)* E? ,? )?"),
        ("PARAMS", r"(?: <param> (?:, <param>)* ,? )?"),
        ("PTYPE", r"<type>"),
        ("TASSERT", r"(?: 'type' | <type> )"),
        ("VARS", r"(?:<vspec>;)* <vspec>?"),
        ("CONSTS", r"(?:<cspec>;)* <cspec>?"),
        ("TYPES", r"(?: (?:<tspec>;)* <tspec>? | (?:<ispec>;)* <ispec>? )"),
    ],
    "[": [
        ("EMPTYB", r""),
        ("LENB", r"(?: <expr> | E )"),
        ("INDEX", r"(?: <expr> | <expr>? : <expr>? (?: : <expr>)? )"),
        ("TARGS", r"<type> (?:,<type>)*"),
        ("TPARAMS", r"<ids> <term> (?:, <ids> <term>)* ,?"),
    ],
    "{": [
        ("BLOCK", r"<stmts>"),
        ("LIT", r"(?: <elem> (?:, <elem>)* ,? )?"),
        ("SWITCH", r"(?: (?: 'case' (?: <simple> | (?:<expr>|<type>) (?:, (?:<expr>|<type>))* ) | 'default' ) : <stmts> )*"),
        ("STRUCT", r"(?: <field> (?:; <field>)* ;? )?"),
        ("IFACE", r"(?: (?: i @PARAMS <result>? | <term> ) (?:; (?: i @PARAMS <result>? | <term> ))* ;? )?"),
    ],
}
GO = Grammar(LEXER, TOKENS, {}, _ROLES, _RULES, r";* 'package' i (?: ;+ 'import' (?:<ispec>|@TYPES) )* (?: ;+ (?:<item>)?+ )*+", _classify, _prepare, parts={"BLOCK": ("(?:<stmt>)?+ ;", "(?:<stmt>)?+ ;?")})
