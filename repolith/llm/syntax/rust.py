"""Rust."""

from __future__ import annotations

import re

from repolith.llm.syntax.engine import ERROR, Grammar, letters

_HARD = "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while"
_SOFT = "union macro_rules auto default"
TOKENS = letters(_HARD + " " + _SOFT)
_OPS = {
    "::": "M", "->": "A", "=>": "F", "..": "r", "..=": "r", "...": "r", "==": "b", "!=": "b", "<=": "b", ">=": "b", "/": "b", "%": "b", "^": "b", "+": "+", "-": "-",
    "+=": "a", "-=": "a", "*=": "a", "/=": "a", "%=": "a", "&=": "a", "|=": "a", "^=": "a", "<<=": "a", ">>=": "a",
}
_PLAIN = set("(){}[];,.:=*&|<>?@!#$~")
LEXER = (
    r"\s*(//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/|/\*|b?r(?P<h>#+)\"[\s\S]*?\"(?P=h)|b?r\"[^\"]*\"|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'|'[A-Za-z_]\w*"
    r"|r#[A-Za-z_]\w*|[A-Za-z_]\w*|[^\W\d]\w*|\d(?:\w|\.(?=\d))*(?:(?<=[eE])[+-]\d+)?|\.\.\.|\.\.=|<<=|>>=|::|->|=>|\.\.|==|!=|<=|>=|[-+*/%&|^]=|\S)"
).replace("(?P<h>#+)", "(#+)").replace("(?P=h)", r"\2")


_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|\d[\d_]*(?:\.\d[\d_]*)*(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f(?:16|32|64|128))?")


def _classify(t: str) -> str:
    c = t[0]
    if t in TOKENS:
        return TOKENS[t]
    if t in ("true", "false"):
        return "L"
    if t == "_":
        return "_"
    if t in _PLAIN:
        return t
    if t in _OPS:
        return _OPS[t]
    if c == "'" and len(t) > 1:
        return "L" if t[-1] == "'" and len(t) > 2 else "l"
    if c.isdigit():
        return "L" if _NUMBER.fullmatch(t) else ERROR
    if c in "bcr" and t[-1] in "\"'#" and len(t) > 2 or c == '"' and len(t) > 1:
        return "L"
    if c.isalpha() or c == "_":
        return "i"
    if t.startswith("//"):
        return ""
    if t.startswith("/*"):
        return "" if len(t) > 3 else ERROR
    return ERROR


_set = lambda w: "".join(TOKENS[x] for x in w.split())
_SETS = {"ID": "i" + _set(_SOFT), "SEG": "i" + _set(_SOFT + " self Self crate super"), "AT": "@", "ANYB": "".join(chr(0xE200 + m) for m in range(256)), "ANYP": "".join(chr(0xE000 + m) for m in range(256)), "ANYA": "".join(chr(0xE100 + m) for m in range(256))}
_RULES = {
    "attrs": r"(?: \# !? @ANYA )*",
    "vis": r"(?: 'pub' @ANYP? )?",
    "garg": r"(?: l | @ID = <type> | @ID : <bounds> | <type> | -?L | @BLOCK )",
    "gargs": r"\< (?: <garg> (?:,<garg>)* ,? )? >",
    "seg": r"@SEG (?: M? <gargs> | @PTYPES (?: A <type>)? )?",
    "path": r"(?: M? <seg> (?: M <seg>)* | \< <type> (?:'as' <type>)? > (?: M <seg>)+ )",
    "eseg": r"@SEG (?: M <gargs>)?",
    "epath": r"(?: M? <eseg> (?: M <eseg>)* | \< <type> (?:'as' <type>)? > (?: M <eseg>)+ )",
    "bound": r"(?: l | \?? (?:'for' <gargs>)? <path> | \(? )",
    "bounds": r"(?: (?: l | \?? (?:'for' <gargs>)? <path> ) (?: \+ (?: l | \?? (?:'for' <gargs>)? <path> ))* )",
    "type": r"(?: & l? 'mut'? <type> | \* (?:'const'|'mut') <type> | @BTYPE | @PTYPES | ! | _ | (?:'dyn'|'impl') <bounds> | (?:'for' <gargs>)? 'unsafe'? (?:'extern' L?)? 'fn' @PTYPES (?: A <type>)? | <path> (?: ! @ANYP)? )",
    "pat1": r"(?: & 'mut'? <pat1> | 'ref'? 'mut'? @ID @AT <pat1> | -?L (?: r (?:-?L)?)? | r -?L | r | _ | <epath> (?: @PPAT | @SPAT | r <epath> )? | (?:'ref'|'mut')+ @ID | @PPAT | @BPAT | @ID ! @ANYP )",
    "pat": r"\|? <pat1> (?: \| <pat1>)*",
    "cparam": r"<pat1> (?: : <type>)?",
    "closure": r"'async'? 'move'? \| (?: <cparam> (?:,<cparam>)* ,? )? \| (?: A <type> @BLOCK | <expr> )",
    "cond": r"(?: 'let' <pat> = )? <expr>",
    "blocky": r"(?: (?:l:)? (?: (?:'unsafe'|'const'|'async' 'move'?)? @BLOCK | 'loop' @BLOCK | 'while' <cond> @BLOCK | 'for' <pat> 'in' <expr> @BLOCK ) | <if> | 'match' <expr> @MATCH )",
    "if": r"'if' <cond> @BLOCK (?: 'else' (?: <if> | @BLOCK ) )?",
    "prim": r"(?: L | <closure> | <blocky> | 'return' <expr>? | 'break' l? <expr>? | 'continue' l? | <epath> (?: ! (?:@ANYP|@ANYA|@ANYB) | @SLIT )? | @ARGS | @BARR | r <unary>? )",
    "postfix": r"<prim> (?: \. (?: @ID (?: M <gargs>)? | L | 'await' ) | @ARGS | @BARR | \? )*",
    "unary": r"(?: & 'mut'? | [*!-] )* <postfix>",
    "binary": r"<unary> (?: (?: b | \+ | - | \* | & | \| | \|\| | && | \<\< | >> | \< | > ) (?:'let' <pat> =)? <unary> | 'as' <type> )*",
    "expr": r"<binary> (?: r <binary>? )? (?: [=a] <expr> )?",
    "generic": r"<attrs> (?: l (?: : <bounds>?)? | 'const' @ID : <type> (?: = (?:-?L|@BLOCK|@ID))? | @ID (?: : <bounds>?)? (?: = <type>)? )",
    "generics": r"\< (?: <generic> (?:,<generic>)* ,? )? >",
    "where": r"'where' (?: (?:'for' <gargs>)? (?: l | <type> ) : <bounds>? ,? )*",
    "fn": r"(?: 'const' | 'async' | 'unsafe' | 'extern' L? | 'default' )* 'fn' @ID <generics>? @PARAMS (?: A <type>)? <where>? (?: @BLOCK | ; )",
    "item": r"<attrs> <vis> (?: <fn>"
    r" | 'struct' @ID <generics>? (?: <where>? @FIELDS | @TFIELDS <where>? ; | ; ) | 'union' @ID <generics>? <where>? @FIELDS"
    r" | 'enum' @ID <generics>? <where>? @VARIANTS"
    r" | 'unsafe'? 'impl' <generics>? (?: !? <type> 'for')? <type> <where>? @IMPL"
    r" | 'unsafe'? 'auto'? 'trait' @ID <generics>? (?: : <bounds>?)? <where>? @IMPL"
    r" | 'mod' @ID (?: ; | @ITEMS ) | 'unsafe'? 'extern' (?: L? @IMPL | 'crate' @SEG (?:'as' (?:@ID|_))? ; ) | 'use' <use> ;"
    r" | 'const' (?:@ID|_) : <type> (?: = <expr>)? ; | 'static' 'mut'? @ID : <type> (?: = <expr>)? ; | 'type' @ID <generics>? (?: : <bounds>?)? <where>? (?: = <type>)? <where>? ;"
    r" | 'macro_rules' ! @ID (?: @ANYB | (?:@ANYP|@ANYA) ; ) | <epath> ! (?: @ANYB ;? | (?:@ANYP|@ANYA) ; ) )",
    "use": r"(?: M? (?: @SEG M )* (?: @SEG (?:'as' (?:@ID|_))? | \* | @USE ) )",
    "stmt": r"(?> ; | <item> | <attrs> 'let' <pat> (?: : <type>)? (?: = <expr> (?:'else' @BLOCK)? )? ; | <attrs> <blocky> (?![.?]) | <attrs> <expr> ; )",
    "param": r"<attrs> (?: & l? 'mut'? 'self' | 'mut'? 'self' (?: : <type>)? | <pat1> : <type> | r )",
    "arm": r"<attrs> <pat> (?:'if' <cond>)? F (?: <blocky> ,? (?![.?]) | <expr> (?: , | \Z ) )",
    "sfield": r"<attrs> (?: (?:@ID|L) : <expr> | @ID | r <expr>? )",
}
_RULES["bound"] = r"l"
_ROLES = {
    "(": [
        ("ARGS", r"(?: <expr> (?:,<expr>)* ,? )?"),
        ("PPAT", r"(?: <pat> (?:,<pat>)* ,? )?"),
        ("PTYPES", r"(?: (?:(?:@ID|_):)? <type> (?:, (?:(?:@ID|_):)? <type>)* ,? | <bounds> )?"),
        ("PARAMS", r"(?: <param> (?:,<param>)* ,? )?"),
        ("TFIELDS", r"(?: <attrs> <vis> <type> (?:, <attrs> <vis> <type>)* ,? )?"),
    ],
    "[": [
        ("BARR", r"(?: <expr> (?: ; <expr> | (?:,<expr>)* ,? ) )?"),
        ("BPAT", r"(?: <pat> (?:,<pat>)* ,? )?"),
        ("BTYPE", r"<type> (?: ; <expr>)?"),
    ],
    "{": [
        ("BLOCK", r"(?: \# ! @ANYA )* (?:<stmt>)*+ (?: <attrs> <expr> )?"),
        ("SLIT", r"(?: <sfield> (?:,<sfield>)* ,? )?"),
        ("SPAT", r"(?: <attrs> (?: (?:@ID|L) : <pat> | 'ref'? 'mut'? @ID | r ) (?:, <attrs> (?: (?:@ID|L) : <pat> | 'ref'? 'mut'? @ID | r ))* ,? )?"),
        ("FIELDS", r"(?: <attrs> <vis> @ID : <type> (?:, <attrs> <vis> @ID : <type>)* ,? )?"),
        ("VARIANTS", r"(?: <attrs> <vis> @ID (?: @TFIELDS | @FIELDS )? (?: = <expr>)? (?:, <attrs> <vis> @ID (?: @TFIELDS | @FIELDS )? (?: = <expr>)?)* ,? )?"),
        ("IMPL", r"(?: \# ! @ANYA )* (?>(?:<item>))*+"),
        ("MATCH", r"(?: \# ! @ANYA )* (?:<arm>)*"),
        ("USE", r"(?: <use> (?:,<use>)* ,? )?"),
    ],
}
# a module's body is what an impl's is to the parser: a run of items
_ITEMS = "".join(chr(0xE200 + m) for m in range(256) if m >> 5 & 1)
RUST = Grammar(LEXER, TOKENS, _SETS | {"ITEMS": _ITEMS}, _ROLES, _RULES, r"(?: \# ! @ANYA )* (?>(?:<item> | ;))*+", _classify, parts={"BLOCK": ("<stmt>", "(?: <stmt> | <attrs> <expr> )"), "IMPL": ("<item>", ""), "TOP": ("(?: <item> | ; )", "")}, glue="".join(TOKENS[w] for w in ("else", "as")) + ".?;")
_lex = RUST.lexer.findall
RUST.shape = lambda text: "".join(map(RUST.classes.__getitem__, [t[0] for t in _lex(text)]))
