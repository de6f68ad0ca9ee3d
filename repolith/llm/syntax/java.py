"""Java."""

from __future__ import annotations

import re

from repolith.llm.syntax.engine import ERROR, Grammar, letters

_HARD = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while"
_SOFT = "record sealed permits yield non module open requires exports opens uses provides to with transitive"
TOKENS = letters(_HARD + " " + _SOFT)
_OPS = {
    "->": "A", "::": "M", "...": "E", "++": "P", "--": "P", "==": "b", "!=": "b", "<=": "b", "&&": "b", "||": "b", "<<": "b", "/": "b", "%": "b", "^": "b", "+": "p", "-": "p", "!": "u", "~": "u",
    "+=": "a", "-=": "a", "*=": "a", "/=": "a", "%=": "a", "&=": "a", "|=": "a", "^=": "a", "<<=": "a",
}
_PLAIN = set("(){}[];,.:=*&|<>?@")
LEXER = (
    r"\s*([A-Za-z_$][\w$]*|[^\W\d][\w$]*|//[^\n]*|/\*[\s\S]*?\*/|/\*|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'"
    r"|\d(?:[eEpP][+-]\d|[\w.])*|\.\d\w*|<<=|\.\.\.|->|::|\+\+|--|==|!=|<=|&&|\|\||<<|[-+*/%&|^]=|\S)"
)


#: A whole number that begins with 0 has octal digits only.
_OCTAL = re.compile(r"0[\d_]*[89][\d_]*[lL]?")


def _classify(t: str) -> str:
    c = t[0]
    if t in TOKENS:
        return TOKENS[t]
    if t in ("null", "true", "false"):
        return "L"
    if t in _PLAIN:
        return t
    if t in _OPS:
        return _OPS[t]
    if c.isalpha() or c in "_$":
        return "i"
    if c.isdigit() or len(t) > 1 and c in "'.\"":
        return ERROR if _OCTAL.fullmatch(t) else "L"
    if t.startswith("//"):
        return ""
    if t.startswith("/*"):
        return "" if len(t) > 3 else ERROR
    return ERROR


_set = lambda w: "".join(TOKENS[x] for x in w.split())
_SETS = {
    "ID": "i" + _set(_SOFT),
    "PRIM": _set("boolean byte char double float int long short"),
    "MODS": _set("public private protected static final abstract native synchronized transient volatile strictfp default sealed"),
    "AT": "@",
}
_RULES = {
    "qname": r"@ID (?:\.@ID)*",
    "annot": r"@AT <qname> @ARGS?",
    "mods": r"(?: <annot> | @MODS | 'non' p 'sealed' )*",
    "ctype": r"<qname> <targs>? (?:\. @ID <targs>?)*",
    "type": r"<annot>* (?: @PRIM | <ctype> ) (?:@EMPTYB)*",
    "targ": r"(?: <annot>* \? (?:(?:'extends'|'super') <type>)? | <type> )",
    "targs": r"\< (?: <targ> (?:,<targ>)* )? >",
    "tparams": r"\< @ID (?:'extends' <type> (?:&<type>)*)? (?:, @ID (?:'extends' <type> (?:&<type>)*)?)* >",
    "lambda": r"(?: @ID | @LPARAMS | @PARAMS ) A (?: @BLOCK | <expr> )",
    "new": r"'new' <annot>* (?: (?:@PRIM|<ctype>) (?: (?:@INDEX)+ (?:@EMPTYB)* | (?:@EMPTYB)+ @ARRAY ) | <ctype> @ARGS @CLASS? )",
    "prim": r"(?: L | 'this' | 'super' | <new> | 'switch' @PEXPR @SWITCH | <lambda> | (?:@PRIM|'void'|<qname>) (?:@EMPTYB)* \. 'class' | <type> M (?:@ID|'new') | @ID | @PEXPR )",
    "postfix": r"<prim> (?: \. (?: <targs>? @ID | <new> | 'this' | 'super' | 'class' ) | @ARGS | @INDEX | M <targs>? (?:@ID|'new') )* P?",
    "unary": r"(?: [puP] | @PTYPE (?=[^.,;?=*/>&|)\]}bpAM]) )* <postfix>",
    "binary": r"<unary> (?: (?:[bp*&|]|\<|>{1,3}=?) <unary> | 'instanceof' 'final'? <pattern> )*",
    "pattern": r"(?: <type> @ID? | <type> @RPATTERN )",
    "expr": r"<binary> (?: \? <expr> : (?:<expr>) )? (?: (?:[=a]|>{2,3}=) <expr> )?",
    "exprs": r"<expr> (?:,<expr>)*",
    "init": r"(?: <expr> | @ARRAY )",
    "vars": r"@ID (?:@EMPTYB)* (?:=<init>)? (?:, @ID (?:@EMPTYB)* (?:=<init>)?)*",
    "local": r"(?:<annot>|'final')* <type> <vars>",
    "param": r"(?:<annot>|'final')* <type> E? (?:@ID|'this') (?:@EMPTYB)*",
    "case": r"(?: 'case' (?:<pattern>|<exprs>) (?:, (?:<exprs>|'default'))? (?: @ID <expr> )? | 'default' )",
    "stmt": r"(?>"
    r" @BLOCK | ; | 'if' @PEXPR <stmt> (?:'else' <stmt>)? | 'for' @FOR <stmt> | 'while' @PEXPR <stmt> | 'do' <stmt> 'while' @PEXPR ;"
    r" | 'return' <expr>? ; | 'throw' <expr> ; | (?:'break'|'continue') @ID? ; | 'yield' <expr> ; | 'assert' <expr> (?: : <expr>)? ;"
    r" | 'try' (?: @RES @BLOCK (?:'catch' @CATCH @BLOCK)* (?:'finally' @BLOCK)? | @BLOCK (?: (?:'catch' @CATCH @BLOCK)+ (?:'finally' @BLOCK)? | 'finally' @BLOCK ) )"
    r" | 'switch' @PEXPR @SWITCH ;? | 'synchronized' @PEXPR @BLOCK | <typedecl> | @ID : <stmt> | <local> ; | <expr> ; )",
    "throws": r"'throws' <type> (?:,<type>)*",
    "typedecl": r"<mods> (?: 'class' @ID <tparams>? (?:'extends' <type>)? (?:'implements' <type> (?:,<type>)*)? (?:'permits' <type> (?:,<type>)*)? @CLASS"
    r" | @AT? 'interface' @ID <tparams>? (?:'extends' <type> (?:,<type>)*)? (?:'permits' <type> (?:,<type>)*)? @CLASS"
    r" | 'enum' @ID (?:'implements' <type> (?:,<type>)*)? @ENUM | 'record' @ID <tparams>? @PARAMS (?:'implements' <type> (?:,<type>)*)? @CLASS )",
    "member": r"(?> ; | 'static'? @BLOCK | <typedecl> | <mods> (?: <tparams>? @ID @PARAMS <throws>? @BLOCK | @ID @BLOCK | <tparams>? <annot>* (?:<type>|'void') @ID @PARAMS (?:@EMPTYB)* <throws>? (?: @BLOCK | ; | 'default' <init> ; ) | <type> <vars> ; ) )",
    # methods and fields outside of a class, which the compiler wraps in one
    "loose": r"<mods> (?: <tparams>? <annot>* (?:<type>|'void') @ID @PARAMS (?:@EMPTYB)* <throws>? @BLOCK | <type> <vars> ; )",
    "const": r"<annot>* @ID @ARGS? @CLASS?",
}
_ROLES = {
    "(": [
        ("PEXPR", r"<expr>"),
        ("ARGS", r"(?: (?:<init>|<annot>) (?:, (?:<init>|<annot>))* )?"),
        ("PARAMS", r"(?: <param> (?:, <param>)* )?"),
        ("PTYPE", r"<type> (?:&<type>)*"),
        ("FOR", r"(?: (?:<local>|<exprs>)? ; <expr>? ; <exprs>? | (?:<annot>|'final')* <type> @ID : <expr> )"),
        ("CATCH", r"(?:<annot>|'final')* <type> (?:\|<type>)* @ID"),
        ("RES", r"(?: (?:<annot>|'final')* <type> @ID = <expr> | <postfix> ) (?:; (?: (?:<annot>|'final')* <type> @ID = <expr> | <postfix> ))* ;?"),
        ("LPARAMS", r"(?: @ID (?:,@ID)* | <pattern> (?:,<pattern>)* )?"),
    ],
    "[": [("EMPTYB", r""), ("INDEX", r"<expr>")],
    "{": [
        ("BLOCK", r"(?:<stmt>)*+"),
        ("CLASS", r"(?:<member>)*+"),
        ("ARRAY", r"(?: (?:<init>|<annot>) (?:, (?:<init>|<annot>))* )? ,?"),
        ("ENUM", r"(?: <const> (?:, <const>)* )? ,? (?: ; (?:<member>)*+ )?"),
        ("MODULE", r"(?: (?: 'requires' (?:'transitive'|'static')* <qname> | (?:'exports'|'opens') <qname> (?:'to' <qname> (?:,<qname>)*)? | 'uses' <qname> | 'provides' <qname> 'with' <qname> (?:,<qname>)* ) ; )*"),
        ("SWITCH", r"(?: (?: <case> : (?:<stmt>)*+ )* | (?: <case> A (?: @BLOCK | 'throw' <expr> ; | <expr> ; ) )* )"),
    ],
}
_SETS["RPATTERN"] = ""
JAVA = Grammar(LEXER, TOKENS, _SETS | {"RPATTERN": "".join(chr(0xE000 + m) for m in range(256) if m >> 7 & 1)}, _ROLES, _RULES, r"(?: <annot>* 'package' <qname> ; )? (?: ; | 'import' (?:'static'|'module')? <qname> (?:\.\*)? ; )* (?: <annot>* 'open'? 'module' <qname> @MODULE | (?: ; | <typedecl> | <loose> )*+ )", _classify, parts={"BLOCK": ("<stmt>", ""), "CLASS": ("<member>", "")}, glue="".join(TOKENS[w] for w in ("else", "catch", "finally", "while")))
