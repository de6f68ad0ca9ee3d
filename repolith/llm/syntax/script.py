"""JavaScript and TypeScript."""

from __future__ import annotations

import re

from repolith.llm.syntax.engine import ERROR, Grammar, letters

_STRICT = "if else for while do switch case default break continue return throw try catch finally function class extends new delete typeof void in instanceof var const import export with debugger yield await enum this super"
_SOFT = "let static async of get set from as type interface implements declare abstract public private protected readonly namespace module satisfies is keyof infer asserts unique override accessor using"
TOKENS = letters(_STRICT + " " + _SOFT)
_SOFTS = "".join(TOKENS[w] for w in _SOFT.split())
_WORDS = "".join(TOKENS.values())

_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_T0 = r"`(?:[^`\\]|\\[\s\S])*`"
_E1 = rf"(?:[^{{}}`\"']|{_STRING}|{_T0}|\{{[^{{}}]*\}})*"
_T1 = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{_E1}\}})*`"
_E2 = rf"(?:[^{{}}`\"']|{_STRING}|{_T1}|\{{(?:[^{{}}`\"']|{_STRING}|{_T1})*\}})*"
_TEMPLATE = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{_E2}\}})*`"
_REGEX = r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
LEXER = (
    r"[ \t\f\v\xa0﻿]*("
    rf"(?:return|case|typeof|throw|yield|await|else)(?![\w$])\s*{_REGEX}"
    r"|[A-Za-z_$#][\w$]*|[^\W\d][\w$]*"
    rf"|\n|//[^\n]*|/\*[\s\S]*?\*/|/\*|{_STRING}|{_TEMPLATE}"
    rf"|(?:=>|=|\(|,|:|;|!|&&|\|\||\?|\{{|\}}|\[)\s*{_REGEX}"
    r"|(?:0[xXbBoO])?[\d][\w.]*(?:(?<=[eE])[+-]\d+)?|\.\d\w*"
    r"|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|<<|[-+*/%&|^]=|[^\s])"
)
_OPS = {
    "=>": "A", "==": "b", "===": "b", "!=": "b", "!==": "b", "<=": "b", "&&": "b", "||": "b", "??": "b", "**": "b", "<<": "b", "/": "b", "%": "b", "^": "b",
    "+": "p", "-": "p", "~": "u", "!": "v", "++": "P", "--": "P", "?.": "o", "...": "E",
    "+=": "a", "-=": "a", "*=": "a", "/=": "a", "%=": "a", "&=": "a", "|=": "a", "^=": "a", "**=": "a", "<<=": "a", "&&=": "a", "||=": "a", "??=": "a",
}
_PLAIN = set("(){}[];,.?:=*|&<>@\n")


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
    if c.isalpha() or c in "_$#":
        if "/" in t:  # a word before a regular expression
            return TOKENS[re.match(r"\w+", t)[0]] + "L"
        return "i" if t != "#" else ERROR
    if c.isdigit() or c in "\"'" and len(t) > 1 or c == "." and len(t) > 1:
        return "L"
    if c == "`" and len(t) > 1:
        return "t"
    if t.startswith("//"):
        return ""
    if t.startswith("/*"):
        return ("\n" if "\n" in t else "") if len(t) > 3 else ERROR
    if "/" in t and len(t) > 2:  # an operator, then a regular expression
        head = re.match(r"=>|&&|\|\||.", t)[0]
        return _classify(head) + "L"
    return ERROR


_END = "itL" + _SOFTS + "".join(TOKENS[w] for w in ("this", "super", "return", "break", "continue", "debugger", "yield")) + ")]}Pv>*"
_CONT = ".o?:,;=abp*|&<>A)](tE[{" + "".join(TOKENS[w] for w in ("in", "instanceof", "else", "catch", "finally"))
_DROP = re.compile(f"(?<![{re.escape(_END)}\n])\n+|\n+(?=[{re.escape(_CONT)}])|(?<=\n)\n+")


def _prepare(s: str) -> str:
    return _DROP.sub("", _DROP.sub("", s)).lstrip("\n")


def _grammar(typed: bool) -> Grammar:
    t = lambda p: p if typed else ""
    sets = {"ID": "i" + _SOFTS, "NAME": "i" + _WORDS, "MOD": "".join(TOKENS[w] for w in "static async get set accessor".split() + ("public private protected readonly abstract override declare".split() if typed else []))}
    rules = {
        "end": r"(?:;|\n|\Z)",
        "type": r"[|&]? <tun> (?:[|&] <tun>)* (?: 'extends' <type> \? <type> : <type>)?" if typed else r"(?!)",
        "tun": r"(?:'keyof'|'readonly'|'unique'|'infer'|'asserts')* <tprim> (?:@TARR)* (?:'is' <type>)?" if typed else r"(?!)",
        "tprim": r"(?: 'new'? <tparams>? @PARAMS A <type> | @ID (?:\.@NAME)* <targs>? | 'typeof' @ID (?:\.@NAME)* | 'void' | 'this' | p?[Lt] | @TPAREN | @TARR | @TOBJ | 'import' @ARGS (?:\.@NAME)*)" if typed else r"(?!)",
        "targs": r"\< <type> (?:,<type>)* >" if typed else r"(?!)",
        "tparams": r"\< 'const'? @ID (?:'extends' <type>)? (?:=<type>)? (?:, @ID (?:'extends' <type>)? (?:=<type>)?)* ,? >" if typed else r"(?!)",
        "ann": r":<type>" if typed else r"(?!)",
        "func": r"'async'? 'function' \*? @ID? <tparams>? @PARAMS <ann>? @BLOCK",
        "arrow": r"'async'? (?:@ID | <tparams>? @PARAMS <ann>?) A (?:@BLOCK | <assign>)",
        "deco": r"(?:@AT (?:@ID (?:\.@NAME)* | @PEXPR) @ARGS? \n?)",
        "cls": r"'class' @ID? <tparams>? (?:'extends' <postfix> <targs>?)? " + t(r"(?:'implements' <type> (?:,<type>)*)?") + r" @CLASS",
        "prim": r"(?: <arrow> | <func> | <cls> | @ID | [Lt] | 'this' | 'super' | @PEXPR | @AEXPR | @OBJ | 'import' (?:@ARGS | \.@NAME))",
        "postfix": r"<prim> (?: \.@NAME | o (?:@NAME|@ARGS|@INDEX) | @INDEX | " + t(r"<targs>?") + r" @ARGS | t " + t(r"| v") + r")* P?",
        "unary": r"(?:[puvP] | 'await' | 'typeof' | 'void' | 'delete' | 'new'" + t(r"| (?!<arrow>) \< (?:'const' | <type>) >") + r")* <postfix>",
        "binary": r"<unary> (?: (?:b|p|\*|\||&|\<|>{1,3}=?|'in'|'instanceof') <unary> " + t(r"| 'as' (?:'const'|<type>) | 'satisfies' <type>") + r")*",
        "assign": r"(?: 'yield' \*? <assign>? | <binary> (?:\? <assign> : <assign>)? (?:[=a] <assign>)?)",
        "exprs": r"<assign> (?:,<assign>)*",
        "target": r"(?:@ID|@OPAT|@APAT)",
        "decl": r"<target> " + t(r"v? <ann>?") + r" (?:=<assign>)?",
        "must": r"(?:@ID " + t(r"<ann>?") + r" | (?:@OPAT|@APAT) " + t(r"<ann>?") + r") =<assign>",
        "param": r"<deco>* (?:" + t(r"'public'|'private'|'protected'|'readonly'|'override'|") + r"(?!))* E? (?:<target>" + t(r"|'this'") + r") " + t(r"\?? <ann>?") + r" (?:=<assign>)?",
        "body": r"\n? <stmt>",
        "stmt": r"(?>"
        r" @BLOCK | [;\n] | (?:'let'|'var') <decl> (?:,<decl>)* <end> | 'const' <must> (?:,<must>)* <end> | 'await'? 'using' (?!'of') @ID <ann>? =<assign> (?:, @ID <ann>? =<assign>)* <end>"
        r" | 'async'? 'function' \*? @ID <tparams>? @PARAMS <ann>? (?:@BLOCK" + t(r"|<end>") + r")"
        r" | <deco>* " + t(r"'abstract'?") + r" 'class' (?=@ID) @ID <tparams>? (?:'extends' <postfix> <targs>?)? " + t(r"(?:'implements' <type> (?:,<type>)*)?") + r" @CLASS"
        r" | 'if' @PEXPR <body> (?:\n? 'else' <body>)? | 'for' 'await'? @FOR <body> | 'while' @PEXPR <body> | 'do' <body> \n? 'while' @PEXPR ;?"
        r" | 'return' <exprs>? <end> | 'throw' <exprs> <end> | (?:'break'|'continue') @ID? <end> | 'debugger' <end>"
        r" | 'try' @BLOCK (?: \n? 'catch' @PARAMS? @BLOCK (?:\n? 'finally' @BLOCK)? | \n? 'finally' @BLOCK) | 'switch' @PEXPR @SWITCH"
        + t(r" | 'interface' @ID <tparams>? (?:'extends' <type> (?:,<type>)*)? @TOBJ | 'type' @ID <tparams>? = <type> <end> | 'const'? 'enum' @ID @ENUM | 'declare' <stmt> | (?:'namespace'|'module') (?:@ID(?:\.@ID)*|L) @BLOCK")
        + r" | @ID : <stmt> | <exprs> <end> )",
        "from": r"'from' L",
        "item": r"(?>"
        r" 'import' (?: L | " + t(r"'type'?") + r" (?: @ID (?:, (?:@SPEC | \* 'as' @ID))? | @SPEC | \* 'as' @ID) <from>) <end>"
        r" | 'export' (?: 'default' (?: 'async'? 'function' \*? @ID? <tparams>? @PARAMS <ann>? @BLOCK | " + t(r"'abstract'?") + r" <cls> | <assign> <end>) | " + t(r"'type'?") + r" @SPEC <from>? <end> | \* (?:'as' @NAME)? <from> <end> | (?=" + "|".join(f"'{w}'" for w in ("const", "let", "var", "function", "async", "class", *(("interface", "type", "enum", "abstract", "declare", "namespace", "module") if typed else ()))) + r"|@AT) <stmt>)"
        r" | <deco>+ 'export' 'default'? <stmt> | <stmt> )",
        "key": r"(?:@NAME | L | @INDEX)",
        "member": r"(?> [;\n] | <deco>* @MOD* \n? (?: 'static' @BLOCK | \*? <key> \?? <tparams>? @PARAMS <ann>? (?:@BLOCK" + t(r"|<end>") + r") | <key> " + t(r"[?v]? <ann>?") + r" (?:=<assign>)? <end> " + t(r"| @SIG <ann> <end>") + r"))",
        "tmember": r"(?: 'readonly'? (?: <key> \?? (?:<tparams>? @PARAMS <ann>? | <ann>?) | @SIG \?? <ann>) | 'new'? <tparams>? @PARAMS <ann>? | (?:'get'|'set') <key> @PARAMS <ann>?)" if typed else r"(?!)",
    }
    roles = {
        "(": [
            ("PEXPR", r"<exprs>"),
            ("ARGS", r"(?: E?<assign> (?:, E?<assign>)* ,?)?"),
            ("PARAMS", r"(?: <param> (?:, <param>)* ,?)?"),
            ("FOR", r"(?: (?:(?:'const'|'let'|'var') <decl> (?:,<decl>)* | <exprs>)? ; <exprs>? ; <exprs>? | (?:(?:'const'|'let'|'var'|'await'?'using') <target> | <postfix>) (?:'of' <assign> | 'in' <exprs>) )"),
            ("TPAREN", r"<type>"),
        ],
        "[": [
            ("AEXPR", r",* (?: E?<assign> (?:,+ E?<assign>)* ,*)?"),
            ("INDEX", r"<exprs>"),
            ("APAT", r",* (?: E?<target>(?:=<assign>)? (?:,+ E?<target>(?:=<assign>)?)* ,*)?"),
            ("TARR", r"(?: (?:@ID\??:)? E?<type>\?? (?:, (?:@ID\??:)? E?<type>\??)* ,?)?"),
            ("SIG", r"@ID (?:<ann> | 'in' <type> (?:'as' <type>)?)"),
        ],
        "{": [
            # a module declaration's body begins with an export
            ("BLOCK", r"(?:<stmt>)*+" + t(r"(?:\Z) | (?=\n?'export') (?: 'export' 'const' <decl> <end> | 'export'? <stmt> )*+")),
            ("OBJ", r"(?: (?: E<assign> | (?:'async'|'get'|'set'|\*)* <key> @PARAMS <ann>? @BLOCK | <key> : <assign> | @ID (?:=<assign>)?) (?:, (?: E<assign> | (?:'async'|'get'|'set'|\*)* <key> @PARAMS <ann>? @BLOCK | <key> : <assign> | @ID (?:=<assign>)?))* ,?)?"),
            ("OPAT", r"(?: (?: E@ID | <key> : <target> (?:=<assign>)? | @ID (?:=<assign>)?) (?:, (?: E@ID | <key> : <target> (?:=<assign>)? | @ID (?:=<assign>)?))* ,?)?"),
            ("CLASS", r"(?:<member>)*+"),
            ("SPEC", r"(?: " + t(r"'type'?") + r" @NAME (?:'as' @NAME)? (?:, " + t(r"'type'?") + r" @NAME (?:'as' @NAME)?)* ,?)?"),
            ("TOBJ", r"\n? (?: <tmember> (?:[,;\n]+ <tmember>)* [,;\n]*)?"),
            ("ENUM", r"(?: @NAMEL (?:=<assign>)? (?:, @NAMEL (?:=<assign>)?)* ,?)?"),
            ("SWITCH", r"(?> \n? (?:'case' <exprs>|'default') : (?:<stmt>)*+ )*+"),
        ],
    }
    sets |= {"AT": "@", "NAMEL": sets["NAME"] + "L"}
    return Grammar(LEXER, TOKENS, sets, roles, rules, r"(?:<item>)*+", _classify, _prepare, flat="PEXPR ARGS PARAMS FOR TPAREN AEXPR INDEX APAT TARR SIG OBJ OPAT SPEC ENUM", parts={"BLOCK": ("<stmt>", ""), "CLASS": ("<member>", ""), "TOP": ("<item>", "")}, stops=";\n", glue="".join(TOKENS[w] for w in ("else", "catch", "finally", "while")))


JAVASCRIPT, TYPESCRIPT = _grammar(False), _grammar(True)
