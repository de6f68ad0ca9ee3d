"""Imports, exports, symbols and calls read from source text, and what follows from them.

The relations below are stated line by line for the six languages of the tables; the other
languages' providers are in ``sources.code``.
"""

from __future__ import annotations

from functools import partial

from repolith import relations
from repolith.plans.dialect import duck_sql, spark_sql

_ID = r"([A-Za-z_$][A-Za-z0-9_$]*)"
#: Ordered patterns per extension: kind of the symbol, and the line with its name as first group.
_PATTERNS: dict[str, list[tuple[str, str]]] = {
    "ts": [
        ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}"), ("interface", rf"^\s*(?:export\s+)?interface\s+{_ID}"), ("type", rf"^\s*(?:export\s+)?type\s+{_ID}\s*[=<]"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_ID}"),
        ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"), ("function", rf"^\s*(?:export\s+)?const\s+{_ID}\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^)]*\)[^=]*|[A-Za-z_$]+)\s*=>"),
        ("method", rf"^\s+(?:(?:static|async|public|private|protected|readonly|override|get|set)\s+)*{_ID}\s*\([^;]*\x7b\s*$"),
    ],
    "py": [("class", rf"^\s*class\s+{_ID}"), ("method", rf"^\s+(?:async\s+)?def\s+{_ID}"), ("function", rf"^(?:async\s+)?def\s+{_ID}")],
    "go": [("class", rf"^type\s+{_ID}\s+struct"), ("interface", rf"^type\s+{_ID}\s+interface"), ("type", rf"^type\s+{_ID}\s"), ("method", rf"^func\s+\([^)]*\)\s*{_ID}"), ("function", rf"^func\s+{_ID}"), ("namespace", rf"^package\s+{_ID}")],
    "java": [
        ("class", rf"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+{_ID}"), ("interface", rf"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+{_ID}"), ("enum", rf"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+{_ID}"),
        ("method", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:<[^>]*>\s*)?[A-Za-z_][\w<>\[\], .?]*\s+{_ID}\s*\("),
    ],
    "rs": [("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_ID}"), ("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_ID}"), ("method", rf"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_ID}"), ("function", rf"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_ID}"), ("impl", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?{_ID}")],
}
_PATTERNS["js"] = _PATTERNS["ts"]
#: Words before a parenthesis that call nothing.
_NO_CALL = "'if','for','while','switch','catch','return','function','await','typeof','new','super','elif','def','fn','func','match','and','or','not','in','async','throw','raise','assert','except','with','else','do','case','select','range','make','print'"


def _first(value) -> str:
    """CASE over the patterns of each language; ``value`` gives the result of one."""
    parts = [f"when ext = '{ext}' and ~match(line, '{p}') then {value(kind, p)}" for ext, ps in _PATTERNS.items() for kind, p in ps]
    return "case " + " ".join(parts) + " end"


_EXPORTED = r"""case when ext in ('ts','js') then ~match(line, '^\s*export\b') when ext = 'py' then not ~match(name, '^_') when ext = 'go' then ~match(name, '^[A-Z]')
 when ext = 'java' then ~match(line, '\bpublic\b') else ~match(line, '^\s*pub\b') end"""
_BASE = r"""case when ext in ('ts','js','java') then ~get(line, '\bextends\s+([A-Za-z_$][A-Za-z0-9_$]*)') when ext = 'py' and kind = 'class' then ~get(line, '^\s*class\s+\w+\(\s*([A-Za-z_]\w*)') else '' end"""
_TRAIT = r"""case when ext in ('ts','js','java') then ~get(line, '\bimplements\s+([A-Za-z_$][A-Za-z0-9_$]*)') when ext = 'rs' and kind = 'impl' then ~get(line, '^\s*impl(?:<[^>]*>)?\s+([A-Za-z_]\w*)[\w:<>]*\s+for\s') else '' end"""
_NO_SYMBOL = "('if','for','while','switch','catch','return','function','else','constructor')"
_GO_BLOCK = r"""max(case when ext = 'go' and ~match(line, '^import\s+\($') then n end) over (partition by file_id order by n rows unbounded preceding) as opened,
  max(case when ext = 'go' and ~match(line, '^\)') then n end) over (partition by file_id order by n rows unbounded preceding) as closed"""
_SOURCE = r"""case
  when ext in ('ts','js') then coalesce(nullif(~get(line, '^\s*(?:import|export)\b.*\bfrom\s+[\x27\x22]([^\x27\x22]+)[\x27\x22]'), ''), nullif(~get(line, '^\s*import\s+[\x27\x22]([^\x27\x22]+)[\x27\x22]'), ''), nullif(~get(line, '\brequire\([\x27\x22]([^\x27\x22]+)[\x27\x22]\)'), ''))
  when ext = 'py' then coalesce(nullif(~get(line, '^\s*from\s+([.\w]+)\s+import\b'), ''), nullif(~get(line, '^\s*import\s+([\w.]+)'), ''))
  when ext = 'go' then coalesce(nullif(~get(line, '^import\s+(?:\w+\s+)?\x22([^\x22]+)\x22'), ''), case when opened > coalesce(closed, 0) then nullif(~get(line, '^\s+(?:[\w.]+\s+)?\x22([^\x22]+)\x22\s*$'), '') end)
  when ext = 'java' then nullif(~get(line, '^import\s+(?:static\s+)?([\w.]+)'), '')
  when ext = 'rs' then coalesce(nullif(~get(line, '^\s*(?:pub\s+)?use\s+([\w:]+)'), ''), nullif(~get(line, '^\s*(?:pub\s+)?mod\s+(\w+)\s*;'), '')) end"""

relations.derive(
    # a class is left as soon as a line of its indentation or less declares something
    code_marks=f"""select file_id, repo, path, ext, n, line, kind, name, indent, {_EXPORTED} as exported, {_BASE} as base, {_TRAIT} as trait
 from (select file_id, repo, path, ext, n, line, {_first(lambda k, p: f"'{k}'")} as kind, {_first(lambda k, p: f"~get(line, '{p}')")} as name, length(line) - length(ltrim(line)) as indent from {{source_lines}}) m
 where kind is not null and name not in {_NO_SYMBOL}""",
    code_symbols="""select file_id, repo, path, ext, n, kind, name, exported, base, trait, case when ext = 'go' and kind = 'method' then ~get(line, '^func\\s+\\(\\s*\\w*\\s*\\*?([A-Za-z_]\\w*)') when owner is not null and indent > owner_indent and kind not in ('class','interface') then owner end as parent
 from (select *, ~held(case when kind in ('class','interface','enum','impl') then name end) over (partition by file_id order by n rows between unbounded preceding and 1 preceding) as owner,
  ~held(case when kind in ('class','interface','enum','impl') then indent end) over (partition by file_id order by n rows between unbounded preceding and 1 preceding) as owner_indent from {code_marks}) m""",
    code_imports=f"""select file_id, repo, path, ext, n, line as clause, source from (select *, {_SOURCE} as source
 from (select *, {_GO_BLOCK} from {{source_lines}}) l) m where source is not null""",
    code_calls=rf"""select file_id, repo, path, ext, n, callee, caller from (select file_id, repo, path, ext, n, name, ~each(~all(line, '([A-Za-z_$][\w$.]*)\(')) as callee, caller
  from (select l.file_id, l.repo, l.path, l.ext, l.n, l.line, s.name, ~held(case when s.kind in ('function','method') then s.name end) over (partition by l.file_id order by l.n rows between unbounded preceding and current row) as caller
   from {{source_lines}} l left join {{code_symbols}} s on s.file_id = l.file_id and s.n = l.n) m
  where not ~match(line, '^\s*(//|#|\*|/\*)')) c where callee not in ({_NO_CALL}) and callee <> coalesce(name, '')""",
    hunks="select repo, sha, path, deletions + 1 as new_start, additions as new_lines, status from {commit_files}",
)

#: Where the target of an import may lie: group of languages, order, text before, part of the source, text after.
_CANDIDATES = [
    *[("ts", i, "", "p", s) for i, s in enumerate(["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"])], ("ts", 7, "", "s", ".ts"), ("ts", 8, "", "s", ".tsx"),
    ("py", 0, "", "p", ".py"), ("py", 1, "", "p", "/__init__.py"), ("py", 2, "", "d", ".py"), ("py", 3, "", "d", "/__init__.py"),
    ("go", 0, "", "d", ".go"), ("go", 1, "internal/", "b", ".go"), ("java", 0, "src/main/java/", "d", ".java"), ("java", 1, "src/", "d", ".java"), ("java", 2, "", "d", ".java"),
    ("rs", 0, "src/", "d", ".rs"), ("rs", 1, "src/", "d", "/mod.rs"), ("rs", 2, "", "p", ".rs"), ("rs", 3, "", "p", "/mod.rs"),
]
_RULES = " union all ".join(f"select '{g}' as g, {o} as o, '{a}' as pre, '{k}' as part, '{z}' as suf" for g, o, a, k, z in _CANDIDATES)
_UP = r"~sub(~sub(~sub(~sub(spot, '/\./', '/'), '[^/]+/\.\./', ''), '[^/]+/\.\./', ''), '[^/]+/\.\./', '')"
relations.derive(
    # relative sources start from the importer's folder, or that many levels above it
    import_places=rf"""select file_id, repo, path, ext, n, source, {_UP} as p, ~sub({_UP}, '\.jsx?$', '') as s, d, ~sub(d, '^.*/', '') as b from (
 select file_id, repo, path, ext, n, source, case when ext in ('ts','js') and source like '.%' then ~sub(path, '[^/]*$', '') || source
  when ext = 'py' and source like '.%' then ~sub(path, '[^/]*$', '') || case when source like '...%' then '../../' when source like '..%' then '../' else '' end || replace(~sub(source, '^\.+', ''), '.', '/')
  when ext = 'rs' then ~sub(path, '[^/]*$', '') || ~sub(replace(source, '::', '/'), '^(self|super|crate)/', '') when ext = 'py' then replace(source, '.', '/') else source end as spot,
  case when ext = 'rs' then ~sub(replace(source, '::', '/'), '^(crate|self|super)/', '') when ext in ('go','ts','js') then source else replace(source, '.', '/') end as d from {{code_imports}}) x""",
    resolved=f"""select i.file_id, i.repo, i.path, i.n, i.source, min_by(f.path, r.o) as target from {{import_places}} i join ({_RULES}) r on r.g = case when i.ext = 'js' then 'ts' else i.ext end
 join {{sources}} f on f.repo = i.repo and f.path = r.pre || case r.part when 'p' then i.p when 's' then i.s when 'b' then i.b else i.d end || r.suf where f.path <> i.path group by i.file_id, i.repo, i.path, i.n, i.source""",
    # a call meets the symbols of its repository with that name, its own file's first
    call_targets="""select repo, path, n, caller, callee, target_path, target_n from (select c.repo, c.path, c.n, c.caller, s.name as callee, s.path as target_path, s.n as target_n,
  row_number() over (partition by c.repo, c.path, c.n, c.callee order by case when s.path = c.path then 0 else 1 end, s.path, s.n) as r
  from (select distinct repo, path, n, caller, callee, ~sub(callee, '^.*\\.', '') as last_part from {code_calls}) c join (select repo, path, name, n from {code_symbols} where kind in ('function','method')) s on s.repo = c.repo and s.name = c.last_part) x
 where r = 1 and not (target_path = path and coalesce(caller, '') = callee)""",
)

STATEMENTS: dict[str, str] = {
    "src_05_symbols": "select file_id, n, kind, name, exported, coalesce(parent, '') as parent, base, trait from {code_symbols}",
    "src_05_imports": "select file_id, n, source from {code_imports}",
    "src_05_exports": "select file_id, n, name, kind from {code_symbols} where exported and kind <> 'impl' and parent is null",
    "src_05_calls": "select file_id, n, callee, coalesce(caller, '') as caller from {code_calls}",
    "src_07_script_symbols": "select file_id, n, kind, name, exported, coalesce(parent, '') as parent from {code_symbols} where ext in ('ts','js')",
    "src_08_python_imports": "select file_id, n, source from {code_imports} where ext = 'py'",
    "src_09_go_imports": "select file_id, n, source from {code_imports} where ext = 'go'",
    "src_09_go_types": "select file_id, n, kind, name, exported, coalesce(parent, '') as parent from {code_symbols} where ext = 'go'",
    "src_09_rust_items": "select file_id, n, kind, name, exported, coalesce(parent, '') as parent, trait from {code_symbols} where ext = 'rs'",
    "src_09_java_members": "select file_id, n, kind, name, exported, coalesce(parent, '') as parent, base from {code_symbols} where ext = 'java'",
    # content against the excerpts that the index of an earlier build kept
    "src_12_content_changes": """select coalesce(f.path, o.path) as path, case when o.path is null then 'added' when f.path is null then 'deleted' when o.h <> f.h then 'changed' else 'unchanged' end as change
 from (select path, min(~sha(substr(text, 1, 320))) as h from {sources} group by path) f full outer join (select path, min(~sha(replace(coalesce(excerpt, ''), ~chr(13) || ~chr(10), ~chr(10)))) as h from {index_files} group by path) o on o.path = f.path""",
    "jn_01_import_resolution": "select i.file_id, i.n, i.source, r.target from {code_imports} i left join {resolved} r on r.file_id = i.file_id and r.n = i.n and r.source = i.source",
    "jn_07_call_targets": "select repo, path, n, coalesce(caller, '') as caller, callee, target_path, target_n from {call_targets}",
    "jn_08_inheritance": """select repo, path, name, relation, base, target_path from (select a.repo, a.path, a.name, a.relation, a.base, b.path as target_path, row_number() over (partition by a.repo, a.path, a.n, a.relation order by case when b.path = a.path then 0 else 1 end, b.path, b.n) as r
 from (select repo, path, n, name, 'extends' as relation, base from {code_symbols} where base <> '' union all select repo, path, n, name, 'implements', trait from {code_symbols} where trait <> '') a
 left join (select repo, path, n, name from {code_symbols} where kind in ('class','interface','enum')) b on b.repo = a.repo and b.name = a.base) x where r = 1""",
    # what a name means: an import of the file, else the file's own symbol, else the only export of that name
    "jn_09_resolution_order": r"""select c.file_id, c.name, case when i.name is not null then 'imported' when l.name is not null then 'local' when u.name is not null then 'global' else 'unknown' end as found_in
 from (select distinct file_id, repo, ~sub(callee, '\..*$', '') as name from {code_calls}) c
 left join (select distinct file_id, ~each(~all(~sub(clause, '[\x27\x22].*$', ''), '([A-Za-z_$][\w$]*)')) as name from {code_imports}) i on i.file_id = c.file_id and i.name = c.name
 left join (select distinct file_id, name from {code_symbols}) l on l.file_id = c.file_id and l.name = c.name
 left join (select repo, name from {code_symbols} where exported group by repo, name having count(*) = 1) u on u.repo = c.repo and u.name = c.name""",
    # names that an import binds: alias, else the name itself; a default import means the target's default export, else its first symbol
    "jn_10_bindings": r"""select b.file_id, b.n, b.bound, b.specifier, b.is_default, r.target, case when b.is_default then coalesce(dflt.name, fst.name) else b.specifier end as symbol from (
 select file_id, n, source, coalesce(nullif(~get(item, '\bas\s+([A-Za-z_$][\w$]*)'), ''), ~get(item, '([A-Za-z_$][\w$]*)')) as bound, ~get(item, '([A-Za-z_$][\w$]*)') as specifier, false as is_default
  from (select file_id, n, source, ~each(~split(~get(clause, '\x7b([^\x7d]*)\x7d'), ',')) as item from {code_imports} where ext in ('ts','js') and ~match(clause, '\x7b[^\x7d]*\x7d')) x where trim(item) <> ''
 union all select file_id, n, source, ~get(clause, '^\s*import\s+(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|from\b)'), 'default', true from {code_imports} where ext in ('ts','js') and ~match(clause, '^\s*import\s+(?:type\s+)?[A-Za-z_$][\w$]*\s*(?:,|from\b)')
 union all select file_id, n, source, coalesce(nullif(~get(clause, '\bas\s+(\w+)'), ''), ~get(clause, '\bimport\s+(\w+)')), ~get(clause, '\bimport\s+(\w+)'), false from {code_imports} where ext = 'py') b
 left join {resolved} r on r.file_id = b.file_id and r.n = b.n and r.source = b.source
 left join (select repo, path, min_by(name, n) as name from (select s.repo, s.path, s.name, s.n, l.line from {code_symbols} s join {source_lines} l on l.file_id = s.file_id and l.n = s.n) d where ~match(line, '^\s*export\s+default\b') group by repo, path) dflt on dflt.path = r.target and dflt.repo = r.repo
 left join (select repo, path, min_by(name, n) as name from {code_symbols} group by repo, path) fst on fst.path = r.target and fst.repo = r.repo""",
    "jn_11_containing_symbol": """select file_id, n, name from (select l.file_id, l.n, l.y, ~held(l.name) over (partition by l.file_id order by l.n, l.y, l.name rows unbounded preceding) as name
 from (select file_id, n, cast(null as varchar(20)) as name, 1 as y from {source_lines} union all select file_id, line, max(name), 0 from {symbols_} group by file_id, line) l) x where y = 1 and name is not null""",
    "jn_15_orphan_exports": "select s.repo, s.path, s.name from {code_symbols} s where s.exported and s.parent is null and not exists (select 1 from {resolved} r where r.repo = s.repo and r.target = s.path)",
    "jn_15_unused_imports": r"""select i.file_id, i.n, i.name from (select file_id, n, ~each(~all(~sub(~sub(clause, '[\x27\x22].*$', ''), '\bfrom\s+[.\w]+\s+import', ''), '([A-Za-z_$][\w$]*)')) as name from {code_imports} where ext in ('ts','js','py')) i
 where i.name not in ('import','from','as','type','export') and not exists (select 1 from {code_calls} c where c.file_id = i.file_id and (c.callee = i.name or c.callee like i.name || '.%'))""",
    # exact places of the tested file, in this order, else the first whose name holds the test's
    "jn_20_test_source": r"""select repo, test_path, source_path from (select t.repo, t.path as test_path, coalesce(min(case when s.path = t.beside then s.path end), min(case when s.path = t.above then s.path end), min(case when s.path = t.src then s.path end), min(case when s.path = t.lib then s.path end), min(s.path)) as source_path
 from (select repo, path, ~sub(path, '(_test|\.test|\.spec)\.', '.') as beside, ~sub(~sub(path, '(_test|\.test|\.spec)\.', '.'), '(__tests__|tests?)/', '') as above, 'src/' || ~sub(~sub(~sub(path, '^.*/', ''), '(_test|\.test|\.spec)\.', '.'), '^test_', '') as src, 'lib/' || ~sub(~sub(path, '^.*/', ''), '(_test|\.test|\.spec)\.', '.') as lib,
  ~sub(~sub(~sub(path, '^.*/', ''), '(_test|\.test|\.spec)?\.[a-z]+$', ''), '^test_', '') as stem, ~get(~sub(~sub(path, '^.*/', ''), '^test_', ''), '^([^_.-]+)') as word from {sources} where ~match(path, '(_test|\.test|\.spec)\.')) t
 join (select repo, path, ~each(~split(~sub(~sub(path, '^.*/', ''), '\.[a-z]+$', ''), '[_-]')) as word, ~sub(~sub(path, '^.*/', ''), '\.[a-z]+$', '') as stem from {sources} where not ~match(path, '(_test|\.test|\.spec)\.')) s on s.repo = t.repo and s.word = t.word and position(t.stem in s.stem) > 0 group by t.repo, t.path) x""",
    "jn_22_tests_for_symbol": "select repo, callee as name, path as test_file, caller as test_name from {call_targets} where ~match(path, '(_test|\\.test|\\.spec)\\.|(^|/)tests?/') or ~match(coalesce(caller, ''), '^(test_|Test)') group by repo, callee, path, caller",
    "flt_11_line_proximity": "select distinct h.sha, y.path, y.name, y.line from {hunks} h join {symbols_} y on y.repo = h.repo and y.path = h.path and y.line between h.new_start - 3 and h.new_start + greatest(h.new_lines, 1) - 1 + 3",
    "flt_12_line_in_hunk": "select distinct h.sha, y.path, y.name, y.line from {hunks} h join {symbols_} y on y.repo = h.repo and y.path = h.path and y.line between h.new_start and h.new_start + h.new_lines",
    "jn_05_function_commits": "select distinct h.sha, y.repo, y.path, y.name from {hunks} h join {symbols_} y on y.repo = h.repo and y.path = h.path and y.line <= h.new_start + h.new_lines and h.new_start <= coalesce(y.end_line, y.line) where y.kind in ('function','method')",
    "jn_04_class_context": "select distinct c.repo, c.path, c.name, coalesce(c.base, '') as base, coalesce(c.trait, '') as trait, coalesce(m.name, '') as method from {code_symbols} c left join {code_symbols} m on m.repo = c.repo and m.path = c.path and m.parent = c.name and m.kind = 'method' where c.kind = 'class'",
    "jn_04_function_context": "select distinct f.repo, f.path, f.name, coalesce(i.caller, '') as caller, coalesce(o.callee, '') as callee from {code_symbols} f left join {call_targets} i on i.repo = f.repo and i.target_path = f.path and i.target_n = f.n left join {call_targets} o on o.repo = f.repo and o.path = f.path and o.caller = f.name where f.kind = 'function'",
    "gr_11_entry_points": "select f.repo, f.path, f.by_path, coalesce(e.handlers, 0) as handlers from (select repo, path, ~match(path, '(^|/)(routes?|api|controllers?|handlers?|pages|cmd)/|(^|/)(main|index|server|app)\\.') as by_path from {sources}) f left join (select repo, path, count(*) as handlers from {code_symbols} where exported and (~match(lower(name), '^(get|post|put|patch|delete|handler|action)$') or ~match(name, '(Handler|Controller|Route)$')) group by repo, path) e on e.repo = f.repo and e.path = f.path where f.by_path or e.handlers > 0",
    "gr_15_kg_edges": """select kind, source, target, max(weight) as weight from (
 select 'imports' as kind, repo || ':' || path as source, repo || ':' || target as target, 1e0 as weight from {resolved}
 union all select 'imports', cast(src as varchar(20)), cast(dst as varchar(20)), 9e-1 from {edges}
 union all select 'defines', repo || ':' || path, repo || ':' || path || '#' || name, 8e-1 from {code_symbols}
 union all select 'calls', repo || ':' || path || '#' || caller, repo || ':' || target_path || '#' || callee, 7e-1 from {call_targets} where caller is not null
 union all select 'uses', repo || ':' || path, repo || ':' || target_path || '#' || callee, case when path = target_path then 8e-1 else 45e-2 end from {call_targets}
 union all select 'extends', c.repo || ':' || c.path || '#' || c.name, c.repo || ':' || coalesce(t.path, '') || '#' || c.base, case when t.path = c.path then 9e-1 else 75e-2 end from {code_symbols} c left join (select repo, name, min(path) as path from {code_symbols} where kind in ('class','interface') group by repo, name) t on t.repo = c.repo and t.name = c.base where c.base <> ''
 union all select 'implements', repo || ':' || path || '#' || name, repo || ':#' || trait, 8e-1 from {code_symbols} where trait <> ''
 union all select 'member_of', repo || ':' || path || '#' || name, repo || ':' || path || '#' || parent, 5e-1 from {code_symbols} where parent is not null) e where source <> target group by kind, source, target""",
    "imp_04_pull_request_report": """select p.id, p.files, p.lines, ~r1(least(p.files * 5e0, 30e0) * 3e-1 + least(p.lines / 1e1, 30e0) * 3e-1) as impact, case when p.lines >= 500 or p.files >= 20 then 'high' when p.lines >= 200 or p.files >= 8 then 'medium' else 'low' end as level,
 case when p.reviews = 0 and p.lines >= 200 then 'review' else '' end as needs_review, case when p.files >= 20 then 'split' else '' end as needs_split, case when p.is_draft then 'draft' else '' end as is_draft, count(l.dep) as deployments from {prs} p left join {dep_prs} l on l.pr = p.id group by p.id, p.files, p.lines, p.reviews, p.is_draft""",
    # per changed file at most four symbols around its hunks, sixteen a commit, each with what depends on the file
    "imp_06_review_context": """select repo, sha, path, name, line, place, dependents from (select x.*, row_number() over (partition by repo, sha order by path, place) as in_commit from (select h.repo, h.sha, h.path, y.name, y.line, row_number() over (partition by h.repo, h.sha, h.path order by y.line, y.name) as place, coalesce(d.n, 0) as dependents
  from (select distinct repo, sha, path, new_start, new_lines from {hunks}) h join (select distinct repo, path, name, line from {symbols_}) y on y.repo = h.repo and y.path = h.path and y.line between h.new_start - 3 and h.new_start + h.new_lines + 3
  left join (select repo, target, count(distinct path) as n from {resolved} group by repo, target) d on d.repo = h.repo and d.target = h.path) x where place <= 4) z where in_commit <= 16""",
    "jn_19_snapshot_diff": """select coalesce(a.path, b.path) as path, coalesce(a.name, b.name) as name, case when a.name is null then 'addition' when b.name is null then 'breaking' when b.documentation like '%@deprecated%' and a.documentation not like '%@deprecated%' then 'deprecation' else 'kept' end as change
 from (select repo, path, name, max(coalesce(documentation, '')) as documentation from {symbols_} where exported group by repo, path, name) a full outer join (select repo, path, name, '' as documentation from {code_symbols} where exported group by repo, path, name) b on a.repo = b.repo and a.path = b.path and a.name = b.name""",
    "chg_02_api_diff": """select repo, count(case when old_kind is null then 1 end) as added, count(case when new_kind is null then 1 end) as removed, count(case when old_kind <> new_kind then 1 end) as changed, count(case when old_kind = new_kind then 1 end) as same
 from (select coalesce(a.repo, b.repo) as repo, a.kind as old_kind, b.kind as new_kind from (select repo, path, name, min(kind) as kind from {symbols_} where exported group by repo, path, name) a full outer join (select repo, path, name, min(kind) as kind from {code_symbols} where exported group by repo, path, name) b on a.repo = b.repo and a.path = b.path and a.name = b.name) x group by repo""",
    "agg_24_version_mismatch": "select part, count(distinct supplier) as users, count(distinct version) as versions from {part_versions} group by part having count(distinct supplier) > 1 and count(distinct version) > 1",
    "agg_21_grouped_names": "select repo, path, count(*) as n, ~names(name) as names from {code_symbols} where exported group by repo, path",
}

QUERIES = {k: partial(relations.run, sql=spark_sql(v)) for k, v in STATEMENTS.items()}
SQL = {k: relations.oracle(duck_sql(v)) for k, v in STATEMENTS.items()}
