"""Complexity, history, load, drift and signals of source files, stated once for both engines."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from repolith import relations
from repolith.plans import code, reports  # noqa: F401  (their relations are used here)
from repolith.plans.dialect import duck_sql, spark_sql
from repolith.session import cut

# fixed values: control flow patterns of each language; those that overlap count twice
_FLOW = {
    "ts": [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\belse\b", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bdo\s*\x7b", r"\bswitch\s*\(", r"\bcase\s+", r"\bcatch\s*\(", r"\?\?", r"\?\.", r"\?[^:]", "&&", r"\|\|"],
    "py": [r"\bif\s+", r"\belif\s+", r"\belse\s*:", r"\bfor\s+", r"\bwhile\s+", r"\btry\s*:", r"\bexcept\s*", r"\bfinally\s*:", r"\bwith\s+", r"\band\b", r"\bor\b", r"\bif\s+.+\s+else\s+", r"\bfor\s+.+\s+in\s+"],
    "go": [r"\bif\s+", r"\belse\s+if\s+", r"\belse\s*\x7b", r"\bfor\s+", r"\bswitch\s+", r"\bcase\s+", r"\bdefault\s*:", r"\bselect\s*\x7b", r"\bgo\s+", r"\bdefer\s+", "&&", r"\|\|"],
    "java": [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\belse\b", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bdo\s*\x7b", r"\bswitch\s*\(", r"\bcase\s+", r"\bcatch\s*\(", r"\bfinally\b", r"\?[^:]", "&&", r"\|\|"],
    "rs": [r"\bif\s+", r"\belse\s+if\s+", r"\belse\s*\x7b", r"\bfor\s+", r"\bwhile\s+", r"\bloop\s*\x7b", r"\bmatch\s+", r"=>\s*\x7b", r"\bif\s+let\s+", r"\bwhile\s+let\s+", r"\?", "&&", r"\|\|"],
}
_FLOW["js"] = _FLOW["ts"]
_KEYWORD = r"\b(if|else|for|while|switch|try|catch|elif|elsif|unless|case|when|match|loop)\b"


def _flow(text: str) -> str:
    return "case ext " + " ".join(f"when '{ext}' then " + " + ".join(f"~count({text}, '{p}')" for p in ps) for ext, ps in _FLOW.items()) + " else 0 end"


_DELTA = "length(replace(line, ~chr(125), '')) - length(replace(line, ~chr(123), ''))"
_FILE, _BEFORE = "partition by file_id order by n rows unbounded preceding", "partition by file_id order by n rows between unbounded preceding and 1 preceding"
_WORDS = rf"""case when ~match(line, '{_KEYWORD}') then 1 else 0 end as word, case when ~match(line, '\b(break|continue|goto)\s+\w+') then 1 else 0 end + case when ~match(line, '\b(this|self)\.\w+\(|\brecurs') then 1 else 0 end as extra"""
# rates of a file (m its lines, s its symbols)
_RATES = "coalesce(s.cyc, 0e0) as cyc, coalesce(s.cog, 0e0) as cog, coalesce(s.abstract_n * 1e0 / nullif(s.abstract_n + s.concrete_n, 0), 0e0) as abstractness"
_MI = "~clamp(171 - 5.2e0 * ln(m.logical * log2(coalesce(s.symbols, 0) + 1) + 1) - 23e-2 * coalesce(s.cyc, 0e0) - 16.2e0 * ln(m.lines + 1)) as mi"
_OF_SYMBOLS = "select y.file_id, avg(y.cyclomatic * 1e0) as cyc, avg(y.cognitive * 1e0) as cog, count(*) as symbols, count(case when c.exported then 1 end) as exports, count(distinct y.kind) as kinds, count(case when y.kind in ('interface','type') then 1 end) as abstract_n, count(case when y.kind in ('class','function') then 1 end) as concrete_n"

relations.derive(
    # a block comment that isn't closed on its line lasts until a line that closes one
    line_kinds=rf"""select file_id, repo, path, ext, n, line, delta, case when trim(line) = '' then 'blank' when ext = 'py' then case when ~match(line, '#|\x27\x27\x27') then 'comment' else 'logical' end
  when ~match(line, '/\*') or coalesce(opened, 0) > coalesce(closed, 0) or ~match(line, '//') then 'comment' else 'logical' end as kind
 from (select *, {_DELTA} as delta, max(case when ~match(line, '/\*') and not ~match(line, '\*/') then n end) over ({_BEFORE}) as opened, max(case when ~match(line, '\*/') then n end) over ({_BEFORE}) as closed from {{source_lines}}) x""",
    line_metrics=rf"""select file_id, count(*) as lines, count(case when kind = 'blank' then 1 end) as blank, count(case when kind = 'comment' then 1 end) as comments, count(case when kind = 'logical' then 1 end) as logical, greatest(0, max(depth)) as nesting,
  count(case when kind = 'logical' and ~match(line, '\breturn\b') then 1 end) as returns, count(length_to) as functions, avg(length_to) as avg_function, coalesce(max(length_to), 0) as max_function, coalesce(sum(params), 0) as params
 from (select file_id, n, line, kind, case when kind = 'logical' then depth end as depth, case when starts then coalesce(lead(n) over (partition by file_id, starts order by n), total + 1) - n end as length_to, case when starts then ~len(~all(~get(line, '\(([^)]*)\)'), '([^,]*[^,\s][^,]*)')) end as params
  from (select *, kind = 'logical' and ~match(trim(line), '\b(function|async function|\w+\s*\(.*\)\s*[:\x7b]|=>\s*\x7b?)') as starts, count(*) over (partition by file_id) as total, sum(case when kind = 'logical' then delta else 0 end) over ({_FILE}) as depth from {{line_kinds}}) x) y group by file_id""",
    # sums up to each line; those of a symbol are differences
    line_sums=rf"""select file_id, n, sum(flow) over ({_FILE}) as flow, sum(word) over ({_FILE}) as word, sum(word * depth) over ({_FILE}) as deep, sum(extra) over ({_FILE}) as extra, depth from (
 select file_id, n, {_flow("line")} as flow, {_WORDS}, sum(delta) over ({_FILE}) - delta as depth from {{line_kinds}}) x""",
    line_depths=f"select file_id, n, delta, sum(delta) over ({_FILE}) as after_n from {{line_kinds}}",
    # a line that closes blocks ends all levels down to its depth; a block ends at the next such line of its level
    block_ends="""select file_id, n, close_n from (select file_id, n, opens, min(case when not opens then n end) over (partition by file_id, level order by n rows between 1 following and unbounded following) as close_n
 from (select file_id, n, after_n - delta as level, true as opens from {line_depths} where delta > 0 union all select file_id, n, ~each(~seq(after_n, after_n - delta - 1)), false from {line_depths} where delta < 0) x) y where opens""",
    # a symbol ends where the braces it opens close; without any it is its line, in python it lasts to the next symbol
    symbol_extents="""select s.file_id, s.repo, s.path, s.ext, s.name, s.kind, s.n, case when s.ext = 'py' then coalesce(s.nxt - 1, s.lines) else coalesce(b.close_n, s.n) end as end_n
 from (select c.file_id, c.repo, c.path, c.ext, c.name, c.kind, c.n, f.lines, lead(c.n) over (partition by c.file_id order by c.n) as nxt from {code_symbols} c join {sources} f on f.file_id = c.file_id where c.kind <> 'impl') s left join {block_ends} b on b.file_id = s.file_id and b.n = s.n""",
    symbol_metrics="""select e.file_id, e.repo, e.path, e.name, e.kind, e.n, e.end_n - e.n + 1 as lines, 1 + z.flow - coalesce(a.flow, 0) as cyclomatic, (z.word - coalesce(a.word, 0)) + (z.deep - coalesce(a.deep, 0)) - b.depth * (z.word - coalesce(a.word, 0)) + (z.extra - coalesce(a.extra, 0)) as cognitive
 from {symbol_extents} e join {line_sums} z on z.file_id = e.file_id and z.n = e.end_n join {line_sums} b on b.file_id = e.file_id and b.n = e.n left join {line_sums} a on a.file_id = e.file_id and a.n = e.n - 1""",
    file_scores=f"""select x.*, ~clamp((100 - least(1e2, cyc * 5)) * 25e-2 + (100 - least(1e2, cog * 3)) * 25e-2 + mi * 3e-1 + cohesion * 1e1 + (1 - least(1e0, nesting / 1e1)) * 1e1) as overall from (
 select f.file_id, f.repo, f.path, m.lines, m.comments, m.nesting, m.avg_function, m.params, {_RATES}, coalesce(1 - s.exports * 1e0 / nullif(s.symbols, 0), 1e0) as cohesion, coalesce(s.symbols, 0) as symbols, coalesce(s.exports, 0) as exports, coalesce(s.kinds, 0) as kinds,
  {_MI}
  from {{sources}} f join {{line_metrics}} m on m.file_id = f.file_id left join ({_OF_SYMBOLS}
   from {{symbol_metrics}} y join {{code_symbols}} c on c.file_id = y.file_id and c.n = y.n group by y.file_id) s on s.file_id = f.file_id) x""",
    # churn of half a year, who owns how much, who is active
    file_history="""select h.repo, h.path, h.n, h.churn, greatest(0e0, 100 - 100 * h.churn / 180e0) as stability, h.age_days, h.last_at, h.authors, case when o.top_pct > 80 then 50 else 0 end + case when o.active <= 1 then 30 else 0 end + case when o.active = 0 then 20 else 0 end as risk, h.fixes * 1e0 / h.n > 3e-1 and h.n > 5 as regression_prone
 from (select repo, path, count(*) as n, count(case when ts >= NOW - 180 * 86400000000 then 1 end) as churn, ~day(NOW - min(ts)) as age_days, max(ts) as last_at, count(distinct author) as authors, count(case when status = 'modified' and deletions > additions then 1 end) as fixes from {commit_files} group by repo, path) h
 join (select repo, path, max(~r0(~div(100 * k, total))) as top_pct, count(case when last_at > NOW - 30 * 86400000000 then 1 end) as active from (select repo, path, author, count(*) as k, max(ts) as last_at, sum(count(*)) over (partition by repo, path) as total from {commit_files} group by repo, path, author) a group by repo, path) o on o.repo = h.repo and o.path = h.path""",
    import_links="select repo, path, source, case when source like '.%' then ~sub(source, '^(\\./|\\.\\./)+', '') else ~get(source, '^(@?[^/.:]+)') end as domain, source not like '.%' as external from {code_imports}",
    file_loads="""select s.file_id, s.repo, s.path, s.overall, ~r0(~clamp(s.cyc * 4 + s.nesting * 2)) as cyclomatic_load, ~r0(~clamp(s.cog * 3 + s.nesting * 4)) as cognitive_load, ~r0(~clamp(~div(100 * coalesce(d.odd, 0), greatest(s.symbols, 1)))) as naming_load, ~r0(~clamp(s.nesting * 10 + coalesce(s.avg_function, 0) / 2e0 + s.params * 15e-1)) as abstraction_load,
  ~r0(~clamp(coalesce(p.score, 0e0))) as coupling_load, ~r0(100 - ~clamp(100 * (65e-2 * ~div(coalesce(d.documented, 0), greatest(s.symbols, 1)) + 35e-2 * ~div(s.comments, s.lines)))) as documentation_load, ~r0(~clamp(12e0 * (coalesce(i.domains, 0) + greatest(0, s.kinds - 2) + least(3, coalesce(i.externals, 0))))) as switch_load,
  ~r0(~clamp(coalesce(i.externals, 0) * 14e0 + greatest(0, coalesce(i.domains, 0) - 1) * 10 + greatest(0, s.kinds - 1) * 6)) as model_load, ~r0(~clamp(coalesce(h.churn, 0) / 180e0 * 120 + (100 - coalesce(h.stability, 100e0)) * 25e-2)) as churn_load, coalesce(h.risk, 0) as risk
 from {file_scores} s left join (select file_id, count(documentation) as documented, count(case when (kind in ('class','interface') and not ~match(name, '^[A-Z]')) or (kind in ('function','method') and ~match(name, '^[A-Z]')) then 1 end) as odd from {symbols_} group by file_id) d on d.file_id = s.file_id
 left join (select repo, path, count(distinct domain) as domains, count(case when external then 1 end) as externals from {import_links} group by repo, path) i on i.repo = s.repo and i.path = s.path
 left join (select repo, path, max(score) as score from (select repo, path_a as path, score from {coupled} union all select repo, path_b, score from {coupled}) c group by repo, path) p on p.repo = s.repo and p.path = s.path left join {file_history} h on h.repo = s.repo and h.path = s.path""",
    coupled=f"select a.repo, a.path as path_a, b.path as path_b, least(100e0, 35e-2 * count(*) + 100e0 * count(*) / least(max(a.n), max(b.n))) as score from {reports._SEVERAL} a join {reports._SEVERAL} b on a.repo = b.repo and a.sha = b.sha and a.path < b.path group by a.repo, a.path, b.path having count(*) >= 3",
    load_scores="select *, ~r0(14e-2 * cyclomatic_load + 18e-2 * cognitive_load + 1e-1 * naming_load + 9e-2 * abstraction_load + 13e-2 * coupling_load + 1e-1 * documentation_load + 1e-1 * switch_load + 8e-2 * model_load + 8e-2 * churn_load) as score from {file_loads}",
)

_STYLE = r"""case when ~match(stem, '^[a-z0-9]+(-[a-z0-9]+)+$') then 'kebab-case' when ~match(stem, '^[a-z][a-zA-Z0-9]*$') then 'camelCase' when ~match(stem, '^[A-Z][a-zA-Z0-9]*$') then 'PascalCase' when ~match(stem, '^[a-z0-9]+(_[a-z0-9]+)+$') then 'snake_case' else 'mixed' end"""
_CONVENTIONS = r"""select file_id, 'file-length' as rule, path as subject from {sources} where lines > 500 union all select file_id, 'export-count', path from {file_scores} where exports > 10
 union all select file_id, 'class-name', name from {code_symbols} where kind = 'class' and not ~match(name, '^[A-Z][a-zA-Z0-9]*$') union all select file_id, 'interface-name', name from {code_symbols} where kind = 'interface' and not ~match(name, '^I?[A-Z][a-zA-Z0-9]*$')
 union all select file_id, 'function-name', name from {code_symbols} where kind = 'function' and ext in ('ts','js') and not ~match(name, '^[a-z][a-zA-Z0-9]*$')"""
# rules of each type; layers are top folders, and those below may not import those above
_INVARIANTS = r"""select 'no-import' as rule, repo, path, source as detail from {code_imports} where ~match(source, '(^|/)(registry|secret)') union all select 'require-import', f.repo, f.path, '' from {sources} f where f.path like 'tests/%' and not exists (select 1 from {code_imports} i where i.file_id = f.file_id)
 union all select 'layer-boundary', repo, path, source from {code_imports} where path like 'lib/%' and ~match(source, '^(src|packages)/') union all select 'naming-pattern', repo, path, name from {code_symbols} where kind = 'class' and not ~match(name, '^[A-Z]')
 union all select 'max-dependencies', repo, path, cast(count(*) as varchar(20)) from {code_imports} group by repo, path having count(*) > 3 union all select 'annotation-required', s.repo, s.path, s.name from {symbols_} s where s.exported and s.kind = 'class' and s.documentation is null
 union all select 'file-pattern', repo, path, '' from {sources} where not ~match(path, '^(src|lib|packages|tests|internal|app|cmd)/')"""
_SIGNALS = r"""select 'god-class' as rule, 'warning' as severity, path as subject from {sources} where lines > 500 union all select 'cycle', 'error', n.path from {edges} a join {edges} b on a.src = b.dst and a.dst = b.src join {nodes} n on n.id = a.src
 union all select 'orphan-export', 'info', s.path || '#' || s.name from {code_symbols} s where s.exported and s.parent is null and not exists (select 1 from {resolved} r where r.repo = s.repo and r.target = s.path)
 union all select 'high-churn', 'warning', path from (select repo, path, count(*) * 1e0 / greatest(1e0, (max(ts) - min(ts)) / 8.64e10) as frequency from {commit_files} group by repo, path) c where frequency > 10 / 30e0
 union all select 'missing-tests', 'info', f.path from {sources} f where not ~match(f.path, '\.(test|spec)\.|_test\.') and not exists (select 1 from {sources} t where t.repo = f.repo and ~match(t.path, '\.(test|spec)\.|_test\.') and ~sub(~sub(t.path, '^.*/', ''), '(\.test|\.spec|_test)?\.[a-z]+$', '') = ~sub(~sub(f.path, '^.*/', ''), '\.[a-z]+$', ''))"""
_DRIFT = rf"""select 'dependency' as category, 'medium' as severity, path as subject from (select n.path, count(distinct e.dst) as o, count(distinct i.src) as f from {{nodes}} n left join {{edges}} e on e.src = n.id left join {{edges}} i on i.dst = n.id group by n.id, n.path) d where o > 12 or f > 20
 union all select 'dependency', 'high', n.path from {{edges}} a join {{edges}} b on a.src = b.dst and a.dst = b.src join {{nodes}} n on n.id = a.src union all select 'structural', 'high', path from {{sources}} where lines > 500 union all select 'structural', 'medium', path from {{file_scores}} where exports > 10
 union all select case when rule in ('layer-boundary','no-import','require-import') then 'boundary' when rule = 'naming-pattern' then 'naming' when rule = 'max-dependencies' then 'dependency' else 'structural' end, 'medium', path from ({_INVARIANTS}) v union all select case when rule like '%name' then 'naming' else 'structural' end, 'medium', subject from ({_CONVENTIONS}) c"""
_POINTS = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end"

STATEMENTS: dict[str, str] = {
    "cpx_01_line_metrics": "select file_id, lines, blank, comments, logical, nesting, returns, functions, ~r2(coalesce(avg_function, 0e0)) as avg_function, max_function, params from {line_metrics}",
    "cpx_02_symbol_extents": "select file_id, name, n, end_n from {symbol_extents}",
    "cpx_03_cyclomatic": f"select file_id, 1 + {_flow('text')} as cyclomatic from {{sources}}",
    "cpx_04_symbol_cognitive": "select file_id, name, n, cyclomatic, cognitive * 1 as cognitive from {symbol_metrics}",
    "cpx_05_file_score": "select file_id, ~r1(cyc) as cyclomatic, ~r1(cog) as cognitive, ~r2(abstractness) as abstractness, ~r2(cohesion) as cohesion, ~r0(mi) as maintainability, ~r0(overall) as overall from {file_scores}",
    "cpx_07_signals": """select file_id, rule from (select file_id, 'high-cyclomatic' as rule from {file_scores} where cyc > 15 union all select file_id, 'high-cognitive' from {file_scores} where cog > 20 union all select file_id, 'low-maintainability' from {file_scores} where mi < 40
 union all select f.file_id, 'high-coupling' from {file_scores} f join (select path, count(*) as k from {code_imports} group by path) i on i.path = f.path where 5 * i.k > 50 union all select f.file_id, 'instability-zone' from {file_scores} f where abstractness < 3e-1 and exists (select 1 from {code_imports} i where i.file_id = f.file_id) and not exists (select 1 from {resolved} r where r.repo = f.repo and r.target = f.path)
 union all select file_id, 'complex-symbol' from {symbol_metrics} where cyclomatic > 20 union all select file_id, 'long-function' from {symbol_metrics} where lines > 100) x""",
    "prj_02_simple_complexity": "select f.file_id, greatest(1, f.symbols) as cyclomatic, 2 * coalesce(y.functions, 0) as cognitive, coalesce(i.k, 0) as coupling, ~r1(greatest(0e0, 100 - f.lines / 10e0 - f.symbols)) as maintainability from {file_scores} f left join (select file_id, count(*) as functions from {code_symbols} where kind = 'function' group by file_id) y on y.file_id = f.file_id left join (select file_id, count(*) as k from {code_imports} group by file_id) i on i.file_id = f.file_id",
    "flt_13_ladders": """select file_id, case when mi >= 80 then 'A' when mi >= 60 then 'B' when mi >= 40 then 'C' when mi >= 20 then 'D' else 'F' end as grade, case when cyc > 25 then 'error' when cyc > 15 then 'warning' else 'ok' end as cyclomatic_level, case when cog > 35 then 'error' when cog > 20 then 'warning' else 'ok' end as cognitive_level from {file_scores}""",
    "tmp_01_insights": "select repo, path, ~r0(stability) as stability, cast(floor(churn / 180e0 * 1000 + 5e-1) as bigint) as churn_per_mille, regression_prone, risk, case when n in (1, 3) then 'decreasing' else 'stable' end as coupling_trend, age_days, last_at, authors from {file_history}",
    "tmp_03_hotspots": "select h.repo, h.path, ~r0((100 - h.stability) / 2 + (100 - coalesce(s.overall, 50e0)) / 2) as hotspot, h.risk, h.last_at < NOW - 180 * 86400000000 as stale from {file_history} h left join {file_scores} s on s.repo = h.repo and s.path = h.path order by hotspot desc, h.repo, h.path limit 10",
    "tmp_03_risk_files": "select repo, path, risk from {file_history} where risk > 50 order by risk desc, repo, path limit 10",
    "tmp_05_volatility": "select repo, path, ~r2((100 - stability) / 100) as volatility, ~r2(least(1e0, (100 - stability) / 100 * case when regression_prone then 1e0 else 5e-1 end + risk / 200e0)) as fragility from {file_history}",
    "jn_17_ratios": "select a.repo, a.path as path_a, b.path as path_b, count(*) as shared, ~r4(count(*) * 1e0 / least(max(a.n), max(b.n))) as ratio from " + reports._SEVERAL + " a join " + reports._SEVERAL + " b on a.repo = b.repo and a.sha = b.sha and a.path < b.path group by a.repo, a.path, b.path having count(*) > 2",
    "jn_18_co_change_of_file": "select b.path, count(*) as together, ~r4(count(*) * 1e0 / max(k.n)) as confidence from (select repo, sha from {commit_files} where path = 'CHANGELOG.md') a join {commit_files} b on a.repo = b.repo and a.sha = b.sha join (select count(*) as n from {commit_files} where path = 'CHANGELOG.md') k on k.n > 0 where b.path <> 'CHANGELOG.md' group by b.path order by together desc, b.path limit 20",
    "imp_03_risk": """select c.repo, c.sha, ~r0(least(coalesce(y.symbols, 0) * 5e0, 30e0) * 3e-1 + least(coalesce(m.modules, 0) * 10e0, 30e0) * 3e-1 + least(coalesce(y.broken, 0) * 20e0, 30e0) * 25e-1 / 10 + least(coalesce(m.crossing, 0) * 15e0, 20e0) * 15e-2) as risk
 from {commits} c left join (select h.repo, h.sha, count(distinct y.path || y.name) as symbols, count(distinct case when y.exported and h.status = 'deleted' then y.path || y.name end) as broken from {hunks} h join {symbols_} y on y.repo = h.repo and y.path = h.path and y.line between h.new_start and h.new_start + h.new_lines group by h.repo, h.sha) y on y.repo = c.repo and y.sha = c.sha
 left join (select f.repo, f.sha, count(distinct r.path) as modules, count(distinct case when split_part(r.path,'/',1) <> split_part(f.path,'/',1) then r.path end) as crossing from {commit_files} f join {resolved} r on r.repo = f.repo and r.target = f.path group by f.repo, f.sha) m on m.repo = c.repo and m.sha = c.sha""",
    "imp_05_changed_symbols": "select distinct h.repo, h.sha, y.path, y.name, coalesce(d.dependents, 0) as dependents from {hunks} h join {symbols_} y on y.repo = h.repo and y.path = h.path and (h.new_lines = 0 or y.line between h.new_start - 3 and h.new_start + greatest(h.new_lines, 1) - 1 + 3) left join (select repo, target, count(distinct path) as dependents from {resolved} group by repo, target) d on d.repo = h.repo and d.target = h.path",
    "sig_01_signals": _SIGNALS,
    "sig_02_health": f"select greatest(0, least(100, 100 - 15 * count(case when severity = 'error' then 1 end) - 5 * count(case when severity = 'warning' then 1 end))) as health, count(case when severity = 'error' then 1 end) as errors, count(case when severity = 'warning' then 1 end) as warnings from ({_SIGNALS}) s",
    "sig_03_code_health": f"""select files, ~r0(mi) as maintainability, case when mi >= 80 then 'A' when mi >= 60 then 'B' when mi >= 40 then 'C' when mi >= 20 then 'D' else 'F' end as grade, low, moderate, high, critical, ~r0(debt) as debt, case when debt <= 10 then 'A' when debt <= 25 then 'B' when debt <= 50 then 'C' when debt <= 75 then 'D' else 'F' end as debt_grade
 from (select count(*) as files, avg(mi) as mi, count(case when overall <= 20 then 1 end) as low, count(case when overall > 20 and overall <= 50 then 1 end) as moderate, count(case when overall > 50 and overall <= 80 then 1 end) as high, count(case when overall > 80 then 1 end) as critical,
  least(1e2, count(case when overall > 50 then 1 end) * 30e0 / greatest(1, count(*)) + count(case when cohesion < 3e-1 then 1 end) * 20e0 / greatest(1, count(*)) + least(20e0, max(errors) * 3e0) + least(10e0, max(warnings) * 1e0)) as debt
  from {{file_scores}} f join (select count(case when severity = 'error' then 1 end) as errors, count(case when severity = 'warning' then 1 end) as warnings from ({_SIGNALS}) s) g on g.errors >= 0) x""",
    "sig_03_attention": "select path, ~r0(overall) as overall, case when overall > 80 then 'very high complexity' when overall > 50 then 'high complexity' when cohesion < 3e-1 then 'low cohesion' else 'large file' end as reason from {file_scores} where overall > 50 or cohesion < 3e-1 or lines > 500 order by overall desc, path, file_id limit 10",
    "cnv_01_conventions": _CONVENTIONS,
    "inv_01_invariants": _INVARIANTS,
    "inv_01_passed": f"select r.rule from (select 'no-import' as rule union all select 'require-import' union all select 'layer-boundary' union all select 'naming-pattern' union all select 'max-dependencies' union all select 'annotation-required' union all select 'file-pattern' union all select 'symbol-required') r where not exists (select 1 from ({_INVARIANTS}) v where v.rule = r.rule)",
    "drf_01_signals": _DRIFT,
    "drf_01_report": f"select ~r2(sum(case when category = 'boundary' then weighted * 35e-2 when category = 'naming' then weighted * 2e-1 when category = 'structural' then weighted * 25e-2 else weighted * 2e-1 end)) as composite, max(case when category = 'boundary' then weighted end) as boundary, max(case when category = 'naming' then weighted end) as naming, max(case when category = 'structural' then weighted end) as structural, max(case when category = 'dependency' then weighted end) as dependency from (select category, least(1e2, ~r0(sum({_POINTS}) * 20e0 / max(greatest(1, k.n)))) as weighted from ({_DRIFT}) d join (select count(*) as n from {{sources}}) k on k.n >= 0 group by category) x",
    "drf_02_heatmap": f"select top, count(distinct path) as files, count(subject) as violations, least(1e2, ~r0(sum(coalesce({_POINTS}, 0) * case when subject is null then 0 else 1 end) * 20e0 / count(distinct path))) as score from (select split_part(f.path,'/',1) as top, f.path, d.subject, d.severity from {{sources}} f left join ({_DRIFT}) d on d.subject = f.path) x group by top",
    "drf_04_emergent": f"select top, style, n, ~r2(n * 1e0 / total) as confidence from (select top, style, count(*) as n, sum(count(*)) over (partition by top) as total from (select split_part(path,'/',1) as top, {_STYLE} as style from (select path, ~sub(~sub(path, '^.*/', ''), '\\.[^.]+$', '') as stem from {{sources}}) s) x group by top, style) y where n >= 3 and n * 10 >= total * 7 and style <> 'mixed'",
    "drf_05_mapping": f"select rule, case when rule in ('layer-boundary','no-import','require-import') then 'boundary' when rule = 'naming-pattern' then 'naming' when rule = 'max-dependencies' then 'dependency' else 'structural' end as category, count(*) as n from ({_INVARIANTS}) v group by 1, 2",
    "cog_01_load": "select file_id, cyclomatic_load, cognitive_load, naming_load, abstraction_load, coupling_load, documentation_load, switch_load, model_load, churn_load, score from {load_scores}",
    "cog_02_functions": "select f.file_id, y.name, max_by(y.cyclomatic, y.n) as cyclomatic, max_by(y.cognitive, y.n) as cognitive, max(f.documentation_load) as documentation_load, max(f.coupling_load) as coupling_load, max(f.churn_load) as churn_load, max(f.naming_load) as naming_load from {symbol_metrics} y join {load_scores} f on f.file_id = y.file_id where y.kind in ('function','method') group by f.file_id, y.name",
    "cog_03_modules": "select module, ~r0(avg(score)) as score, count(*) as files, ~r1(avg(switch_load)) as switch_load, ~r0(avg(~clamp(score * 55e-2 + churn_load * 25e-2 + risk * 2e-1))) as onboarding from (select *, split_part(path,'/',1) || '/' || split_part(path,'/',2) as module from {load_scores}) x group by module",
    "cog_03_doc_gaps": "select path, file_id, gap from (select path, file_id, ~clamp(100 - overall) as burden, 100 - documentation_load as documentation, ~r0(~clamp(6e-1 * ~clamp(100 - overall) + 4e-1 * documentation_load)) as gap from {load_scores}) x where burden >= 25 and documentation <= 45 order by gap desc, path, file_id limit 40",
    "cog_03_onboarding": "select path, file_id, ~r0(~clamp(score * 55e-2 + churn_load * 25e-2 + risk * 2e-1)) as difficulty from {load_scores}",
    "cog_04_implicit_coupling": "select c.repo, c.path_a, c.path_b, ~r1(c.score) as score from {coupled} c where not exists (select 1 from {resolved} r where r.repo = c.repo and ((r.path = c.path_a and r.target = c.path_b))) and not exists (select 1 from {resolved} r where r.repo = c.repo and r.path = c.path_b and r.target = c.path_a) order by score desc, c.repo, c.path_a, c.path_b limit 80",
    # files that the rarest word of a file's name finds, six at most: over how many top folders, and how many outside of its own
    "cog_05_dispersion": """select file_id, ~r4(7e-1 * tops / hits + 3e-1 * outside / hits) as dispersion from (select a.file_id, count(*) as hits, count(distinct a.other_top) as tops, count(case when a.other_top <> a.top then 1 end) as outside
 from (select q.file_id, q.top, w.top as other_top, row_number() over (partition by q.file_id order by w.path, w.file_id) as place from (select repo, file_id, top, word from (select f.*, row_number() over (partition by f.file_id order by d.n, f.word) as r from {name_words} f join (select repo, word, count(*) as n from {name_words} group by repo, word) d on d.repo = f.repo and d.word = f.word) x where r = 1) q
  join {name_words} w on w.repo = q.repo and w.word = q.word) a where place <= 6 group by a.file_id) y""",
    "gr_17_rollup": "select coalesce(top, '*') as top, coalesce(module, '*') as module, ~r1(avg(score)) as load, count(*) as files from (select split_part(path,'/',1) as top, split_part(path,'/',2) as module, score from {load_scores}) x group by rollup(top, module)",
    "srt_02_multi_key": "select y.path, y.kind, y.name, ~len(~split(y.path, '/')) as depth from {code_symbols} y order by depth, kind, name, path, n limit 60",
    "srt_03_by_field": "select path, file_id, ~r2(mi) as maintainability, ~r2(cyc) as cyclomatic from {file_scores} order by maintainability, cyclomatic desc, path, file_id limit 25",
    "tst_01_suggest": r"""select file_id, name, kind, test_type, priority from (select y.file_id, y.name, y.kind, case when y.kind = 'class' then 'unit' when y.kind = 'method' then 'unit' else 'function' end as test_type, case when t.stem is null and y.exported then 'high' when m.cyclomatic > 10 then 'high' when y.exported then 'medium' else 'low' end as priority, row_number() over (partition by y.file_id, y.name order by y.n) as r
 from {code_symbols} y join {symbol_metrics} m on m.file_id = y.file_id and m.n = y.n left join (select distinct repo, ~sub(~sub(path, '^.*/', ''), '(_test|\.test|\.spec)\.[a-z]+$', '') as stem from {sources} where ~match(path, '(_test|\.test|\.spec)\.')) t on t.repo = y.repo and t.stem = ~sub(~sub(y.path, '^.*/', ''), '\.[a-z]+$', '') where y.kind in ('function','class','method') and not ~match(y.path, '(_test|\.test|\.spec)\.')) x where r = 1""",
    # a test of the changed file itself, of what depends on it, of its folder, and the rest
    "tst_02_prioritise": r"""select repo, path, max(score) as score from (select t.repo, t.path, 100 as score from {tests} t join {recent} c on c.repo = t.repo and c.stem = t.stem union all select t.repo, t.path, 80 from {tests} t join {resolved} r on r.repo = t.repo and r.path = t.path union all select t.repo, t.path, 75 from {tests} t join {recent} c on c.repo = t.repo and c.path = t.path
 union all select t.repo, t.path, 60 from {tests} t join (select distinct repo, folder from {recent}) c on c.repo = t.repo and c.folder = t.folder union all select repo, path, 45 from {tests}) x group by repo, path""",
    "tst_04_coverage": "select s.repo, count(distinct s.path) as files, count(distinct case when t.path is not null then s.path end) as covered, ~r0(case when count(distinct s.path) = 0 then 100e0 else 100e0 * count(distinct case when t.path is not null then s.path end) / count(distinct s.path) end) as coverage from {recent} s left join {tests} t on t.repo = s.repo and t.stem = s.stem group by s.repo",
    "tst_05_defaults": "select repo, path, case when ~match(path, 'integration|e2e') then 10 else 2 end as seconds, runs, case when runs >= 5 then ~r2(fails * 1e0 / runs) else 0e0 end as flakiness from (select t.repo, t.path, count(c.sha) as runs, count(case when c.deletions > c.additions then 1 end) as fails from {tests} t left join {commit_files} c on c.repo = t.repo and c.path = t.path group by t.repo, t.path) x",
    "hot_01_hot_paths": "select id, name, category, role, criticality from (select n.id, n.path as name, case when ~match(lower(n.path), 'auth|login|session') then 'authentication' when ~match(lower(n.path), 'payment|billing|stripe') then 'payment' when ~match(lower(n.path), 'api|route|endpoint') then 'api-endpoint' when ~match(lower(n.path), 'pipeline|job|queue') then 'data-pipeline' else 'core-business' end as category, case when i.dst is null then 'entry' when o.src is null then 'exit' else 'intermediate' end as role, case when n.size > 900 then 'critical' when n.size > 500 then 'high' else 'medium' end as criticality from {nodes} n left join (select distinct dst from {edges}) i on i.dst = n.id left join (select distinct src from {edges}) o on o.src = n.id) x",
    "ref_01_plan": """select wave, count(*) as modules, sum(size) * 1 as lines, max(case when risk >= 45 then 2 when risk >= 20 then 1 else 0 end) as risk_level from (select w.wave, n.size, 5 * (select_n.k) as risk from (select 1 as wave, src as id from {edges} where dst = 7 union select 2, b.src from {edges} a join {edges} b on b.dst = a.src where a.dst = 7) w join {nodes} n on n.id = w.id join (select dst, count(*) as k from {edges} group by dst) select_n on select_n.dst = w.id) x group by wave""",
}

relations.derive(
    name_words=r"select distinct repo, file_id, path, top, word from (select repo, file_id, path, split_part(path,'/',1) as top, ~each(~split(~sub(~sub(path, '^.*/', ''), '\.[a-z]+$', ''), '[^A-Za-z0-9]+')) as word from {sources}) x where length(word) >= 2",
    tests=r"select repo, path, ~sub(path, '/[^/]*$', '') as folder, ~sub(~sub(path, '^.*/', ''), '(_test|\.test|\.spec)?\.[a-z]+$', '') as stem from {sources} where ~match(path, '(_test|\.test|\.spec)\.|(^|/)(__tests__|tests?)/')",
    recent=r"select distinct repo, path, ~sub(path, '/[^/]*$', '') as folder, ~sub(~sub(path, '^.*/', ''), '\.[a-z]+$', '') as stem from {commit_files} where ts >= NOW - 30 * 86400000000 and not ~match(path, '(_test|\.test|\.spec)\.')",
)





# For Spark alone, files one by one: a single pass over the lines of {line_kinds}, all of it partitioned by file.
# Levels are those of {block_ends}, sums those of {line_sums} in order of n, marks the {code_symbols} without impl.
def _any(patterns: list[str]) -> str:
    """A pattern that matches where one of them does."""
    words = [p[2:] for p in patterns if p.startswith(r"\b")]
    return "|".join([rf"\b(?:{'|'.join(words)})", *(p for p in patterns if not p.startswith(r"\b"))])


_COUNTED = [_KEYWORD, r"\b(break|continue|goto)\s+\w+", r"\b(this|self)\.\w+\(", r"\brecurs"]
_ANY = "case ext " + " ".join(f"when '{ext}' then ~match(line, '{_any([*ps, *_COUNTED])}')" for ext, ps in _FLOW.items()) + f" else ~match(line, '{_any(_COUNTED)}') end"
_FILE_FACTS = rf"""select file_id, repo, path, ext, count(*) as lines, count(case when kind = 'logical' then 1 end) as logical, array_sort(collect_list(struct(n, flow, word, deep, extra, depth))) as sums,
  array_sort(collect_list(case when mark is not null then struct(n, mark.kind as kind, mark.exported as exported, close_n) end)) as marks, array_sort(collect_list(case when source is not null then struct(n, clause, source) end)) as imports
 from (select *, case when delta > 0 then min(case when delta < 0 then n end) over (partition by file_id, level order by n desc rows between unbounded preceding and 1 preceding) end as close_n
  from (select *, posexplode(case when delta > 0 then array(depth) when delta < 0 then sequence(depth + delta, depth - 1) else array(cast(null as bigint)) end) as (entry, level)
   from (select file_id, repo, path, ext, n, kind, delta, depth, mark, source, clause, sum(flow) over ({_FILE}) as flow, sum(word) over ({_FILE}) as word, sum(word * depth) over ({_FILE}) as deep, sum(extra) over ({_FILE}) as extra
    from (select file_id, repo, path, ext, n, kind, delta, flow, word, extra, sum(delta) over ({_FILE}) - delta as depth, source, case when source is not null then line end as clause, case when symbol <> 'impl' and name not in {code._NO_SYMBOL} then struct(symbol as kind, {code._EXPORTED} as exported) end as mark
     from (select file_id, repo, path, ext, n, line, kind, cast(delta as bigint) as delta, case when counted then {_flow("line")} else 0 end as flow, {_WORDS.replace("case when ", "case when counted and ")}, found.kind as symbol, found.name as name, {code._SOURCE} as source
      from (select *, {code._first(lambda k, p: f"struct('{k}' as kind, ~get(line, '{p}') as name)")} as found, {_ANY} as counted, {code._GO_BLOCK} from {{line_kinds}}) a) b) c) d) e) f where entry = 0 group by file_id, repo, path, ext"""
_SYMBOL_ENDS = "select file_id, repo, path, ext, lines, logical, imports, sums, transform(marks, (s, i) -> struct(s.n, s.kind, s.exported, case when ext = 'py' then coalesce(get(marks, i + 1).n - 1, lines) else coalesce(s.close_n, s.n) end as end_n)) as marks from {facts}"
_SYMBOL_SUMS = """select file_id, repo, path, ext, lines, logical, imports, transform(marks, s -> struct(s.n, s.kind, s.exported, s.end_n - s.n + 1 as lines, 1 + z(s).flow - coalesce(a(s).flow, 0) as cyclomatic,
 (z(s).word - coalesce(a(s).word, 0)) + (z(s).deep - coalesce(a(s).deep, 0)) - get(sums, int(s.n) - 1).depth * (z(s).word - coalesce(a(s).word, 0)) + (z(s).extra - coalesce(a(s).extra, 0)) as cognitive)) as marks from {facts}""".replace("z(s)", "get(sums, int(s.end_n) - 1)").replace("a(s)", "get(sums, int(s.n) - 2)")


def cpx_07_signals(spark: SparkSession, d: str) -> DataFrame:
    """Its statement. The relations it names, up to seven times and on several levels, come from one row a file.

    A relation is stated anew wherever another names it, so the plan would grow with the product
    of the mentions on all levels, and the driver holds all of it.
    """
    facts = relations.run(spark, d, spark_sql(_FILE_FACTS))
    for text in (_SYMBOL_ENDS, _SYMBOL_SUMS):
        facts = spark.sql(spark_sql(text), facts=facts)
    # HotSpot compiles no method of more than 8,000 bytes, so above that Spark shall split it
    limit, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set(limit, "8000")
    try:
        facts = cut(facts)
    finally:
        spark.conf.set(limit, before)
    done = {"sources": facts.select("file_id", "repo", "path", "ext", "lines"), "line_metrics": facts.select("file_id", "lines", "logical")}
    done["symbol_metrics"] = done["code_symbols"] = facts.selectExpr("file_id", "inline(marks)")
    done["code_imports"] = facts.selectExpr("file_id", "repo", "path", "ext", "inline(imports)")
    of_symbols = _OF_SYMBOLS.replace("c.exported", "y.exported") + " from {symbol_metrics} y group by y.file_id"
    scores = f"select f.file_id, f.repo, f.path, {_RATES}, {_MI} from {{sources}} f join {{line_metrics}} m on m.file_id = f.file_id left join ({of_symbols}) s on s.file_id = f.file_id"
    done["file_scores"] = cut(relations.run(spark, d, spark_sql(scores), done))
    return relations.run(spark, d, spark_sql(STATEMENTS["cpx_07_signals"]), done)


QUERIES = {k: partial(relations.run, sql=spark_sql(v)) for k, v in STATEMENTS.items()} | {"cpx_07_signals": cpx_07_signals}
SQL = {k: relations.oracle(duck_sql(v)) for k, v in STATEMENTS.items()}
