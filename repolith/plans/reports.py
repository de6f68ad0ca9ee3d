"""Analytical reports as declarative statements over the relations.

Keys start with the inventory's row. Catalyst plans them; nothing is collected, ranks end
in names so that they are total.
"""

from __future__ import annotations

import re
from functools import partial

from repolith import relations
from repolith.functions.scalars import glob_regex
from repolith.plans import code  # noqa: F401  (its relations are used here)
from repolith.plans.dialect import duck_sql, spark_sql
from repolith.sources.code import IGNORED

_LAYER = "case when path like 'src/%' then 'core' when path like 'lib/%' then 'lib' when path like 'tests/%' then 'tests' when path like 'packages/%' then 'packages' else 'other' end"
_KIND = (
    "case when ~match(lower(title),'\\b(fix|bug|hotfix|patch)') then 'bugfix' when ~match(lower(title),'\\b(add|feat|implement|introduce)') then 'feature'"
    " when ~match(lower(title),'\\b(refactor|rename|move|clean)') then 'refactor' when ~match(lower(title),'\\b(chore|docs?|test|ci|build)') then 'chore' else 'unknown' end"
)
_BRACES = "(select file_id, n, line, d, sum(d) over (partition by file_id order by n rows unbounded preceding) as total from (select file_id, n, line, length(replace(line, ~chr(125), '')) - length(replace(line, ~chr(123), '')) as d from {source_lines} where ext <> 'py') a)"
_DAYS = "(select repo, path, count(*) n, count(distinct author) authors, min(ts) first_at, max(ts) last_at, sum(additions+deletions) churned from {commit_files} group by repo, path)"
#: Files of three commits or more, whatever else these hold: no others can change together three times.
_SEVERAL = "(select repo, sha, path, n from (select repo, sha, path, count(*) over (partition by repo, path) as n from {commit_files}) f where n >= 3)"

STATEMENTS: dict[str, str] = {
    # --- filters and projections
    "flt_01_symbol_lookup": "select file_id, name, kind, line from {symbols_} where exported and kind = 'function'",
    "flt_02_substring": "select 'file' as type, path from {sources} where lower(path) like '%worker%' union select 'symbol', name from {symbols_} where lower(name) like '%worker%'",
    "flt_03_glob": f"select file_id, path from {{sources}} where ~match(path, '{glob_regex('src/**/*_*.py')}')",
    "flt_04_glob_exact": f"select file_id, path from {{sources}} where path = 'CHANGELOG.md' or ~match(path, '{glob_regex('lib/**/*.go')}')",
    "flt_06_path_contains": "select sha, path from {commit_files} where position('handler' in path) > 0",
    "flt_07_lookback": "select id, repo, created from {prs} where created >= NOW - 30 * 86400000000",
    "flt_08_test_files": "select file_id, path, ~match(path, '(_test|\\.test|\\.spec|_spec)\\.') as by_suffix, ~match(path, '(^|/)(__tests__|tests?)/') as by_directory from {sources}",
    "flt_09_test_symbol": "select file_id, name, ~match(lower(name), '^test|test$|spec$|describe|it') as is_test_legacy, ~match(name, '^test_|^Test') as is_test from {symbols_}",
    "prj_01_weighted_score": "select repo, sha, ~r0(~clamp(0.5e0 * n_files * 4 + 0.3e0 * additions / 10 + 0.2e0 * deletions / 10)) as score from {commits}",
    "prj_03_path_module": "select distinct path, split_part(path,'/',1) as top, case when split_part(path,'/',2) = '' then path else split_part(path,'/',1) || '/' || split_part(path,'/',2) end as module from {commit_files}",
    "prj_04_snippet": "select l.file_id, y.name, l.n, l.line from {source_lines} l join {symbols_} y on y.file_id = l.file_id and l.n between y.line - 2 and y.line + 2 where y.kind = 'class'",
    "src_04_file_rows": "select file_id, ext, chars, lines from {sources}",
    "src_02_ignored": f"select distinct path from {{commit_files}} where not ~match(path, '(^|/)({'|'.join(map(re.escape, IGNORED))})/')",
    "src_03_registry": """select ext, case when ext in ('ts','tsx') then 'typescript' when ext in ('js','jsx','mjs') then 'javascript' when ext = 'py' then 'python' when ext = 'go' then 'go' when ext = 'java' then 'java' when ext = 'rs' then 'rust' when ext = 'rb' or ~match(path, '(^|/)(Rakefile|Gemfile)$') then 'ruby' when ext = 'cs' then 'csharp' when ext in ('kt','kts') then 'kotlin' when ext = 'swift' then 'swift' when ext = 'php' then 'php' when ext in ('c','cc','cpp','h','hpp') then 'cpp' else 'unknown' end as provider, count(*) as files from {sources} group by 1, 2""",
    "src_06_script_exports": "select file_id, n, ~get(line, '^export (?:default )?(?:async )?(?:function|class|const|let|interface|type) +([A-Za-z_$][A-Za-z0-9_$]*)') as name from {source_lines} where ext in ('ts','js') and ~match(line, '^export ')",
    "src_06_script_imports": "select file_id, n, ~get(line, '^import .*from .([^;]+).;') as source from {source_lines} where ext in ('ts','js') and ~match(line, '^import ')",
    "src_08_python_symbols": "select file_id, n, ~get(line, '^ *(?:async )?(?:def|class) +([A-Za-z_][A-Za-z0-9_]*)') as name, case when ~match(line, '^ +(async )?def ') then 'method' when ~match(line, 'class ') then 'class' else 'function' end as kind from {source_lines} where ext = 'py' and ~match(line, '^ *(async )?(def|class) ')",
    "src_09_go_symbols": "select file_id, n, ~get(line, '^func (?:\\([^)]*\\) )?([A-Za-z_][A-Za-z0-9_]*)') as name, ~match(line, '^func \\(') as is_method from {source_lines} where ext = 'go' and ~match(line, '^func ')",
    "src_09_rust_symbols": "select file_id, n, ~get(line, 'fn +([A-Za-z_][A-Za-z0-9_]*)') as name, ~match(line, '^ *pub ') as exported from {source_lines} where ext = 'rs' and ~match(line, '^ *(pub )?(async )?fn ')",
    "src_09_java_types": "select file_id, n, ~get(line, '(?:class|interface|enum) +([A-Za-z_][A-Za-z0-9_]*)') as name from {source_lines} where ext = 'java' and ~match(line, '^(public |final |abstract )*(class|interface|enum) ')",
    "src_17_blame": "select repo, path, author, sum(additions) * 1 as lines, ~r0(~div(100 * sum(additions), sum(sum(additions)) over (partition by repo, path))) as pct from {commit_files} where author is not null group by repo, path, author",
    # --- joins
    "jn_02_hash_join": "select p.id, p.repo, count(d.id) as deployments from {prs} p left join {dep_prs} l on l.pr = p.id left join {deps} d on d.id = l.dep group by p.id, p.repo",
    "jn_03_file_context": "select f.file_id, y.kind, y.name, y.line from {sources} f join {symbols_} y on y.file_id = f.file_id where y.kind in ('function','class','method','interface')",
    "jn_09_unique_export": "select y.file_id, y.name from {symbols_} y join (select name from {symbols_} where exported group by name having count(*) = 1) u on u.name = y.name where y.exported",
    "jn_12_linked_ids": "select l.dep, p.id as pr, ~r1((d.created - p.first_commit) / 3.6e9) as lead_hours from {dep_prs} l join {deps} d on d.id = l.dep join {prs} p on p.id = l.pr",
    "jn_13_by_sha": "select d.id as dep, p.id as pr from {deps} d join {prs} p on p.merge_commit_sha = d.sha where p.merged is not null union select d.id, p.id from {deps} d join {prs} p on p.head_sha = d.sha where p.merged is not null",
    "jn_14_incident_deployments": "select id from {deps} d where exists (select 1 from {inc_deps} i where i.dep = d.id) or exists (select 1 from {dep_prs} l join {pr_keys} k on k.pr = l.pr join {inc_keys} i on i.issue = k.issue where l.dep = d.id)",
    "jn_15_missing_tests": "select s.repo, s.file_id, s.path from (select repo, file_id, path, ~sub(~sub(path, '^.*/', ''), '\\.[a-z]+$', '') as stem from {sources} where not ~match(path, '(_test|\\.test|\\.spec)\\.')) s where not exists (select 1 from (select repo, ~sub(~sub(path, '^.*/', ''), '(_test|\\.test|\\.spec)\\.[a-z]+$', '') as stem from {sources} where ~match(path, '(_test|\\.test|\\.spec)\\.')) t where t.repo = s.repo and t.stem = s.stem)",
    "jn_16_rules": "select r.rule, i.repo, i.path, i.source from {code_imports} i join (select 'no-secret' as rule, 'lib/' as prefix, 'secret' as bad union all select 'no-session', 'src/', 'session' union all select 'no-registry', 'packages/', 'registry') r on i.path like r.prefix || '%' and position(r.bad in i.source) > 0",
    "jn_17_co_change": f"select a.repo, a.path as path_a, b.path as path_b, count(*) as shared from {_SEVERAL} a join {_SEVERAL} b on a.repo = b.repo and a.sha = b.sha and a.path < b.path group by a.repo, a.path, b.path having count(*) > 2",
    "jn_21_mutual_imports": "select a.src, a.dst from {edges} a join {edges} b on a.src = b.dst and a.dst = b.src where a.src < a.dst",
    # --- graph (one hop and counts; fixpoints are in plans.graphs)
    "gr_01_dependents": "select n.id, count(distinct i.src) as dependents, count(distinct o.dst) as dependencies from {nodes} n left join {edges} i on i.dst = n.id left join {edges} o on o.src = n.id group by n.id",
    "gr_16_degrees": "select id, count(*) as degree from (select src as id from {edges} union all select dst from {edges}) x group by id order by degree desc, id limit 10",
    "gr_18_roots_leaves": "select n.id, case when i.dst is null and o.src is null then 'orphan' when i.dst is null then 'root' else 'leaf' end as place from {nodes} n left join (select distinct dst from {edges}) i on i.dst = n.id left join (select distinct src from {edges}) o on o.src = n.id where i.dst is null or o.src is null",
    "gr_19_stats": "select 'files' as item, count(*) as n from {sources} union all select 'symbols', count(*) from {symbols_} union all select 'commits', count(*) from {commits} union all select 'edges', count(*) from {edges} union all select 'pull_requests', count(*) from {prs} union all select 'deployments', count(*) from {deps}",
    # --- aggregation
    "agg_01_group_count": "select ext, count(*) as files from {sources} group by ext",
    "agg_02_contributors": "select repo, author, count(*) as commits, min(ts) as first_at, max(ts) as last_at, count(case when ts >= NOW - 30 * 86400000000 then 1 end) as recent, max(ts) >= NOW - 30 * 86400000000 as is_active, row_number() over (partition by repo order by count(*) desc, author) as place from {commits} where author is not null group by repo, author",
    "agg_03_totals": "select count(*) as files, sum(lines) * 1 as lines, ~r1(avg(chars)) as avg_chars from {sources}",
    "agg_04_median": "select repo, coalesce(median((merged - created) / 3.6e9), 0e0) as median_hours from {prs} where merged is not null group by repo",
    "agg_05_average": "select repo, coalesce(avg(reviews), 0e0) as avg_reviews from {prs} group by repo",
    "agg_06_ratio": "select repo, ~r1(~div(100 * count(merged), count(*))) as merged_pct from {prs} group by repo",
    "agg_07_conditional": "select repo, count(case when is_merge then 1 end) as merges, count(case when n_files > 10 then 1 end) as wide, count(*) as all_commits from {commits} group by repo",
    "agg_08_distinct": "select repo, count(distinct author) as authors, count(distinct path) as paths from {commit_files} group by repo",
    "agg_09_min_confidence": "select repo, case min(case confidence when 'low' then 0 when 'medium' then 1 else 2 end) when 0 then 'low' when 1 then 'medium' else 'high' end as confidence from {deps} group by repo",
    "agg_10_top_share": "select repo, ~r1(~div(100 * max(n), sum(n))) as top_share from (select repo, author, count(*) as n from {commits} where author is not null group by repo, author) x group by repo",
    "agg_12_pivot": "select repo, count(case when severity = 'critical' then 1 end) as critical, count(case when severity = 'high' then 1 end) as high, count(case when severity = 'medium' then 1 end) as medium, count(case when severity = 'low' then 1 end) as low from {incs} group by repo",
    "agg_13_throughput": "select t.field, count(c.history_id) as changed from (select distinct field from {changes}) t left join {changes} c on c.field = t.field and c.ts >= NOW - 14 * 86400000000 group by t.field",
    "agg_14_of_aggregates": "select ~r1(avg(n)) as avg_deployments, min(n) as least, max(n) as most from (select repo, count(*) as n from {deps} where status = 'success' group by repo) x",
    "agg_15_bus_factor": "select repo, min(place) as bus_factor from (select repo, author, row_number() over (partition by repo order by n desc, author) as place, sum(n) over (partition by repo order by n desc, author rows unbounded preceding) as covered, sum(n) over (partition by repo) as total from (select repo, author, count(*) as n from {commits} where author is not null group by repo, author) x) y where covered * 2 >= total group by repo",
    "agg_16_primary_owner": "select repo, path, author as owner, ~r0(~div(100 * n, total)) as ownership from (select repo, path, author, n, sum(n) over (partition by repo, path) as total, row_number() over (partition by repo, path order by n desc, first_at, author) as r from (select repo, path, author, count(*) as n, min(ts) as first_at from {commit_files} where author is not null group by repo, path, author) x) y where r = 1",
    "agg_17_owner_rollup": "select author, count(*) as files, ~r0(avg(100e0 * n / total)) as avg_ownership from (select repo, path, author, n, sum(n) over (partition by repo, path) as total, row_number() over (partition by repo, path order by n desc, author) as r from (select repo, path, author, count(*) as n from {commit_files} where author is not null group by repo, path, author) x) y where r = 1 group by author",
    "agg_18_buckets": "select count(case when lines <= 20 then 1 end) as small, count(case when lines > 20 and lines <= 50 then 1 end) as medium, count(case when lines > 50 and lines <= 80 then 1 end) as large, count(case when lines > 80 then 1 end) as huge from {sources}",
    "agg_20_dominant_style": "select top, style, ~r2(~div(n, total)) as confidence, n from (select top, style, n, sum(n) over (partition by top) as total, row_number() over (partition by top order by n desc, style) as r from (select split_part(path,'/',1) as top, case when ~match(path, '/[a-z0-9]+(-[a-z0-9]+)+\\.[a-z]+$') then 'kebab' when ~match(path, '/[a-z0-9]+(_[a-z0-9]+)+\\.[a-z]+$') then 'snake' else 'mixed' end as style, count(*) as n from {sources} group by 1, 2) x) y where r = 1 and total >= 3",
    "agg_22_weighted_points": "select repo, least(100, greatest(0, ~r0(~div(20 * sum(case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end), count(*))))) as score from {incs} group by repo",
    "agg_23_max_per_key": "select id, max(w) as load from (select src as id, size as w from {edges} e join {nodes} n on n.id = e.dst union all select dst, size from {edges} e join {nodes} n on n.id = e.src) x group by id",
    "agg_27_running_mean": "select user_id, event_id, sum(~r0(value * 100)) over (partition by user_id order by ts, event_id rows unbounded preceding) / (count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) * 1e2) as mean from {events_}",
    "agg_grouping_sets": "select event_type, k, count(*) as n from {events_} group by grouping sets ((event_type), (k), ())",
    # --- windows
    "win_01_rank": "select repo, author, n, row_number() over (partition by repo order by n desc, author) as place, rank() over (partition by repo order by n desc) as tied, dense_rank() over (partition by repo order by n desc) as dense from (select repo, author, count(*) as n from {commits} where author is not null group by repo, author) x",
    "win_02_lead_symbol_end": "select y.file_id, y.name, y.line, coalesce(lead(y.line) over (partition by y.file_id order by y.line, y.name) - 1, f.lines) as end_line from {symbols_} y join {sources} f on f.file_id = y.file_id",
    "win_04_blocked_islands": "select issue_key, min(ts) as from_at, max(until) as until_at from (select issue_key, ts, until, sum(flip) over (partition by issue_key order by ts, history_id rows unbounded preceding) as island, blocked from (select issue_key, history_id, ts, coalesce(lead(ts) over w, NOW) as until, dest = 'blocked' as blocked, case when (dest = 'blocked') = (lag(dest) over w = 'blocked') then 0 else 1 end as flip from {moves} window w as (partition by issue_key order by ts, history_id)) x) y where blocked group by issue_key, island",
    "win_05_rewind": "select issue_key, field, coalesce(min_by(case when ts > NOW - 45 * 86400000000 then frm end, case when ts > NOW - 45 * 86400000000 then ts * 10 + history_id % 10 end), max_by(dest, ts * 10 + history_id % 10)) as value from (select issue_key, field, ts, max(history_id) as history_id, max_by(frm, history_id) as frm, max_by(dest, history_id) as dest from {changes} group by issue_key, field, ts) x group by issue_key, field",
    "win_07_last_rows": "select repo, sha, ts from (select repo, sha, ts, row_number() over (partition by repo order by ts desc, sha) as r from {commits}) x where r <= 10",
    "win_09_period_compare": "select repo, count(case when ts >= NOW - 14 * 86400000000 then 1 end) as now_n, count(case when ts < NOW - 14 * 86400000000 and ts >= NOW - 28 * 86400000000 then 1 end) as before_n from {commits} group by repo",
    "win_10_latest": "select repo, max_by(sha, ts) as sha, max(ts) < NOW - 30 * 86400000000 as stale from (select repo, ts, max(sha) as sha from {commits} group by repo, ts) x group by repo",
    "win_11_keep_first": "select file_id, name, line from (select file_id, name, line, row_number() over (partition by file_id, name order by line, kind) as r from {symbols_}) x where r = 1",
    "win_12_keep_priority": "select file_id, name, kind from (select file_id, name, kind, row_number() over (partition by file_id, name order by case kind when 'class' then 0 when 'function' then 1 else 2 end, kind, line) as r from {symbols_}) x where r = 1",
    "win_13_coupling_trend": "select repo, path, case when n in (1, 3) then 'decreasing' else 'stable' end as coupling_trend from (select repo, path, count(*) as n from {commit_files} group by repo, path) x",
    # --- order, limits, sets
    "srt_01_ties": "select repo, path, n from (select repo, path, count(*) as n from {commit_files} group by repo, path) x order by n desc, repo, path limit 25",
    "srt_04_top_k": "select id, lines from {prs} order by lines desc, id limit 10",
    "srt_05_page": "select id, created from {deps} where created is not null order by created, id limit 20 offset 40",
    "srt_06_union_limit": "select type, name from (select 'file' as type, path as name from {sources} union select 'symbol', name from {symbols_}) x order by type, name limit 40",
    "srt_07_page_filter": "select y.file_id, y.name from {symbols_} y where y.file_id in (select file_id from {sources} order by lines desc, file_id limit 30)",
    "set_01_union": "select name, 'symbol' as what from {symbols_} union select path, 'file' from {sources}",
    "set_03_distinct": "select distinct repo, author from {commits}",
    "set_04_intersection": "select a.author as author_a, b.author as author_b, count(*) as shared from (select distinct author, repo, path from {commit_files} where author is not null) a join (select distinct author, repo, path from {commit_files} where author is not null) b on a.repo = b.repo and a.path = b.path and a.author < b.author group by a.author, b.author",
    "set_04_intersect": "select path from {sources} intersect select path from {commit_files}",
    "set_05_difference": "select path from {sources} except select path from {commit_files}",
    "set_06_pair_key": "select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from {edges} group by 1, 2",
    # --- complexity
    # the nesting never falls below 0: a running sum less its running minimum
    "cpx_04_cognitive": f"select file_id, sum(case when ~match(line, '\\b(if|else|for|while|switch|try|catch|case|when|match|loop)\\b') then 1 + before_n - least(0, low) else 0 end + case when ~match(line, '\\b(this|self)\\.\\w+\\(') then 1 else 0 end) * 1 as cognitive from (select *, min(before_n) over (partition by file_id order by n rows unbounded preceding) as low from (select *, total - d as before_n from {_BRACES} b) c) e group by file_id",
    "cpx_06_coupling": "select n.id, least(100, 5 * (coalesce(i.n, 0) + coalesce(o.n, 0))) as coupling, ~r4(~div(coalesce(o.n, 0), coalesce(i.n, 0) + coalesce(o.n, 0))) as instability from {nodes} n left join (select dst, count(*) as n from {edges} group by dst) i on i.dst = n.id left join (select src, count(*) as n from {edges} group by src) o on o.src = n.id",
    # --- history
    "tmp_06_file_history": f"select repo, path, n, ~r4(n / greatest(1e0, (last_at - first_at) / 8.64e10)) as change_frequency, authors, last_at from {_DAYS} x",
    "tmp_08_calendar": "select hour_of_day, weekday, count(*) as n from (select ~hour(ts) % 24 as hour_of_day, (~day(ts) + 4) % 7 as weekday from {commits}) x group by hour_of_day, weekday",
    "tmp_08_dense_hours": "with recursive h(hour_of_day) as (select 0 union all select hour_of_day + 1 from h where hour_of_day < 23) select h.hour_of_day, count(c.sha) as n from h left join {commits} c on ~hour(c.ts) % 24 = h.hour_of_day group by h.hour_of_day",
    "tmp_09_velocity": "select repo, week, n, coalesce(lag(n) over (partition by repo order by week), 0) as before_n from (select repo, cast(floor((~day(ts) + 3) / 7e0) as bigint) as week, count(*) as n from {commits} group by 1, 2) x",
    "tmp_10_ownership": "select repo, path, authors, owner, pct, pct >= 80 and authors = 1 as high_risk from (select repo, path, author as owner, ~r0(~div(100 * n, sum(n) over (partition by repo, path))) as pct, count(*) over (partition by repo, path) as authors, row_number() over (partition by repo, path order by n desc, author) as r from (select repo, path, author, count(*) as n from {commit_files} where author is not null group by repo, path, author) x) y where r = 1",
    # --- impact, signals, drift, load
    "mon_01_unused_packages": "select layer from (select distinct layer from {nodes}) l where not exists (select 1 from {edges} e join {nodes} a on a.id = e.src join {nodes} b on b.id = e.dst where b.layer = l.layer and a.layer <> b.layer)",
    # --- delivery
    "eng_01_restore": "select repo, ~r1(median((resolved - created) / 3.6e9)) as restore_hours from {incs} where resolved is not null and created is not null group by repo",
    "eng_05_after_hours": "select repo, ~r1(~div(100 * count(case when ~hour(merged) % 24 < 7 or ~hour(merged) % 24 >= 18 or (~day(merged) + 4) % 7 in (0, 6) then 1 end), count(*))) as after_hours from {prs} where merged is not null group by repo",
    "eng_06_timeline": "select d.id, d.repo, d.created, count(i.inc) as incidents from {deps} d left join {inc_deps} i on i.dep = d.id where d.created is not null group by d.id, d.repo, d.created order by d.created desc, d.id limit 50",
    "eng_07_fallback": "select p.repo, p.id, p.merged as created, 'merge_heuristic' as source from {prs} p where p.merged is not null and p.base_branch = 'main' and not exists (select 1 from {deps} d where d.repo = p.repo)",
    "jir_06_severity": "select id, case when ~match(lower(summary), 'sev ?1|critical|outage') then 'critical' when ~match(lower(summary), 'sev ?2|major|stale') then 'high' else 'medium' end as mapped, ~get(summary, '([A-Z]+-[0-9]+)') as issue from {incs}",
    "adm_01_status": "select repo, max(ts) as analysed_at, NOW - max(ts) > 86400000000 as stale, count(*) as commits from {commits} group by repo",
    "str_05_tumbling": "select cast(floor(ts / 3.6e9) as bigint) as hour, event_type, count(*) as n from {events_} group by 1, 2",
    "str_05_sliding": "select w * 3600000000 as window_start, count(*) as n from (select ~hour(ts) as w from {events_} union all select ~hour(ts) - 1 from {events_}) x group by w",
    "str_05_sessions": "select user_id, min(ts) as start_at, max(ts) as end_at, count(*) as n from (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= 1800000000 then 0 else 1 end as fresh from {events_}) x) y group by user_id, s",
    "str_03_rate_windows": "select user_id, cast(floor(ts / 6e7) as bigint) as minute, count(*) as n from {events_} group by 1, 2 having count(*) > 1",
    "str_01_last_per_path": "select path, max_by(status, ts) as status, max(ts) as ts from (select path, ts, max(status) as status from {commit_files} group by path, ts) x group by path",
}


QUERIES = {k: partial(relations.run, sql=spark_sql(v)) for k, v in STATEMENTS.items()}
SQL = {k: relations.oracle(duck_sql(v)) for k, v in STATEMENTS.items()}
