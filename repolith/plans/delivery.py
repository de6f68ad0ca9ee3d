"""Sprints, work items, teams, deliveries, changelogs and documents, stated once for both engines."""

from __future__ import annotations

from functools import partial

from repolith import relations
from repolith.plans.dialect import duck_sql, spark_sql

_DAY = "86400000000"
# fixed values: words by which a message shows its type, the first that fits counts
_MESSAGE = r"""case when ~match(lower(title), '\b(fix|bug|patch|hotfix|issue)\b') then 'bugfix' when ~match(lower(title), '\b(feat|feature|add|implement|new)\b') then 'feature' when ~match(lower(title), '\b(refactor|clean|improve|optimize)\b') then 'refactor' when ~match(lower(title), '\b(chore|deps|update|bump|ci|test)\b') then 'chore' else 'unknown' end"""

relations.derive(
    # a sprint is planned for a day after its first event, and lasts to its last one
    sprints=f"select sprint_id, min(project_key) as project_key, min(ts) + {_DAY} as start_at, greatest(max(ts), min(ts) + 14 * {_DAY}) as end_at from {{sprint_moves}} group by sprint_id",
    # membership at the start: undone by the first event after it, else as the last event left it
    sprint_members=f"""select s.sprint_id, s.project_key, m.issue_key, s.start_at, s.end_at, case coalesce(min_by(case when m.ts > s.start_at then m.kind end, case when m.ts > s.start_at then m.ts end), 'none') when 'enter' then false when 'leave' then true else max_by(m.kind, m.ts) = 'enter' end as at_start,
  count(case when m.kind = 'enter' and m.ts > s.start_at and m.ts <= s.end_at then 1 end) > 0 as added, count(case when m.kind = 'leave' and m.ts > s.start_at and m.ts <= s.end_at then 1 end) > 0 as removed, max_by(m.kind, m.ts) = 'enter' as at_end
 from {{sprints}} s join (select sprint_id, issue_key, ts, max(kind) as kind from {{sprint_moves}} group by sprint_id, issue_key, ts) m on m.sprint_id = s.sprint_id group by s.sprint_id, s.project_key, m.issue_key, s.start_at, s.end_at""",
    # one change of an issue's field an instant
    field_steps="select issue_key, field, ts, max_by(frm, history_id) as frm, max_by(dest, history_id) as dest from {changes} group by issue_key, field, ts",
    sprint_values="""select m.sprint_id, m.issue_key, c.field, coalesce(min_by(case when c.ts > m.start_at then c.frm end, case when c.ts > m.start_at then c.ts end), max_by(c.dest, c.ts)) as at_start, coalesce(min_by(case when c.ts > m.end_at then c.frm end, case when c.ts > m.end_at then c.ts end), max_by(c.dest, c.ts)) as at_end,
  sum(case when c.field = 'story points' and c.ts >= m.start_at and c.ts <= m.end_at then abs(coalesce(try_cast(c.dest as double), 0e0) - coalesce(try_cast(c.frm as double), 0e0)) else 0e0 end) as moved
 from {sprint_members} m join {field_steps} c on c.issue_key = m.issue_key and c.field in ('status', 'story points') group by m.sprint_id, m.issue_key, c.field""",
    sprint_report="""select m.sprint_id, m.project_key, m.start_at, m.end_at, count(case when m.at_start then 1 end) as committed, count(case when m.added and not m.at_start then 1 end) as added, count(case when m.removed then 1 end) as removed, count(case when m.at_end and s.at_end = 'done' then 1 end) as completed, count(case when m.at_start and coalesce(s.at_end, '') <> 'done' then 1 end) as carried, count(*) as issues,
  sum(case when m.at_start then coalesce(try_cast(p.at_start as double), 0e0) else 0e0 end) as committed_points, sum(case when m.added and not m.at_start then coalesce(try_cast(p.at_end as double), 0e0) else 0e0 end) as added_points, sum(case when m.at_end and s.at_end = 'done' then coalesce(try_cast(p.at_end as double), 0e0) else 0e0 end) as completed_points,
  sum(case when m.at_end then coalesce(try_cast(p.at_end as double), 0e0) else 0e0 end) as scope_points, sum(coalesce(p.moved, 0e0)) as churned_points from {sprint_members} m left join {sprint_values} s on s.sprint_id = m.sprint_id and s.issue_key = m.issue_key and s.field = 'status' left join {sprint_values} p on p.sprint_id = m.sprint_id and p.issue_key = m.issue_key and p.field = 'story points' group by m.sprint_id, m.project_key, m.start_at, m.end_at""",
    # integrity falls with scope creep, point churn, carry-over and removals
    sprint_integrity="""select *, (case when creep > 25e-2 then 1 else 0 end) + (case when churn > 2e-1 then 1 else 0 end) + (case when carryover > 35e-2 then 1 else 0 end) + (case when dropped > 12e-2 then 1 else 0 end) as flags, ~r1(~clamp(100 - 40 * creep - 35 * churn - 20 * carryover - 15 * dropped)) as integrity, ~div(100 * completed, greatest(committed + added, 1)) as completion
 from (select *, ~div(added, committed) as creep, ~div(churned_points, committed_points) as churn, ~div(carried, committed) as carryover, ~div(removed, issues) as dropped from {sprint_report}) x""",
    blocked_hours=f"""select issue_key, sum((until - ts) / 3.6e9) as hours from (select issue_key, dest, ts, coalesce(lead(ts) over (partition by issue_key order by ts), NOW) as until, lead(ts) over (partition by issue_key order by ts) is null as open_tail from {{field_steps}} where field = 'status') x where dest = 'blocked' and not open_tail group by issue_key""",
    # started at the first active status, done if the last one is
    work_items=r"""select w.issue_key, w.project_key, w.born, w.started, case when l.last_status = 'done' then w.done_at end as done_at, coalesce(b.hours, 0e0) as blocked_hours, w.reopened, l.last_status
 from (select issue_key, min(project_key) as project_key, min(born) as born, min(case when ~match(dest, 'progress|review|develop') then ts end) as started, max(case when dest = 'done' then ts end) as done_at, count(case when frm = 'done' and dest <> 'done' then 1 end) as reopened from {moves} group by issue_key) w
 join (select issue_key, max_by(dest, ts) as last_status from {field_steps} where field = 'status' group by issue_key) l on l.issue_key = w.issue_key left join {blocked_hours} b on b.issue_key = w.issue_key""",
    issue_types="select issue_key, case when ~match(max(coalesce(dest, '')), 'high|critical') then 'incident' else 'task' end as issue_type from {changes} where field = 'priority' group by issue_key",
    teams="select distinct split_part(repo, '/', 1) as team, repo from {prs} where repo is not null",
    team_deps="select t.team, d.* from {deps} d join {teams} t on t.repo = d.repo",
    # incidents by an issue of the team's requests, or a deployment of its repositories
    team_incs="""select distinct t.team, i.inc from (select k.inc, p.repo from {inc_keys} k join {pr_keys} q on q.issue = k.issue join {prs} p on p.id = q.pr union select l.inc, d.repo from {inc_deps} l join {deps} d on d.id = l.dep union select id, repo from {incs}) i join {teams} t on t.repo = i.repo""",
    team_items="select distinct t.team, q.issue from {pr_keys} q join {prs} p on p.id = q.pr join {teams} t on t.repo = p.repo",
    headings=r"""select doc_id, source, n, length(~get(line, '^(#+)\s')) as level, trim(~sub(~sub(line, '^#+\s+', ''), '\s*#+\s*$', '')) as title from {doc_lines} where ~match(line, '^#+\s+\S')""",
)
_LEVELS = ", ".join(f"min(case when level <= {k} then n end) over (partition by doc_id order by n rows between 1 following and unbounded following) as next_{k}" for k in range(1, 7))
_NEXT = "case level " + " ".join(f"when {k} then next_{k}" for k in range(1, 7)) + " end"

STATEMENTS: dict[str, str] = {
    "src_18_pull_requests": f"""select repo, pr_number, state, created, case when updated >= NOW - 90 * {_DAY} then true else false end as in_window, first_review from (select repo, pr_number, max_by(state, updated * 10 + case state when 'merged' then 2 when 'closed' then 1 else 0 end) as state, min(created) as created, max(updated) as updated, min(first_review) as first_review
 from (select *, coalesce(merged, closed, created, 0) as updated from {{pr_rows}}) r where pr_number is not null and repo is not null group by repo, pr_number) x""",
    "src_19_deployments": f"""select id, repo, env, case when status in ('success','active','inactive') then 'success' when status in ('failure','error') then 'failure' when status in ('queued','in_progress','pending','waiting') then 'pending' else 'unknown' end as status, created from (select id, min(repo) as repo, min(env) as env, max_by(status, coalesce(updated, created, 0)) as status, max(created) as created from {{dep_rows}} group by id) x where created >= NOW - 90 * {_DAY} and env in ('production', 'prod')""",
    "src_15_commit_records": r"""select c.repo, c.sha, c.is_merge, p.title, ~match(coalesce(p.title, ''), '(?i)^revert\b') as is_revert, ~get(coalesce(p.title, ''), '(?i)this reverts commit ([0-9a-f]+)') as reverts from {commits} c left join (select merge_commit_sha, min(title) as title from {prs} where merge_commit_sha is not null group by merge_commit_sha) p on p.merge_commit_sha = c.sha""",
    "src_16_diff_status": "select sha, path, case when additions = 0 and deletions = 0 then 'modified' when additions > 0 and deletions = 0 then 'added' when additions = 0 and deletions > 0 then 'deleted' else 'modified' end as status from {commit_files}",
    "src_22_query_predicate": f"select distinct c.issue_key, c.project_key from {{changes}} c join {{issue_types}} t on t.issue_key = c.issue_key where c.project_key in ('PAY','OPS','DATA') and t.issue_type = 'task' and c.born >= NOW - 60 * {_DAY}",
    # decisions and conventions: items of lists under the heading they stand below
    "src_24_memory": r"""select doc_id, source, heading, item from (select doc_id, source, n, ~get(line, '^\s*[-*]\s+(.*)$') as item, ~held(case when ~match(line, '^#+\s+\S') then trim(~sub(line, '^#+\s+', '')) end) over (partition by doc_id order by n rows unbounded preceding) as heading from {doc_lines} where source in ('adr','style_guide','runbook')) x where item <> ''""",
    "src_24_decisions": r"""select d.doc_id, min_by(h.title, h.n) as title, count(h.n) as sections, max(case when ~match(lower(h.title), 'status|decision|context|consequence') then 1 else 0 end) as has_parts from (select distinct doc_id from {doc_lines} where source = 'adr') d left join {headings} h on h.doc_id = d.doc_id group by d.doc_id""",
    "src_27_sections": rf"""select h.doc_id, h.level, h.title, ~sub(~sub(lower(h.title), '[^a-z0-9]+', '-'), '^-+|-+$', '') as slug, h.n, coalesce(h.until_n - 1, t.lines) as last_n from (select doc_id, level, title, n, {_NEXT} as until_n from (select *, {_LEVELS} from {{headings}}) x) h join (select doc_id, max(n) as lines from {{doc_lines}} group by doc_id) t on t.doc_id = h.doc_id""",
    "tmp_02_classifier": f"select kind, count(*) as n, count(case when created > NOW - 30 * {_DAY} then 1 end) as recent from (select created, {_MESSAGE} as kind from {{prs}}) x group by kind",
    "tmp_08_peaks": f"select hour_of_day, n, n = max(n) over () as is_peak, ~r1(sum(n) over () / 365e0) as per_day from (select ~hour(ts) % 24 as hour_of_day, count(*) as n from {{commits}} where ts >= NOW - 365 * {_DAY} group by 1) x",
    "tmp_09_trend": """select repo, now_n, before_n, case when before_n = 0 and now_n > 0 then 'New' when before_n = 0 then '0' else cast(cast(greatest(-999e0, least(999e0, ~r0(100e0 * (now_n - before_n) / before_n))) as bigint) as varchar(20)) end as trend from (select repo, sum(case when back <= 2 then n else 0 end) as now_n, sum(case when back > 2 and back <= 4 then n else 0 end) as before_n
 from (select repo, n, row_number() over (partition by repo order by week desc) as back from (select repo, cast(floor((~day(ts) + 3) / 7e0) as bigint) as week, count(*) as n from {commits} group by 1, 2) w) x group by repo) y""",
    "win_08_first_last": "select repo, delta, slope, case when delta > 5 then 'worsening' when delta < -5 then 'improving' else 'steady' end as direction from (select repo, ~r2(max_by(score, k) - min_by(score, k)) as delta, ~r2(~div(max_by(score, k) - min_by(score, k), count(*) - 1)) as slope from (select repo, ~clamp(n_files * 2 + additions / 20e0) as score, row_number() over (partition by repo order by ts, sha) as k from {commits}) x group by repo) y",
    "win_03_status_durations": "select issue_key, ts, dest as status, ~r2((coalesce(lead(ts) over (partition by issue_key order by ts), case when dest = 'done' then ts end, NOW) - ts) / 3.6e9) as hours from {field_steps} where field = 'status'",
    "agg_19_top_three": "select module, count(*) as files, ~names(case when r <= 3 then path end) as top_files from (select module, path, row_number() over (partition by module order by lines desc, path, file_id) as r from (select split_part(path,'/',1) || '/' || split_part(path,'/',2) as module, path, lines, file_id from {sources}) x) y group by module",
    "agg_11_repeat_rate": r"select ~r1(~div(100 * sum(case when n > 1 then n else 0 end), sum(n))) as repeat_rate from (select sig, count(*) as n from (select i.id, coalesce(k.keys, trim(~sub(lower(i.summary), '\W+', ' '))) as sig from {incs} i left join (select inc, ~names(issue) as keys from {inc_keys} group by inc) k on k.inc = i.id) s group by sig) t",
    "eng_01_delivery": f"""select d.repo, count(distinct d.id) as deployments, coalesce(~r0(median((d.created - p.first_commit) / 3.6e9)), 0) as lead_hours, ~r1(~div(100 * count(distinct i.dep), count(distinct d.id))) as failure_pct, min(case d.confidence when 'low' then 0 when 'medium' then 1 else 2 end) as confidence
 from {{deps}} d left join {{dep_prs}} l on l.dep = d.id left join {{prs}} p on p.id = l.pr and p.first_commit <= d.created left join {{inc_deps}} i on i.dep = d.id where d.status = 'success' and d.created >= NOW - 90 * {_DAY} group by d.repo""",
    "eng_02_team_report": """select t.team, t.repos, coalesce(d.n, 0) as deployments, coalesce(i.n, 0) as incidents, coalesce(w.n, 0) as work_items from (select team, count(*) as repos from {teams} group by team) t left join (select team, count(*) as n from {team_deps} group by team) d on d.team = t.team left join (select team, count(*) as n from {team_incs} group by team) i on i.team = t.team left join (select team, count(*) as n from {team_items} group by team) w on w.team = t.team""",
    "eng_03_funnel": f"""select repo, ~r1(avg((first_review - created) / 3.6e9)) as pickup_hours, ~r1(avg((merged - first_review) / 3.6e9)) as review_to_merge_hours, ~r1(avg((merged - created) / 3.6e9)) as merge_hours, ~r1(avg(reviews)) as rounds, ~r1(avg(lines)) as size, ~r1(~div(100 * count(merged), count(*))) as merge_rate, ~r1(~div(100 * count(first_review), count(*))) as review_rate, ~r1(~div(100 * count(case when lines >= 500 or files >= 20 then 1 end), count(*))) as large_pct,
 count(case when merged is null and closed is null and created < NOW - 3 * {_DAY} then 1 end) as stale, ~r1(~div(100 * count(case when ~match(lower(title), 'hotfix|emergency|rollback') then 1 end), count(*))) as hotfix_pct from {{prs}} group by repo""",
    "eng_04_planning": """select project_key, ~r1(~div(100 * sum(active), sum(active) + sum(queue))) as flow_efficiency, ~r1(~div(100 * count(case when done_at is null then 1 end), count(*))) as carryover, ~r1(coalesce(avg(case when done_at is null then (NOW - coalesce(started, born)) / 3.6e9 end), 0e0)) as wip_age_hours, ~r1(~div(100 * count(case when blocked_hours > 0 then 1 end), count(*))) as blocked_rate
 from (select *, case when started is not null and done_at is not null then greatest(0e0, (done_at - started) / 3.6e9) else 0e0 end as active, case when done_at is not null then greatest(0e0, (done_at - born) / 3.6e9 - case when started is not null then greatest(0e0, (done_at - started) / 3.6e9) else 0e0 end) else 0e0 end as queue from {work_items}) x group by project_key""",
    "eng_05_reliability": """select count(*) as incidents, count(case when severity = 'critical' then 1 end) as critical, count(case when severity = 'high' then 1 end) as high, count(case when severity = 'medium' then 1 end) as medium, count(case when severity = 'low' then 1 end) as low, ~r1(~div(100 * count(case when k.inc is not null or d.inc is not null then 1 end), count(*))) as linkage_pct
 from {incs} i left join (select distinct inc from {inc_keys}) k on k.inc = i.id left join (select distinct inc from {inc_deps}) d on d.inc = i.id""",
    "eng_05_people": "select ~r1(~div(100 * max(n), sum(n))) as top_author_share, ~r1(~div(100 * max(m), sum(m))) as top_merger_share from (select author as who, count(*) as n, 0 as m from {prs} where author is not null group by author union all select merged_by, 0, count(*) from {prs} where merged_by is not null and merged is not null group by merged_by) x",
    "eng_05_throughput": "select t.issue_type, count(w.done_at) as completed, count(*) as items from {issue_types} t join {work_items} w on w.issue_key = t.issue_key group by t.issue_type",
    "eng_08_overview": """select count(*) as teams, ~r1(avg(deployments)) as avg_deployments, sum(deployments) * 1 as deployments, sum(incidents) * 1 as incidents, ~r1(avg(lead_hours)) as avg_lead_hours, min(confidence) as confidence from (select d.team, count(*) as deployments, max(coalesce(i.n, 0)) as incidents, max(coalesce(l.hours, 0e0)) as lead_hours, min(case d.confidence when 'low' then 0 when 'medium' then 1 else 2 end) as confidence
 from {team_deps} d left join (select team, count(*) as n from {team_incs} group by team) i on i.team = d.team left join (select t.team, median((d.created - p.first_commit) / 3.6e9) as hours from {team_deps} t join {deps} d on d.id = t.id join {dep_prs} l on l.dep = d.id join {prs} p on p.id = l.pr where p.first_commit <= d.created group by t.team) l on l.team = d.team group by d.team) x""",
    "jir_01_flow": f"""select count(done_at) as throughput, ~r1(~div(100 * count(case when t.issue_type = 'incident' then 1 end), count(*))) as unplanned_pct, ~r1(~div(100 * count(case when reopened > 0 then 1 end), count(*))) as reopen_pct, ~r1(sum(case when last_status = 'blocked' then (NOW - born) / 3.6e9 else 0e0 end)) as blocked_aging_hours, ~r1(~div(100 * count(done_at), count(*))) as forecast_pct from {{work_items}} w left join {{issue_types}} t on t.issue_key = w.issue_key where w.born >= NOW - 90 * {_DAY}""",
    "jir_01_types": f"select coalesce(t.issue_type, 'none') as issue_type, count(done_at) as throughput, ~r1(coalesce(median(case when done_at is not null and started is not null then (done_at - started) / 3.6e9 end), 0e0)) as cycle_hours, ~r1(coalesce(median(case when done_at is not null then (done_at - born) / 3.6e9 end), 0e0)) as lead_hours from {{work_items}} w left join {{issue_types}} t on t.issue_key = w.issue_key where w.born >= NOW - 90 * {_DAY} group by 1",
    "jir_01_queue_active": r"select ~r1(sum(case when active then hours else 0e0 end)) as active_hours, ~r1(sum(case when not active and status <> 'done' then hours else 0e0 end)) as queue_hours from (select dest as status, ~match(dest, 'progress|review|develop') as active, (coalesce(lead(ts) over (partition by issue_key order by ts), case when dest = 'done' then ts end, NOW) - ts) / 3.6e9 as hours from {field_steps} where field = 'status') x",
    "jir_02_work_items": "select issue_key, born, started, done_at, ~r1(coalesce(case when started is not null then (done_at - started) / 3.6e9 end, 0e0)) as cycle_hours, ~r1(coalesce((done_at - born) / 3.6e9, 0e0)) as lead_hours, ~r1(blocked_hours) as blocked_hours, reopened > 0 as reopened from {work_items}",
    "jir_03_sprint_report": "select sprint_id, project_key, committed, added, removed, completed, carried, committed_points, added_points, completed_points, scope_points, churned_points from {sprint_report}",
    "jir_04_integrity": "select sprint_id, ~r4(creep) as creep, ~r4(churn) as churn, ~r4(carryover) as carryover, ~r4(dropped) as dropped, flags, integrity, case when integrity < 55 or flags >= 3 then 'high' when integrity < 75 or flags >= 1 then 'medium' else 'low' end as risk from {sprint_integrity}",
    # a running sprint is held against its elapsed share, a closed one against its completion
    "jir_04_health": """select sprint_id, case when end_at > NOW and start_at <= NOW then case when completion >= 100 then 'completed' when pace >= -8e-2 then 'on_track' when pace >= -2e-1 then 'at_risk' else 'off_track' end when start_at > NOW then 'unknown' when completion >= 90 then 'completed' when completion >= 75 then 'on_track' when completion >= 60 then 'at_risk' else 'off_track' end as status,
 ~r1(~clamp(case when end_at > NOW and start_at <= NOW then 70 + 100 * pace - 2e-1 * (100 - integrity) else 8e-1 * completion + 2e-1 * integrity end)) as score, ~r1(completion) as completion from (select *, completion / 100 - least(1e0, greatest(0e0, (NOW - start_at) * 1e0 / greatest(1, end_at - start_at))) as pace from {sprint_integrity}) x""",
    "jir_05_board_history": """select project_key, count(*) as sprints, ~r1(avg(completion)) as avg_completion, ~r1(avg(integrity)) as avg_integrity, ~r2(avg(creep)) as avg_creep, ~r1(avg(completed_points)) as avg_points, count(case when integrity < 55 or flags >= 3 then 1 end) as high_risk, count(case when not (integrity < 55 or flags >= 3) and (integrity < 75 or flags >= 1) then 1 end) as medium_risk
 from (select *, row_number() over (partition by project_key order by end_at desc, sprint_id) as back from {sprint_integrity} where end_at <= NOW) x where back <= 6 group by project_key""",
    "lrn_01_plan": r"""select path, ~r2(score / max(score) over ()) as confidence from (select f.path, sum(s.score / f.place) as score from (select id, sha, least(1e0, hits * 1e0 / greatest(3, words)) as score from (select p.id, p.merge_commit_sha as sha, count(distinct case when w.word in ('retry','stale','handler') then w.word end) as hits, count(distinct w.word) as words from {prs} p join (select id, ~each(~split(~sub(lower(title), '[^a-z0-9]+', ' '), ' ')) as word from {prs}) w on w.id = p.id where p.merged is not null group by p.id, p.merge_commit_sha) x where hits > 0) s
 join {pr_paths} f on f.id = s.id group by f.path) y order by confidence desc, path limit 8""",
    "lrn_02_locate": r"""select path, ~r4(max(hits / 3e0)) as score, count(*) as requests from (select p.id, count(distinct case when w.word in ('sync','stale','handler') then w.word end) as hits from {prs} p join (select id, ~each(~split(~sub(lower(title), '[^a-z0-9]+', ' '), ' ')) as word from {prs}) w on w.id = p.id group by p.id) x join {pr_paths} f on f.id = x.id where hits > 0 group by path order by score desc, requests desc, path limit 8""",
    # calls of a user within half an hour are a session; it succeeded if it ends without an error
    "lrn_03_sessions": "select user_id, min(ts) as start_at, max(ts) as end_at, count(*) as calls, case when max_by(event_type, place) = 'error' then 'reverted' when count(case when event_type = 'purchase' then 1 end) > 0 then 'success' else 'open' end as outcome from (select *, row_number() over (partition by user_id order by ts, event_id) as place, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select user_id, ts, event_id, event_type, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= 1800000000 then 0 else 1 end as fresh from {events_}) x) y group by user_id, s",
    "chg_01_changelog": r"""select place, kind, id, scope, is_breaking, subject from (select id, case kind when 'feat' then 1 when 'feature' then 1 when 'fix' then 2 when 'hotfix' then 2 when 'perf' then 3 when 'refactor' then 4 when 'docs' then 5 else 9 end as place, kind, scope, is_breaking, subject from (
 select id, case when head <> '' then head else case when ~match(lower(title), '\b(fix|bug|hotfix|patch)') then 'fix' when ~match(lower(title), '\b(add|feat|implement|introduce)') then 'feature' when ~match(lower(title), '\b(refactor|clean|rename)') then 'refactor' else 'other' end end as kind, ~get(title, '^\w+\(([^)]*)\)') as scope, ~match(title, '^\w+(\([^)]*\))?!:') or ~match(title, 'BREAKING CHANGE') as is_breaking, trim(~sub(title, '^\w+(\([^)]*\))?!?:\s*', '')) as subject
  from (select id, title, lower(~get(title, '^(\w+)(?:\([^)]*\))?!?:\s')) as head from {prs} where merged is not null) h) k) x where kind not in ('chore', 'ci', 'test', 'build', 'style', 'internal')""",
    "mon_01_packages": "select src_package, dst_package, links, share, case when back > 0 then 'cycle' when links > 5 then 'tight' else 'ok' end as issue from (select a.layer as src_package, b.layer as dst_package, count(*) as links, ~r4(count(*) * 1e0 / sum(count(*)) over (partition by a.layer)) as share, max(case when r.src is not null then 1 else 0 end) as back from {edges} e join {nodes} a on a.id = e.src join {nodes} b on b.id = e.dst left join (select distinct b.layer as src, a.layer as dst from {edges} e join {nodes} a on a.id = e.src join {nodes} b on b.id = e.dst) r on r.src = a.layer and r.dst = b.layer where a.layer <> b.layer group by a.layer, b.layer) x",
    "mon_01_shared_dependencies": "select part as dependency, count(distinct supplier) as packages, count(distinct version) as versions, count(distinct version) > 1 as mismatch from {part_versions} group by part having count(distinct supplier) > 1",
    "gr_13_communities": """select dir, files, symbols, ~r2(~div(inside, links)) as cohesion from (select f.dir, count(distinct f.file_id) as files, count(s.name) as symbols from (select file_id, repo, path, split_part(path,'/',1) || '/' || split_part(path,'/',2) as dir from {sources}) f left join {code_symbols} s on s.file_id = f.file_id group by f.dir) c
 left join (select split_part(path,'/',1) || '/' || split_part(path,'/',2) as d, count(*) as links, count(case when split_part(path,'/',1) || '/' || split_part(path,'/',2) = split_part(target_path,'/',1) || '/' || split_part(target_path,'/',2) then 1 end) as inside from {call_targets} group by 1) k on k.d = c.dir where files >= 3 or symbols >= 6 order by symbols desc, files desc, dir limit 8""",
    "gr_14_hierarchy": """select distinct repo as parent, repo || ':' || split_part(path,'/',1) as child, 'contains' as edge from {sources} union select repo || ':' || split_part(path,'/',1), repo || ':' || split_part(path,'/',1) || '/' || split_part(path,'/',2), 'contains' from {sources} where ~match(path, '/.*/') union select repo || ':' || ~sub(path, '/[^/]*$', ''), repo || ':' || path, 'contains' from {sources} where path like '%/%' union select repo || ':' || path, repo || ':' || path || '#' || name, 'defines' from {code_symbols}""",
    "imp_02_boundary": r"""select i.repo, i.path, i.source, l.layer, o.layer as other from {code_imports} i join {layer_rules} l on i.path like l.prefix || '%' join {layer_rules} o on ~sub(i.source, '^(\./|\.\./)+', '') like o.prefix || '%' where l.layer <> o.layer and not exists (select 1 from {allowed_layers} a where a.layer = l.layer and a.other = o.layer)""",
    "flt_05_first_layer": "select file_id, path, coalesce(min_by(layer, place), 'other') as layer from (select f.file_id, f.path, r.layer, r.place from {sources} f left join {layer_rules} r on f.path like r.prefix || '%') x group by file_id, path",
    "hot_02_hot_impact": """select n.layer, count(distinct n.id) as touched, count(distinct e.src) as affected, case when count(distinct e.src) > 20 then 'critical' when count(distinct e.src) > 8 then 'high' when count(distinct e.src) > 2 then 'medium' else 'low' end as level, ~r0(~div(100 * count(distinct n.id), max(t.n))) as coverage from {nodes} n join {edges} e on e.dst = n.id join (select layer, count(*) as n from {nodes} group by layer) t on t.layer = n.layer where n.size > 500 group by n.layer""",
    "tmp_10_bus_factor": "select ~r2(avg(bus_factor)) as avg_bus_factor, count(case when bus_factor = 1 then 1 end) as single_owner, count(*) as files from (select repo, path, min(place) as bus_factor from (select repo, path, row_number() over (partition by repo, path order by n desc, author) as place, sum(n) over (partition by repo, path order by n desc, author rows unbounded preceding) as covered, sum(n) over (partition by repo, path) as total from (select repo, path, author, count(*) as n from {commit_files} where author is not null group by repo, path, author) x) y where covered * 2 >= total group by repo, path) z",
    "tmp_11_target_history": "select 'file' as what, path as target, sha as id, ts from {commit_files} where path like 'lib/%' union select 'function', y.path || '#' || y.name, h.sha, c.ts from {hunks} h join {symbols_} y on y.repo = h.repo and y.path = h.path and y.line between h.new_start and h.new_start + h.new_lines join {commits} c on c.repo = h.repo and c.sha = h.sha where y.kind = 'function' and y.path like 'lib/%'",
    "tmp_07_related_commits": "select repo, sha, ts from (select repo, sha, ts, row_number() over (partition by repo order by ts desc, sha) as place from (select repo, sha, max(ts) as ts from (select repo, path, sha, ts, row_number() over (partition by repo, path order by ts desc, sha) as r, count(*) over (partition by repo) as files from {commit_files}) x where r <= greatest(1, cast(ceil(20e0 / files) as bigint)) group by repo, sha) y) z where place <= 20",
}

relations.derive(
    # layers in order, the first that holds a path counts; and which may use which
    layer_rules="select 'src/' as prefix, 'core' as layer, 1 as place union all select 'lib/', 'lib', 2 union all select 'packages/', 'packages', 3 union all select 'internal/', 'internal', 4 union all select 'tests/', 'tests', 5",
    allowed_layers="select 'core' as layer, 'lib' as other union all select 'tests', 'core' union all select 'tests', 'lib' union all select 'packages', 'core' union all select 'packages', 'lib'",
    # the files of a request: those its author changed in its repository between its first commit and its merge
    pr_paths="select id, path, row_number() over (partition by id order by path) as place from (select distinct p.id, f.path from {prs} p join {commit_files} f on f.repo = p.repo and f.author = p.author and ~day(f.ts) = ~day(p.merged) where p.merged is not null) x",
)

QUERIES = {k: partial(relations.run, sql=spark_sql(v)) for k, v in STATEMENTS.items()}
SQL = {k: relations.oracle(duck_sql(v)) for k, v in STATEMENTS.items()}
