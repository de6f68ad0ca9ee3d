"""The relations the reports read, as DataFrames over the stored tables, and the same as SQL.

Times are microseconds, names are in one spelling, repeated rows are one. ``BUILD`` makes a
relation for Spark; ``SQL`` states it for the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.scalars import micros, path_key, repo_key
from repolith.session import table

HOUR, DAY = 3_600_000_000, 86_400_000_000
R = "regexp_replace(regexp_replace(lower(repo),'\\s+','','g'),'\\.git$','')"
P = "regexp_replace(regexp_replace(replace(path,'\\','/'),'/+','/','g'),'^(\\./)+','')"

Build = Callable[[SparkSession, str], DataFrame]


def commit_files(s: SparkSession, d: str) -> DataFrame:
    """One row per commit and file."""
    t = table(s, d, "commit_changes").select(repo_key("repo").alias("repo"), "sha", path_key("path").alias("path"), "additions", "deletions", "author", micros("committed_at").alias("ts"), "is_merge", "status")
    return t.dropna(subset=["repo", "sha", "path"]).groupBy("repo", "sha", "path").agg(
        F.coalesce(F.max("additions"), F.lit(0)).alias("additions"), F.coalesce(F.max("deletions"), F.lit(0)).alias("deletions"), F.min("author").alias("author"), F.min("ts").alias("ts"), F.max("is_merge").alias("is_merge"), F.min("status").alias("status")
    )


def commits(s: SparkSession, d: str) -> DataFrame:
    """One row per commit."""
    return commit_files(s, d).groupBy("repo", "sha").agg(
        F.min("author").alias("author"), F.min("ts").alias("ts"), F.max("is_merge").alias("is_merge"), F.count("*").alias("n_files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )


def prs(s: SparkSession, d: str) -> DataFrame:
    """Pull requests, the merged row of each if there is one."""
    t = table(s, d, "pull_requests")
    one = F.max_by(F.struct("pr_number", "title", "author", "state", "base_branch", "head_branch", "is_draft", "merged_by", "head_sha", "merge_commit_sha"), F.struct(F.coalesce(micros("merged_at"), F.lit(-1)), F.coalesce(micros("closed_at"), F.lit(-1))))
    g = t.groupBy("id").agg(
        F.min(repo_key("repo")).alias("repo"), one.alias("x"), F.min(micros("created_at")).alias("created"), F.max(micros("merged_at")).alias("merged"), F.max(micros("closed_at")).alias("closed"), F.min(micros("first_commit_at")).alias("first_commit"),
        F.min(micros("first_review_at")).alias("first_review"), F.max(F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("lines"), F.max(F.coalesce("changed_files", F.lit(0))).cast("long").alias("files"), F.max(F.coalesce("review_count", F.lit(0))).cast("long").alias("reviews"),
    )
    return g.select("id", "repo", "x.*", "created", "merged", "closed", "first_commit", "first_review", "lines", "files", "reviews")


def deps(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "deployments")
    return t.groupBy("id").agg(F.min(repo_key("repo")).alias("repo"), F.min(F.lower(F.trim("environment"))).alias("env"), F.min(F.lower(F.trim("status"))).alias("status"), F.max(micros("created_at")).alias("created"), F.max("sha").alias("sha"), F.min("source").alias("source"), F.min("confidence").alias("confidence"))


def incs(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "incidents")
    return t.groupBy("id").agg(F.min(repo_key("repo")).alias("repo"), F.max(micros("created_at")).alias("created"), F.max(micros("resolved_at")).alias("resolved"), F.min(F.lower(F.trim("severity"))).alias("severity"), F.min("summary").alias("summary"), F.min("source").alias("source"), F.min("confidence").alias("confidence"))


def _links(name: str, column: str, out: tuple[str, str]) -> Build:
    def build(s: SparkSession, d: str) -> DataFrame:
        return table(s, d, name).select(F.col("id").alias(out[0]), F.explode(column).alias(out[1])).dropna().distinct()

    return build


def changes(s: SparkSession, d: str) -> DataFrame:
    """Issue changes in one spelling, one row per history and field."""
    t = table(s, d, "issue_changes").select("history_id", "issue_key", "project_key", micros("issue_created_at").alias("born"), micros("created_at").alias("ts"), F.lower(F.trim("field")).alias("field"), F.lower(F.trim(F.coalesce("from_string", F.lit("")))).alias("frm"), F.lower(F.trim(F.coalesce("to_string", F.lit("")))).alias("dest"))
    return t.distinct()


def moves(s: SparkSession, d: str) -> DataFrame:
    """Changes of an issue's status."""
    return changes(s, d).filter("field = 'status'").drop("field")


def sources(s: SparkSession, d: str) -> DataFrame:
    """Source files with their text in unix line ends."""
    t = table(s, d, "files")
    g = t.groupBy("file_id").agg(F.min(repo_key("repo")).alias("repo"), F.min("path").alias("path"), F.replace(F.coalesce(F.min("file_text"), F.lit("")), F.lit("\r\n"), F.lit("\n")).alias("text"))
    return g.withColumns({"ext": F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)), "chars": F.length("text").cast("long"), "lines": (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")})


def source_lines(s: SparkSession, d: str) -> DataFrame:
    """(file_id, repo, path, ext, n, line), n from 1."""
    t = sources(s, d)
    return t.select("file_id", "repo", "path", "ext", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("file_id", "repo", "path", "ext", (F.col("p") + 1).cast("long").alias("n"), "line")


def symbols(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "files").select("file_id", repo_key("repo").alias("repo"), "path", F.explode("symbols").alias("y"))
    return t.select("file_id", "repo", "path", F.col("y.name").alias("name"), F.col("y.kind").alias("kind"), F.col("y.line").cast("long").alias("line"), F.col("y.end_line").cast("long").alias("end_line"), F.col("y.exported").alias("exported"), F.col("y.documentation").alias("documentation")).distinct()


def nodes(s: SparkSession, d: str) -> DataFrame:
    """Modules of the dependency graph: one a part, with a size and a path."""
    p = table(s, d, "part")
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"))), F.lit("/f"), F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), path.alias("path"), F.lower(F.replace("p_brand", F.lit("#"))).alias("layer"), (F.col("p_size") * 20).cast("long").alias("size"))


def edges(s: SparkSession, d: str) -> DataFrame:
    """Import edges between modules; every 97th closes a cycle."""
    n = nodes(s, d).select("id").filter("id > 0")
    h = F.floor(F.col("id") / 2)
    return n.select(F.col("id").alias("src"), h.alias("dst")).unionByName(n.filter("id % 5 = 0").select(F.col("id").alias("src"), F.floor(F.col("id") / 3).alias("dst"))).unionByName(n.filter("id % 97 = 0").select(h.alias("src"), F.col("id").alias("dst"))).distinct()


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", F.lower("lang").alias("lang"), "source", "n_chars", "repo", micros("created_at").alias("created"))


def events(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "events")
    return t.select("event_id", F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'1970-01-01' as timestamp))").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def index_files(s: SparkSession, d: str) -> DataFrame:
    """(path, excerpt) of the files that the vector index knows."""
    return table(s, d, "semantic_documents").filter("doc_type = 'file'").select("path", "excerpt").distinct()


def pr_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of pull requests as they came, repeats and earlier states among them."""
    t = table(s, d, "pull_requests")
    return t.select("id", repo_key("repo").alias("repo"), "pr_number", F.lower("state").alias("state"), micros("created_at").alias("created"), micros("merged_at").alias("merged"), micros("closed_at").alias("closed"), micros("first_review_at").alias("first_review"))


def dep_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of deployments as they came."""
    t = table(s, d, "deployments")
    return t.select("id", repo_key("repo").alias("repo"), F.lower(F.trim("environment")).alias("env"), F.lower(F.trim("status")).alias("status"), micros("created_at").alias("created"), micros("updated_at").alias("updated"))


def sprint_moves(s: SparkSession, d: str) -> DataFrame:
    """When issues entered and left sprints; equal events are one."""
    t = table(s, d, "sprint_events").select("issue_key", "project_key", "sprint_id", F.lower(F.trim("event_type")).alias("kind"), micros("event_at").alias("ts"))
    return t.filter("ts is not null and kind in ('enter', 'leave')").distinct()


def doc_lines(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n, line) of documents in unix line ends."""
    t = table(s, d, "documents").select("doc_id", "source", F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n").alias("l"))
    return t.select("doc_id", "source", F.posexplode("l").alias("p", "line")).select("doc_id", "source", (F.col("p") + 1).cast("long").alias("n"), "line")


def part_versions(s: SparkSession, d: str) -> DataFrame:
    """What a supplier ships of a part stands for the version that a package needs of a dependency."""
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.concat("l_returnflag", "l_linestatus").alias("version")).distinct()


BUILD: dict[str, Build] = {
    "index_files": index_files, "part_versions": part_versions, "pr_rows": pr_rows, "dep_rows": dep_rows, "sprint_moves": sprint_moves, "doc_lines": doc_lines,
   
    "commit_files": commit_files, "commits": commits, "prs": prs, "deps": deps, "incs": incs, "changes": changes, "moves": moves, "sources": sources, "source_lines": source_lines, "symbols_": symbols, "nodes": nodes, "edges": edges, "docs": docs, "events_": events,
    "pr_keys": _links("pull_requests", "issue_keys", ("pr", "issue")), "dep_prs": _links("deployments", "linked_pull_request_ids", ("dep", "pr")), "inc_keys": _links("incidents", "issue_keys", ("inc", "issue")), "inc_deps": _links("incidents", "linked_deployment_ids", ("inc", "dep")), "inc_labels": _links("incidents", "labels", ("inc", "label")),
}

SQL: dict[str, str] = {
    "index_files": "select distinct path, excerpt from semantic_documents where doc_type = 'file'",
    "pr_rows": f"select id, {R} repo, pr_number, lower(state) state, epoch_us(created_at) created, epoch_us(merged_at) merged, epoch_us(closed_at) closed, epoch_us(first_review_at) first_review from pull_requests",
    "dep_rows": f"select id, {R} repo, lower(trim(environment)) env, lower(trim(status)) status, epoch_us(created_at) created, epoch_us(updated_at) updated from deployments",
    "sprint_moves": "select distinct issue_key, project_key, sprint_id, lower(trim(event_type)) kind, epoch_us(event_at) as ts from sprint_events where event_at is not null and lower(trim(event_type)) in ('enter','leave')",
    "doc_lines": "select doc_id, source, generate_subscripts(l,1)::bigint n, unnest(l) line from (select doc_id, source, string_split(replace(coalesce(text,''),chr(13)||chr(10),chr(10)),chr(10)) l from documents)",
    "part_versions": "select distinct l_partkey part, l_suppkey supplier, l_returnflag || l_linestatus as version from lineitem",
    "commit_files": f"select {R} repo, sha, {P} path, coalesce(max(additions),0) additions, coalesce(max(deletions),0) deletions, min(author) author, min(epoch_us(committed_at)) as ts, max(is_merge) is_merge, min(status) status from commit_changes where repo is not null and sha is not null and path is not null group by 1,2,3",
    "commits": "select repo, sha, min(author) author, min(ts) as ts, max(is_merge) is_merge, count(*) n_files, sum(additions)::bigint additions, sum(deletions)::bigint deletions from commit_files group by 1,2",
    "prs": f"select id, min({R}) repo, max_by(struct_pack(pr_number,title,author,state,base_branch,head_branch,is_draft,merged_by,head_sha,merge_commit_sha), (coalesce(epoch_us(merged_at),-1), coalesce(epoch_us(closed_at),-1))) x, min(epoch_us(created_at)) created, max(epoch_us(merged_at)) merged, max(epoch_us(closed_at)) closed, min(epoch_us(first_commit_at)) first_commit, min(epoch_us(first_review_at)) first_review, max(coalesce(additions,0)+coalesce(deletions,0)) lines, max(coalesce(changed_files,0))::bigint files, max(coalesce(review_count,0))::bigint reviews from pull_requests group by id",
    "deps": f"select id, min({R}) repo, min(lower(trim(environment))) env, min(lower(trim(status))) status, max(epoch_us(created_at)) created, max(sha) sha, min(source) source, min(confidence) confidence from deployments group by id",
    "incs": f"select id, min({R}) repo, max(epoch_us(created_at)) created, max(epoch_us(resolved_at)) resolved, min(lower(trim(severity))) severity, min(summary) summary, min(source) source, min(confidence) confidence from incidents group by id",
    "changes": "select distinct history_id, issue_key, project_key, epoch_us(issue_created_at) born, epoch_us(created_at) as ts, lower(trim(field)) field, lower(trim(coalesce(from_string,''))) frm, lower(trim(coalesce(to_string,''))) dest from issue_changes",
    "moves": "select history_id, issue_key, project_key, born, ts, frm, dest from changes where field='status'",
    "sources": f"select *, lower(regexp_extract(path,'\\.(\\w+)$',1)) ext, length(text) chars, length(text)-length(replace(text,chr(10),''))+1 lines from (select file_id, min({R}) repo, min(path) path, replace(coalesce(min(file_text),''),chr(13)||chr(10),chr(10)) as text from files group by 1)",
    "source_lines": "select file_id, repo, path, ext, generate_subscripts(l,1)::bigint n, unnest(l) line from (select file_id, repo, path, ext, string_split(text,chr(10)) l from sources)",
    "symbols_": f"select distinct file_id, repo, path, y.name as name, y.kind kind, y.line::bigint line, y.end_line::bigint end_line, y.exported exported, y.documentation documentation from (select file_id, {R} repo, path, unnest(symbols) y from files)",
    "nodes": "select p_partkey id, 'src/'||lower(replace(p_brand,'#',''))||'/f'||p_partkey path, lower(replace(p_brand,'#','')) layer, p_size*20 as size from part",
    "edges": "select id src, id//2 dst from nodes where id>0 union select id, id//3 from nodes where id>0 and id%5=0 union select id//2, id from nodes where id>0 and id%97=0",
    "docs": "select doc_id, text, lower(lang) lang, source, n_chars, repo, epoch_us(created_at) created from documents",
    "events_": "select event_id, epoch_us(ts) as ts, user_id, event_type, value, cast(json_extract(props,'$.k') as bigint) k from events",
    "pr_keys": "select distinct id pr, issue from (select id, unnest(issue_keys) issue from pull_requests) where id is not null and issue is not null",
    "dep_prs": "select distinct id dep, pr from (select id, unnest(linked_pull_request_ids) pr from deployments) where pr is not null",
    "inc_keys": "select distinct id inc, issue from (select id, unnest(issue_keys) issue from incidents) where issue is not null",
    "inc_deps": "select distinct id inc, dep from (select id, unnest(linked_deployment_ids) dep from incidents) where dep is not null",
    "inc_labels": "select distinct id inc, label from (select id, unnest(labels) \"label\" from incidents) where label is not null",
}
NEEDS = {"commits": ["commit_files"], "moves": ["changes"], "source_lines": ["sources"], "edges": ["nodes"]}


#: Relations stated once for both engines, in the macros of ``plans.dialect``; see ``derive``.
DERIVED: dict[str, str] = {}


def derive(**statements: str) -> None:
    """Add relations that are stated over others."""
    from repolith.plans.dialect import duck_sql, spark_sql

    for name, text in statements.items():
        DERIVED[name] = text
        BUILD[name] = lambda s, d, text=text: run(s, d, spark_sql(text))
        SQL[name] = re.sub(r"\{(\w+)\}", r"\1", duck_sql(text))
        NEEDS[name] = re.findall(r"\{(\w+)\}", text)


def oracle(sql: str) -> str:
    """The DuckDB statement for SQL that names relations as {relation}."""
    names: list[str] = []

    def need(n: str) -> None:
        for x in NEEDS.get(n, []):
            need(x)
        if n not in names:
            names.append(n)

    for n in re.findall(r"\{(\w+)\}", sql):
        need(n)
    body = re.sub(r"\{(\w+)\}", r"\1", sql)
    ctes = []
    for n in names:
        q = SQL[n]
        if n == "prs":
            q = f"select id, repo, x.pr_number, x.title, x.author, x.state, x.base_branch, x.head_branch, x.is_draft, x.merged_by, x.head_sha, x.merge_commit_sha, created, merged, closed, first_commit, first_review, lines, files, reviews from ({q})"
        ctes.append(f"{n} as ({q})")
    m = re.match(r"\s*with(\s+recursive)?\s", body)
    if m:
        return "with recursive " + ", ".join(ctes) + ", " + body[m.end():]
    return "with recursive " + ", ".join(ctes) + " " + body


def _build(spark: SparkSession, d: str, name: str, done: dict[str, DataFrame]) -> DataFrame:
    from repolith.plans.dialect import spark_sql

    if name in done:
        return done[name]
    return run(spark, d, spark_sql(DERIVED[name]), done) if name in DERIVED else BUILD[name](spark, d)


def run(spark: SparkSession, d: str, sql: str, done: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL that names relations as {relation} over the stored tables; ``done`` has those made already, which serve wherever they are named."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: _build(spark, d, n, done or {}) for n in names})
