"""Queries p5 and p6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith import relations as rel
from repolith.functions.scalars import clamp, half_up
from repolith.operators import intervals, ledger
from repolith.operators.ordered import by_time, fits, neighbours
from repolith.session import cut, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    s = intervals.stays(table(spark, d, "sprint_events"), ["issue_key", "sprint_id"], "event_type", "event_at")
    return intervals.merged_periods(s, ["issue_key"], "start", "end")


def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per issue the number of periods and gaps and the time in closed ones."""
    length = F.when(F.col("end_us") >= 0, F.col("end_us") - F.col("start_us")).otherwise(F.lit(0))
    return p5_found(spark, d).groupBy("issue_key", "span_kind").agg(F.count("*").alias("spans"), F.sum(length).alias("closed_us"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    v = ledger.versions(ledger.ledger(ledger.change_log(table(spark, d, "issue_changes"))))
    return v.select(F.col("entity").alias("issue_key"), F.col("attr").alias("field_name"), F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"))


def p6_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every row the ledger ever held, superseded ones included."""
    return ledger.ledger(ledger.change_log(table(spark, d, "issue_changes")))


def win_06_running_sum(spark: SparkSession, d: str) -> DataFrame:
    """Files that the commits of a repository changed so far."""
    c = cut(rel.commits(spark, d).select("repo", "sha", "ts", "n_files"))
    out = neighbours(c, ["repo"], ["ts", "sha"], by_time("ts"), up_to_sum=["n_files"], whole=fits(c, ["repo"]))
    return out.select("repo", "sha", F.col("sum_upto_n_files").alias("so_far"))


def drf_03_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Score of each commit in order, and its step from the one before."""
    score = half_up(clamp(F.col("n_files") * 2 + F.col("additions") / F.lit(20.0)), 1)
    c = cut(rel.commits(spark, d).select("repo", "sha", "ts", score.alias("score")))
    out = neighbours(c, ["repo"], ["ts", "sha"], by_time("ts"), prev=["score"], number="k", whole=fits(c, ["repo"]))
    return out.select("repo", "sha", (F.col("k") + 1).alias("k"), "score", (F.col("score") - F.coalesce("prev_score", "score")).alias("step"))


P5_SQL = """
with e as (select distinct issue_key, sprint_id, lower(trim(event_type)) k, epoch_us(event_at) t from sprint_events
           where event_at is not null and lower(trim(event_type)) in ('enter','leave')),
f as (select *, lag(k) over (partition by issue_key, sprint_id order by t, k desc) p from e),
g as (select *, lead(t) over (partition by issue_key, sprint_id order by t, k desc) n from f where k <> coalesce(p,'leave')),
s as (select issue_key, t s, coalesce(n, 4611686018427387903) e from g where k='enter'),
m as (select *, max(e) over (partition by issue_key order by s, e rows between unbounded preceding and 1 preceding) m from s),
i as (select *, sum(case when m is null or m < s then 1 else 0 end) over (partition by issue_key order by s, e rows unbounded preceding) g from m),
p as (select issue_key, g, min(s) s, max(e) e from i group by issue_key, g),
q as (select *, lead(s) over (partition by issue_key order by s) n from p),
r as (select issue_key, 'period' span_kind, s start_us, case when e=4611686018427387903 then -1 else e end end_us from q
      union all select issue_key, 'gap', e, n from q where n is not null)
"""
P6_SQL = """
with c as (select history_id, lower(trim(field)) f, min_by(struct_pack(i:=issue_key, b:=epoch_us(issue_created_at), v:=epoch_us(created_at), o:=from_string, n:=to_string), ingested_at) x
           from issue_changes where history_id is not null and field is not null group by 1, 2),
d as (select x.i i, f, x.b b, x.v v, history_id h, lower(trim(coalesce(x.o,''))) o, lower(trim(coalesce(x.n,''))) n from c),
a as (select i, f, v, n from (select *, row_number() over (partition by i, f, v order by h desc) k from d) where k=1
      union all select i, f, b, o from (select *, row_number() over (partition by i, f order by v, h) k from d) where k=1 and b < v),
l as (select *, lag(n) over (partition by i, f order by v) p from a)
select i issue_key, f field_name, v valid_from_us, coalesce(lead(v) over (partition by i, f order by v), -1) valid_to_us from l where p is null or p <> n
"""

QUERIES = {"p5_found": p5_found, "p5_summary": p5_summary, "p6_found": p6_found, "p6_ledger": p6_ledger, "win_06_running_sum": win_06_running_sum, "drf_03_trajectory": drf_03_trajectory}
SQL = {
    "p5_found": P5_SQL + "select * from r",
    "p5_summary": P5_SQL + "select issue_key, span_kind, count(*) spans, sum(case when end_us>=0 then end_us-start_us else 0 end) closed_us from r group by 1, 2",
    "p6_found": P6_SQL,
    "win_06_running_sum": rel.oracle("select repo, sha, sum(n_files) over (partition by repo order by ts, sha rows unbounded preceding)::bigint as so_far from {commits}"),
    "drf_03_trajectory": rel.oracle(
        "select repo, sha, k, score, score - coalesce(lag(score) over (partition by repo order by k), score) as step from (select repo, sha, row_number() over (partition by repo order by ts, sha) as k, "
        "floor(greatest(0e0, least(100e0, n_files * 2 + additions / 20e0)) * 10 + 0.5) / 10 as score from {commits}) x"
    ),
}
